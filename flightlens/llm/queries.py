"""Registered queries of this subpackage, and their SQL twins where SQL can express them."""

from __future__ import annotations

from flightlens.llm import classifier, decontamination, licenses, licenses_sql, merkle, merkle_sql, mixing, mixing_sql, near_join, paragraphs, pii, quality_rules, sharding, tokens, topk, whitening

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_quality_divergence": quality_rules.op2_quality_divergence,
    "op3_personal_data": pii.op3_personal_data,
    "op4_jaccard_join": near_join.op4_jaccard_join,
    "op5_benchmark_leaks": decontamination.op5_benchmark_leaks,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_quality_gam": classifier.op7_quality_gam,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_vector_shards": sharding.op9_vector_shards,
    "op10_repeated_passages": paragraphs.op10_repeated_passages,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_exact_topk": topk.op12_exact_topk,
    "op13_whitened_vectors": whitening.op13_whitened_vectors,
}

ORACLES = {**licenses_sql.ORACLES, **mixing_sql.ORACLES, **merkle_sql.ORACLES, **topk.ORACLES}
