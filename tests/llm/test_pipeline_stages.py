"""Stages of the pipeline against plain versions; ties, rare languages, short items, clashing names, awkward tables."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from flightlens.llm import classifier, decontamination, mixing, near_join, quality_rules, sharding
from tests.llm.conftest import DOCUMENTS
from tests.llm.test_text_operators import AWKWARD, FOLDER, brute_distance, brute_join, edited

CLASHES = ("score", "predicted", "held_out", "size", "tokens", "shard", "slot", "target", "copies", "source_size")
CLASHES += ("_again", "_lot", "_words", "_copy", "_size", "_class", "_rank", "_file", "_index", "_beside_0", "id", "root", "stays")


def water(sizes, weights=(1, 2, 3), most=3):
    """Targets by raising the level until all is shared: sources that would pass their cap are set aside, again and again."""
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sizes)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        open_ = sum(w for s, w in weight.items() if s not in capped)
        level = rest / open_ if open_ else 0
        over = {s for s in sizes if s not in capped and weight[s] * level > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else weight[s] * level for s in sizes}
        capped |= over


@pytest.mark.parametrize("sizes", [(10, 20, 30), (10, 50, 60, 10), (7,) * 6, (5,), (0, 0), (0, 9, 0), (1, 100, 1, 1, 100), (1, 2, 3, 100, 200, 300), (30, 1, 1, 30, 2, 500, 30)])
def test_targets_of_ties(spark, sizes):
    named = {f"s{k}": n for k, n in enumerate(sizes)}
    rows = spark.createDataFrame([(s, n - n // 2) for s, n in named.items()] + [(s, n // 2) for s, n in named.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows, "source", "size").collect()}
    want = water(named)
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(sizes))
    assert all(0 <= t <= 3 * named[s] for s, t in got.items())
    unit = spark.createDataFrame([(k, f"s{j}", 1) for j, n in enumerate(sizes) for k in range(n)], "doc_id long, source string, size long")
    taken = Counter()
    for r in mixing.mix(unit, "size").collect():
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies
    assert all(abs(taken[s] - t) <= 1 for s, t in want.items())


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_clashing_columns(spark, docs, stage):
    rows = docs(*[(k, f"text number {k} " * 30, "en", f"s{k % 2}") for k in range(12)], *AWKWARD).drop("score")
    wide = rows.select("*", *[near_join.F.lit(f"own {c}").alias(c) for c in CLASHES])
    made = dict(corpus_pipeline.STAGES)[stage](spark, wide, FOLDER)
    new = {"size", "tokens", "shard", "slot"} if stage == "sharding" else set()
    assert [c for c in made.columns if c not in new] == [c for c in wide.columns if c not in new] and new <= set(made.columns)
    for r in made.collect():
        assert all(r[c] == f"own {c}" for c in CLASHES if c not in new)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_awkward_and_no_rows(spark, docs, stage):
    work = dict(corpus_pipeline.STAGES)[stage]
    rows = docs(*AWKWARD)
    given = Counter((r.doc_id, r.text) for r in rows.collect())
    got = Counter((r.doc_id, r.text) for r in work(spark, rows, FOLDER).collect())
    assert set(got) <= set(given)
    if stage == "sharding":
        assert got == given
    elif stage == "n-gram Jaccard join":
        assert got == Counter(given.keys())  # the repeated row is there once, all others are no copies
    elif stage == "benchmark decontamination":
        assert got == given
    assert work(spark, rows.limit(0), FOLDER).count() == 0


def test_pipeline_like_plain_stages(spark):
    """Every stage, on what its predecessor kept, against a version without Spark."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r.item_id, decontamination.normalised(r.text)) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.stored(stage(spark, docs, FOLDER), "test-stage")
        before, after = [(r.doc_id, r.text) for r in docs.collect()], Counter((r.doc_id, r.text) for r in made.collect())
        if name == "quality classifier":
            labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
            want = Counter((r.doc_id, r.text) for r in classifier.score_quality(docs, labels).collect() if r.predicted == 1)
        elif name == "n-gram Jaccard join":
            want = Counter(r for r, (key, _, smallest, _) in zip(sorted(before, key=str), sorted(brute_join(before, 5, 80), key=str), strict=True) if key == smallest)
        elif name == "benchmark decontamination":
            plain = {i: decontamination.normalised(t or "") for i, t in before}
            dirty = {i for i, t in plain.items() for _, item in items if t and decontamination.edit_distance_within(item, t) <= len(item) // 10}
            want = Counter(r for r in before if r[0] not in dirty)
        elif name == "mixing sources to target weights":
            words = {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
            source = {r.doc_id: r.source for r in docs.collect()}
            sizes = Counter()
            for i, n in words.items():
                sizes[source[i]] += n
            target = water({s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s or ""))})
            taken = Counter()
            for (i, _), n in after.items():
                taken[source[i]] += n * words[i]
                assert n <= 3
            longest = max(words.values())
            assert all(abs(taken[s] - t) <= 2 * longest for s, t in target.items())
            want = after
        else:
            rows = made.collect()
            slots = {}
            for r in rows:
                assert r["size"] == len((r.text or "").encode()) + 1
                slots.setdefault(r.shard, []).append(r.slot)
            assert all(sorted(s) == list(range(len(s))) for s in slots.values())
            want = Counter(before)
        assert after == want, name
        docs = made


def test_rare_languages_are_not_judged_by_others(docs):
    rng = random.Random(11)
    words = {lang: ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(300)] for lang in ("en", "de", "fi")}
    text = lambda lang, n: " ".join(rng.choice(words[lang][:60] if rng.random() < 0.6 else words[lang]) for _ in range(n))
    rows = [(k, text(lang, 400), lang) for k, lang in enumerate(["en", "de"] * 300)] + [(1000, text("fi", 150), "fi"), (1001, text("fi", 10), "fi")]
    rows += [(1002, text("fi", 400), "en"), (1003, text("de", 400), None)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs(*rows)).collect()}
    assert got[1000].kept and (got[1000].char_distance, got[1000].word_distance) == (0, 0) and got[1001].base_failed
    assert not got[1002].kept and got[1003].kept and sum(not got[k].kept for k in range(600)) <= 6


def test_short_items_word_for_word(spark, docs):
    benchmark = spark.createDataFrame([(1, "Name it: 10?"), (2, "of"), (3, "?!"), (4, None), (5, "name it 10"), (6, "日本語"), (7, "")], "item_id long, text string")
    rows = docs((10, "please NAME it 10 now"), (11, "rename it 10"), (12, "of"), (13, "offer"), (14, "so of course"), (15, "name it 10"), (16, "これは 日本語 です"), (17, None), (18, "name it 1"))
    got = sorted(tuple(r) for r in decontamination.leaks(rows, benchmark).collect())
    assert got == [(10, 1, 0), (10, 5, 0), (12, 2, 0), (14, 2, 0), (15, 1, 0), (15, 5, 0), (16, 6, 0)]
    assert {r.doc_id for r in decontamination.decontaminate(rows, benchmark).collect()} == {11, 13, 17, 18}


def test_recall_at_the_edit_limit():
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrst      "
    found = total = 0
    for length in (30, 60, 120, 240):
        items = [decontamination.normalised("".join(rng.choice(letters) for _ in range(length))) for _ in range(100)]
        known = decontamination.Items([(k, t) for k, t in enumerate(items)])
        texts = ["".join(rng.choice(letters) for _ in range(300)) + " " + edited(t, decontamination.edits_allowed(len(t)), rng) + " " + "".join(rng.choice(letters) for _ in range(300)) for t in items]
        batch = decontamination.pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
        made = decontamination._search(batch, known).to_pylist()
        hits = {(r["doc_id"], r["item_id"]) for r in made}
        wanted = {(k, k) for k, (t, item) in enumerate(zip(texts, items, strict=True)) if decontamination.edit_distance_within(item, decontamination.normalised(t)) <= decontamination.edits_allowed(len(item))}
        total += len(wanted)
        found += len(wanted & hits)
    assert total >= 350 and found >= 0.99 * total
    assert brute_distance("abc", "xxabdxx") == decontamination.edit_distance_within("abc", "xxabdxx") == 1


def test_large_groups_beside_texts(spark, tmp_path):
    """Places come from the files, so mixing and sharding agree whether the table is read or made."""
    rows = [(k, "same text " * 20 if k % 3 else f"own {k} " * 9, "en", f"s{k % 4}", k) for k in range(400)]
    made = spark.createDataFrame(rows, DOCUMENTS)
    made.repartition(5).write.parquet(f"{tmp_path}/documents")
    read = spark.read.parquet(f"{tmp_path}/documents")
    for work in (mixing.emit, sharding.shard):
        a, b = (sorted((r.doc_id, r["shard"] if "shard" in r else 0) for r in work(t).collect()) for t in (made, read))
        assert [x[0] for x in a] == [x[0] for x in b] and (work is mixing.emit or a == b)
    assert isinstance(made.schema["doc_id"].dataType, T.LongType) and np.unique([r[0] for r in rows]).size == 400


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_large_clusters_in_many_tiles(docs, monkeypatch, width, percent):
    from flightlens.llm import matching

    monkeypatch.setattr(matching, "BLOCK_SETS", 4)
    rng = random.Random(percent)
    words = [f"w{k}" for k in range(160)]
    rows = []
    for k in range(70):  # a chain of texts of many sizes, each like the next
        cut = words[: 50 + k + rng.randint(0, 2)]
        rows.append((k, " ".join(cut)))
    rows += [(100 + k, " ".join(w if rng.random() > 0.01 else f"x{k}" for w in words)) for k in range(30)]
    got = near_join.near_duplicates(docs(*rows), width, percent).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute_join(rows, width, percent)
