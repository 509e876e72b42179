"""Quality classifier: features of a text, scored by an additive model with pairwise terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flightlens.llm import gam, textstats as ts
from flightlens.llm.common import in_batches, read_documents

# Labelled rows that a model is fitted on, at most; chosen by the hash of doc_id.
MAX_LABELS = 20_000

FEATURES = (
    "words", "word_length", "longest_word", "distinct_words", "top_word", "repeat_words", "duplicate_lines", "line_words",
    "symbols", "lower", "upper", "letter", "digit", "space", "stop", "pause", "sign", "other",
)


def features(text: str, table: np.ndarray) -> list[float]:
    """Numbers that describe a text; all 0 for an empty one."""
    words = ts.WORD.findall(text)
    if not words:
        return [0.0] * len(FEATURES)
    numbers, codes = ts.word_codes(words)
    classes = ts.class_counts(text, table) / len(text)
    n, lines = len(words), text.count("\n") + 1
    return [
        np.log1p(n), sum(map(len, words)) / n, np.log1p(max(map(len, numbers))), len(numbers) / np.sqrt(n),
        np.bincount(codes).max() / n, ts.repeat_words(codes, len(numbers)) / n, ts.duplicate_lines(text) / lines,
        np.log1p(n / lines), ts.symbols(text) / n, *classes.tolist(),
    ]


def held_out(doc_id: Column) -> Column:
    """True for rows whose label no model may see; a null key counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _with_features(docs: DataFrame, table) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(t or "", table.value) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(in_batches(work), "doc_id long, x array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, table, most: int = MAX_LABELS) -> gam.Gam:
    """Fit on at most ``most`` labelled documents that are not held out. A key with both labels counts as 1.

    The bounded sample is taken from the labels first, so that only its documents are read for features.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    sample = usable.groupBy("doc_id").agg(F.max("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = _with_features(chosen, table).join(F.broadcast(sample), "doc_id").select("doc_id", "x", "y").limit(4 * most).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in rows], dtype=float).reshape(-1, len(FEATURES))
    return gam.fit(x, np.array([r["y"] for r in rows], dtype=float))


def score_quality(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> DataFrame:
    """All rows and columns of ``docs`` with ``held_out``, ``score`` and ``predicted``.

    The score is the probability of label 1, from the text alone. Null and empty texts have all features 0 and are scored
    like any other text. Without labels every score is one half. Columns of the same names as the new ones are replaced.
    """
    sc = docs.sparkSession.sparkContext
    table = sc.broadcast(ts.class_table())
    model = sc.broadcast(vars(fit_quality(docs, labels, table, most)))
    rest = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    at = rest.index("text")
    schema = docs.select(*rest).schema.add("score", "double")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t or "", table.value) for t in batch.column(at).to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(gam.score(model.value, x))], [*batch.schema.names, "score"])

    scored = docs.select(*rest).mapInArrow(in_batches(work), schema)
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(read_documents(spark, sf_dir).select("doc_id", "text"), labels)
    return scored.select("doc_id", "held_out", "score", "predicted")
