"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flightlens.session import stored

# What separates words, everywhere: space, tab, newline, vertical tab, form feed, carriage return.
WORDS = r"[^\x20\x09-\x0D]+"

ROWS_PER_BUCKET = 100_000


_PLAIN = ("doc_id", "text", "lang", "source", "n_chars")


def beside(docs: DataFrame, work: Callable[[DataFrame], DataFrame], keep: tuple[str, ...] = _PLAIN) -> DataFrame:
    """``work(docs)`` with all columns but ``keep`` under names that no operator uses, and their own names afterwards.

    Where ``work`` adds a column that ``docs`` has too, the added one is returned.
    """
    hidden = {c: f"_beside_{i}" for i, c in enumerate(docs.columns) if c not in keep}
    made = work(docs.withColumnsRenamed(hidden))
    added = set(made.columns) - set(hidden.values())
    lost = [h for c, h in hidden.items() if c in added]
    return made.drop(*lost).withColumnsRenamed({h: c for c, h in hidden.items() if h not in lost})


def with_place(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``_file`` and ``_index``, which tell every row apart and are the same whenever the table is read.

    They are the Parquet file and the row's number in it; a frame that is not read from Parquet is stored first.
    """
    place = {"_file": F.col("_metadata.file_path"), "_index": F.col("_metadata.row_index")}
    try:
        return docs.withColumns(place)
    except AnalysisException:
        return stored(docs, name).withColumns(place)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def hash32(value: Column) -> Column:
    """A long in [0, 2**32) from the md5 of a value's text; null hashes like empty text."""
    digest = F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def ranked(df: DataFrame, group: list[str], coarse: str, fine: str, ties: list[str], rank: str) -> DataFrame:
    """Add ``rank``: 1, 2, 3 ... within ``group`` in the order of (coarse, fine, ties).

    ``coarse`` is an integer column and ``fine`` a long in [0, 2**32); neither may be null. A group is never sorted in
    one task: each (group, coarse) is cut by ranges of ``fine`` into buckets of about ROWS_PER_BUCKET rows, buckets are
    numbered by running counts, and only buckets are sorted. The result does not depend on where the cuts lie.
    """
    keys = [*group, coarse]
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_BUCKET).cast("long").alias("_cuts"))
    cut = null_safe_join(df, sizes, keys).withColumn("_cut", F.shiftright(F.col(fine) * F.col("_cuts"), 32)).drop("_cuts")
    bucket = [*keys, "_cut"]
    before = Window.partitionBy(*group).orderBy(coarse, "_cut").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*bucket).orderBy(fine, *ties)
    rows = cut.withColumn("_in", F.row_number().over(inside))
    joined = null_safe_join(rows, starts, bucket)
    return joined.withColumn(rank, F.col("_start") + F.col("_in")).drop("_start", "_in", "_cut")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys meet; the keys appear once, from the left."""
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    condition = on[0]
    for one in on[1:]:
        condition = condition & one
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def in_batches(
    work: Callable[[pa.RecordBatch], pa.RecordBatch | None], rows: int = 1000
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that handles at most ``rows`` rows at a time, to bound Python memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                made = work(batch.slice(start, rows))
                if made is not None and made.num_rows:
                    yield made

    return run
