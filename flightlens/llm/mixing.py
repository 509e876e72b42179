"""Mixing sources to target weights by systematic sampling. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flightlens.llm.common import beside, hash32, null_safe_join, ranked, read_documents, with_place, word_count
from flightlens.session import stored

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3


def source_targets(sizes: DataFrame, source: str, size: str, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: (source, source_size, target).

    Sources in code point order, null last, take the weights in turn. All sizes together are shared by weight. A target
    stops at ``max_repeat`` times its source's size; what is over goes to the others by weight. In the order of cap per
    weight the capped sources come first, so one pass of running sums finds the level. The sums are whole numbers.
    """
    totals = sizes.groupBy(source).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    turn = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    rows = totals.withColumn("_w", turn)
    everything = Window.partitionBy()
    rows = rows.withColumn("_total", F.sum("source_size").over(everything)).withColumn("_weights", F.sum("_w").over(everything))
    order = Window.orderBy(F.col("source_size") / F.col("_w"), F.col(source).asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * max_repeat
    rows = rows.withColumn("_rest", F.col("_total") - F.coalesce(F.sum(cap).over(before), F.lit(0)))
    rows = rows.withColumn("_open", F.col("_weights") - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    rows = rows.withColumn("_capped", cap * F.col("_open") <= F.col("_w") * F.col("_rest"))
    # the level comes from the capped sources alone, so it does not matter how sources stand that tie
    rest = F.col("_total") - F.coalesce(F.sum(F.when(F.col("_capped"), cap)).over(everything), F.lit(0))
    open_ = F.col("_weights") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_w"))).over(everything), F.lit(0))
    rows = rows.withColumn("_level", rest.cast("double") / F.nullif(open_, F.lit(0)))
    target = F.when(F.col("_capped"), cap.cast("double")).otherwise(F.col("_w") * F.col("_level"))
    return rows.select(source, "source_size", target.alias("target"))


def _offset(source: Column, seed: str) -> Column:
    """The one random offset of a source: a fraction with 16 bits, so that sums with whole numbers stay exact."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))
    return F.shiftright(hash32(named), 16) / F.lit(65536.0)


def mix(
    docs: DataFrame,
    size: str,
    source: str = "source",
    key: str = "doc_id",
    weights=WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    seed: str = "mix",
) -> DataFrame:
    """Add to every row how often the mix takes it: ``source_size``, ``target``, ``copies``.

    Every document of a source is expected ``target / source_size`` times. Documents of a source stand in the order of
    size class (four to a doubling), then hash of their key; the running sum of expected copies, plus one random offset
    for the source, crosses a whole number as often as the document is emitted. Order by size class makes the taken words
    follow the target closely; order by hash inside a class lets :func:`ranked` split a hot source or size. As all
    documents of a source expect the same, the running sum is rank times expected copies.

    ``size`` names a long column. Rows of size null count 0 words; null sources form a source; a source without words has
    target 0 and emits nothing; null keys hash alike. Equal rows are ranked one after the other. An empty table stays
    empty. Columns of the same names as the three new ones are replaced.
    """
    rows = docs.drop("source_size", "target", "copies").withColumn("_size", F.coalesce(F.col(size), F.lit(0)).cast("long"))
    half = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.col("_size"))) - 1)
    rows = rows.withColumn("_class", (F.length(F.bin(F.col("_size"))) * 4 + F.floor((F.col("_size") - half) * 4 / half)).cast("int"))
    rows = rows.withColumn("_fine", hash32(F.col(key)))
    targets = source_targets(rows, source, "_size", weights, max_repeat)
    placed = ranked(rows, [source], "_class", "_fine", ["_size", key], "_rank")
    joined = null_safe_join(placed, targets, [source])
    expected = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    crossed = lambda at: F.floor(at * expected + _offset(F.col(source), seed))
    copies = F.least(crossed(F.col("_rank")) - crossed(F.col("_rank") - 1), F.lit(max_repeat)).cast("long")
    return joined.withColumn("copies", copies).drop("_size", "_class", "_fine", "_rank")


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as :func:`mix` takes it, with the columns of ``docs``.

    Ranks are found without the texts; documents meet their number of copies in one join by their place.
    """
    return beside(docs, lambda rows: _emit(with_place(rows, "mix-documents"), **options)).select(*docs.columns)


def _emit(placed: DataFrame, source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    light = placed.select("_file", "_index", source, key, word_count(F.col("text")).alias("_words"))
    taken = mix(light, "_words", source, key, **options).filter("copies > 0").select("_file", "_index", "copies")
    joined = placed.join(taken, ["_file", "_index"])
    return joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("_file", "_index", "copies", "_copy")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix(stored(docs, "mix-sizes"), "size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
