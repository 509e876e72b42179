"""Exact quantiles of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from flightlens.session import checked_broadcast, stored

GATHERED = 100_000  # values of one group, or of one interval of it, that a task may hold
BINS = 1024


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])


def _aside(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_{k}" for k in keys})


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: list[float], gathered: int = GATHERED, bins: int = BINS
) -> DataFrame:
    """``keys, probability, quantile``: exact quantiles with linear interpolation, as ``percentile`` gives them.

    A group of up to ``gathered`` values goes to ``percentile``. A larger one is never brought together: its wanted ranks
    start with the interval from least to greatest value. The first pass counts values by sign and power of two, every
    further one the interval in ``bins`` parts of equal width, combined before the shuffle; it goes on in the part that
    holds the rank, drawn in to the values found there. It ends with one value or with an interval of at most ``gathered``
    values, so doubles need seven passes of 1024 parts at most, however they lie. Each reads ``df`` once: hand over a
    stored table. Nulls, NaN and infinities take no part; a group without other values has no row.
    """
    v = F.col(value).cast("double")
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = df.filter(usable).select(*keys, v.alias("_v"), F.lit(0).alias("_all"))
    by = [*keys, "_all"]
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    groups = stored(groups, "quantile-groups")
    few = checked_broadcast(_aside(groups.filter(F.col("_n") <= gathered).select(*by), by))
    ps = sorted(set(probabilities))
    direct = (
        rows.join(few, _same(by), "left_semi")
        .groupBy(*by)
        .agg(F.array(*[F.struct(F.lit(p).alias("p"), F.percentile("_v", F.lit(p)).alias("q")) for p in ps]).alias("_f"))
        .select(*keys, F.explode("_f").alias("_f"))
        .select(*keys, F.col("_f.p").alias("probability"), F.col("_f.q").alias("quantile"))
    )

    # one row per group, probability and neighbouring rank; _below values of the group are less than _lo
    position = (F.col("_n") - 1) * F.col("probability")
    ranks = F.array(F.floor(position), F.ceil(position))
    many = (
        groups.filter(F.col("_n") > gathered)
        .withColumn("probability", F.explode(F.array(*[F.lit(p) for p in ps])))
        .withColumns({"_part": position - F.floor(position), "_below": F.lit(0).cast("long"), "_inside": F.col("_n")})
        .select(*by, "probability", "_part", F.posexplode(ranks).alias("_end", "_rank"), "_lo", "_hi", "_below", "_inside")
    )
    wanted = stored(many, "quantile-ranks")
    unsettled = (F.col("_hi") > F.col("_lo")) & (F.col("_inside") > gathered)
    v = F.col("_v")
    part = F.signum(v) * F.when(v == 0, 0.0).otherwise(F.floor(F.log2(F.abs(v))) + 1100)
    # within a power of two the width of an interval is a double
    even = F.least(F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
    while not wanted.filter(unsettled).isEmpty():
        wanted, part = stored(_narrowed(rows, wanted, by, unsettled, part), "quantile-ranks"), even

    spans = _intervals(wanted.filter(F.col("_hi") > F.col("_lo")), by)
    held = _within(rows, spans, by).groupBy(*by, "_lo", "_hi").agg(F.sort_array(F.collect_list("_v")).alias("_values"))
    place = (F.col("_rank") - F.col("_below") + 1).cast("int")
    found = wanted.join(_aside(held, [*by, "_lo", "_hi"]), _same([*by, "_lo", "_hi"]), "left").withColumn(
        "_v", F.coalesce(F.element_at("_values", place), F.col("_lo"))
    )
    ends = found.groupBy(*by, "probability", "_part").agg(
        F.min(F.when(F.col("_end") == 0, F.col("_v"))).alias("_left"), F.min(F.when(F.col("_end") == 1, F.col("_v"))).alias("_right")
    )
    between = F.col("_left") * (1 - F.col("_part")) + F.col("_right") * F.col("_part")
    return direct.unionByName(ends.select(*keys, "probability", between.alias("quantile")))


def _intervals(wanted: DataFrame, by: list[str]) -> DataFrame:
    """The distinct intervals, which do not overlap within a group; at most two per group and probability."""
    return checked_broadcast(_aside(wanted.select(*by, "_lo", "_hi").distinct(), by))


def _within(rows: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """Rows that lie in an interval of their group, with it."""
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    return rows.join(spans, _same(by) & inside).select(*by, "_v", "_lo", "_hi")


def _narrowed(rows: DataFrame, wanted: DataFrame, by: list[str], unsettled: Column, part: Column) -> DataFrame:
    """One pass: every unsettled rank goes on in the part of its interval that holds it."""
    spans = _intervals(wanted.filter(unsettled), by)
    counts = (
        _within(rows, spans, by)
        .groupBy(*by, "_lo", "_hi", part.alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    )
    before = Window.partitionBy(*by, "_lo", "_hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    at = F.col("_rank") - F.col("_below") - F.col("_before")
    ids = [*by, "_lo", "_hi"]
    hit = _same(ids) & (at >= 0) & (at < F.col("_c"))
    moved = wanted.filter(unsettled).join(_aside(counts, ids), hit).select(
        *by, "probability", "_part", "_end", "_rank",
        F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_below") + F.col("_before")).alias("_below"), F.col("_c").alias("_inside"),
    )
    return wanted.filter(~unsettled).unionByName(moved)
