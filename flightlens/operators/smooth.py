"""Power transform, series cleaning and local trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flightlens.operators.aggregate import quartiles


def boxcox(value: Column, lam: Column) -> Column:
    """Power transform of a positive value; null otherwise."""
    return F.when(value > 0, F.when(lam == 0, F.log(value)).otherwise((F.pow(value, lam) - 1) / F.nullif(lam, F.lit(0.0))))


def inverse_boxcox(z: Column, lam: Column) -> Column:
    base = F.greatest(lam * z + 1, F.lit(0.0))
    return F.when(z.isNull(), F.lit(None)).when(lam == 0, F.exp(z)).otherwise(F.pow(base, 1 / F.nullif(lam, F.lit(0.0))))


def boxcox_lambda(
    series: DataFrame, period: int, low: float = -1.0, high: float = 2.0, step: float = 0.1
) -> DataFrame:
    """Exponent per series by Guerrero's rule: ``series_key, lam, cv``.

    The series is cut into whole blocks of ``period`` values, counted from its end. The chosen exponent
    is the one on the grid for which ``sd / mean^(1 - lam)`` varies least over the blocks.
    """
    by_key = Window.partitionBy("series_key")
    from_end = F.max("t").over(by_key) - F.col("t")
    blocks = (
        series.withColumn("_block", F.floor(from_end / period))
        .groupBy("series_key", "_block")
        .agg(F.count("value").alias("_n"), F.mean("value").alias("_mean"), F.stddev_samp("value").alias("_sd"))
        .filter((F.col("_n") == period) & (F.col("_mean") > 0))
    )
    last = int(round((high - low) / step))
    grid = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: F.round(F.lit(low) + i * step, 6))
    ratio = F.col("_sd") / F.pow("_mean", 1 - F.col("lam"))
    spread = blocks.withColumn("lam", F.explode(grid)).withColumn("_ratio", ratio).groupBy("series_key", "lam").agg(
        (F.stddev_samp("_ratio") / F.nullif(F.mean("_ratio"), F.lit(0.0))).alias("cv")
    )
    best = spread.filter(F.col("cv").isNotNull()).groupBy("series_key").agg(F.min(F.struct("cv", "lam")).alias("_b"))
    return best.select("series_key", F.col("_b.lam").alias("lam"), F.col("_b.cv").alias("cv"))


def _middle(ordered: Column) -> Column:
    """Median of a sorted array; null for an empty one."""
    size = F.size(ordered)
    low = F.get(ordered, F.floor((size - 1) / 2).cast("int"))
    return (low + F.get(ordered, F.floor(size / 2).cast("int"))) / 2


def _whole_window(series, half_width: int) -> Column:
    """Positions with a full window on both sides."""
    return (F.col("t") > half_width) & (F.col("t") <= F.max("t").over(series) - half_width)


def clean_series(
    series: DataFrame, lambdas: DataFrame | None = None, season: int = 7, half_width: int = 3, fence: float = 3.0
) -> DataFrame:
    """Replace outliers; adds ``cleaned`` and ``is_outlier`` to a series.

    On the power-transformed scale (identity without ``lambdas``, one unknown exponent counts as 1):
    subtract the median of the ``2 * half_width + 1`` surrounding values (the ends take the first and last
    such median), then the median of what is left at the same place of the season; a remainder outside the
    quartiles widened by ``fence`` interquartile ranges is an outlier. It is replaced by the straight line
    between its nearest good neighbours, or by the only neighbour at an end. Missing values stay missing.
    """
    keep = series.columns
    if lambdas is None:
        work = series.withColumn("_lam", F.lit(1.0))
    else:
        side = lambdas.select("series_key", F.col("lam").alias("_lam"))
        work = series.join(side, "series_key", "left").withColumn("_lam", F.coalesce("_lam", F.lit(1.0)))
    whole = Window.partitionBy("series_key")
    ordered = whole.orderBy("t")
    place = Window.partitionBy("series_key", "_place")
    work = (
        work.withColumn("_z", F.when(F.col("_lam") == 1, F.col("value")).otherwise(boxcox(F.col("value"), F.col("_lam"))))
        .withColumn("_near", F.sort_array(F.collect_list("_z").over(ordered.rowsBetween(-half_width, half_width))))
        .withColumn("_level", _middle(F.col("_near")))
        .withColumn("_inner", F.when(_whole_window(whole, half_width), F.struct("t", "_level")))
        .withColumns({"_first": F.min("_inner").over(whole), "_last": F.max("_inner").over(whole)})
        .withColumn(
            "_level",
            F.when(F.col("t") < F.col("_first.t"), F.col("_first._level"))
            .when(F.col("t") > F.col("_last.t"), F.col("_last._level"))
            .otherwise(F.col("_level")),
        )
        .withColumn("_place", F.pmod(F.col("t"), F.lit(season)))
        .withColumn("_rest", F.col("_z") - F.col("_level"))
        .withColumn("_rest", F.col("_rest") - F.median("_rest").over(place))
    )
    q1, q3 = (q.over(whole) for q in quartiles(F.col("_rest")))
    work = work.withColumns({"_q1": q1, "_q3": q3})
    reach = fence * (F.col("_q3") - F.col("_q1"))
    outside = (F.col("_rest") < F.col("_q1") - reach) | (F.col("_rest") > F.col("_q3") + reach)
    work = work.withColumn("is_outlier", F.coalesce(outside, F.lit(False)))
    good = F.when(~F.col("is_outlier") & F.col("_z").isNotNull(), F.struct("t", "_z"))
    # two running windows; a frame that reaches to the end would rescan the rest of the series per row
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    later = whole.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    work = work.withColumn("_good", good).withColumns(
        {"_prev": F.last("_good", ignorenulls=True).over(earlier), "_next": F.last("_good", ignorenulls=True).over(later)}
    )
    slope = (F.col("_next._z") - F.col("_prev._z")) / (F.col("_next.t") - F.col("_prev.t"))
    line = F.col("_prev._z") + slope * (F.col("t") - F.col("_prev.t"))
    filled = F.coalesce(line, F.col("_prev._z"), F.col("_next._z"))
    back = F.when(F.col("_lam") == 1, filled).otherwise(inverse_boxcox(filled, F.col("_lam")))
    return work.withColumn("cleaned", F.when(F.col("is_outlier"), back).otherwise(F.col("value"))).select(
        *keep, "is_outlier", "cleaned"
    )


def local_trend(daily: DataFrame, keys: list[str], x: str, y: str, bandwidth: int, step: int) -> DataFrame:
    """Locally weighted straight line with tricube weights, evaluated every ``step`` units of integer ``x``.

    Every observation is sent to the evaluation points closer than ``bandwidth``, a number fixed by the
    two parameters, and each point is solved from weighted sums that combine before the shuffle. Points
    outside the span of the observations are left out.
    """
    points = F.sequence(
        F.ceil((F.col(x) - bandwidth + 1) / step).cast("long"), F.floor((F.col(x) + bandwidth - 1) / step).cast("long")
    )
    u = F.abs(F.col("_d")) / bandwidth
    weight = F.pow(1 - u * u * u, F.lit(3))
    w, d, v = F.col("_w"), F.col("_d"), F.col(y).cast("double")
    series = Window.partitionBy(*keys)
    sums = (
        daily.dropna(subset=[x, y])
        .withColumn("_p", F.explode(points))
        .withColumn("_p", F.col("_p") * step)
        .withColumn("_d", (F.col(x) - F.col("_p")).cast("double"))
        .withColumn("_w", weight)
        .groupBy(*keys, "_p")
        .agg(
            F.sum(w).alias("_sw"), F.sum(w * d).alias("_sd"), F.sum(w * d * d).alias("_sdd"),
            F.sum(w * v).alias("_sv"), F.sum(w * d * v).alias("_sdv"), F.min(x).alias("_lo"), F.max(x).alias("_hi"),
        )
        .withColumns({"_lo": F.min("_lo").over(series), "_hi": F.max("_hi").over(series)})
        .filter(F.col("_p").between(F.col("_lo"), F.col("_hi")))
    )
    det = F.col("_sw") * F.col("_sdd") - F.col("_sd") * F.col("_sd")
    line = (F.col("_sdd") * F.col("_sv") - F.col("_sd") * F.col("_sdv")) / F.when(det > 1e-9, det)
    return sums.select(
        *keys, F.col("_p").alias(x), F.coalesce(line, F.col("_sv") / F.when(F.col("_sw") > 0, F.col("_sw"))).alias("trend")
    )
