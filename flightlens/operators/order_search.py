"""Choice of seasonal ARIMA orders for many series at once: differences by tests, the rest by a stepwise search.

Every round fits the candidates of all series in one job, a row per series and candidate; the driver only counts whether a
round still made progress. Rounds are stored tables, so nothing is fitted twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flightlens.operators import arima_ml, diagnostics
from flightlens.operators.sarima import Sarima
from flightlens.operators.stl import seasonal_strength
from flightlens.session import stored

KPSS_LIMIT = 0.463  # 5 % point of the level test
STRENGTH_LIMIT = 0.64  # seasonal strength from which on a seasonal difference is taken
MAX_DIFFERENCES = 2
ORDERS = ("p", "d", "q", "sp", "sd", "sq", "drift")
ROUNDS = 40


def differences(series: DataFrame, season: int) -> DataFrame:
    """``series_key, d, sd``: how often to difference at lag 1 and at the season.

    ``sd`` is 1 if the seasonal strength is over 0.64 (and the series holds two seasons), ``d`` the least number at which
    the KPSS test does not reject a level at 5 %, at most 2. The test is made on the series without seasonal differences
    if ``sd`` is 0, else on the seasonally differenced one.
    """
    keys = series.select("series_key").distinct()
    if season > 1:
        strength = seasonal_strength(series, season)
        keys = keys.join(strength, "series_key", "left").withColumn("sd", F.coalesce((F.col("strength") > STRENGTH_LIMIT).cast("int"), F.lit(0)))
    else:
        keys = keys.withColumn("sd", F.lit(0))
    chosen = stored(keys.select("series_key", "sd"), "search-seasonal")
    apart = seasonally_differenced(series, chosen, season)
    tests = chosen
    for d in range(MAX_DIFFERENCES):
        one = diagnostics.kpss(apart, d).select("series_key", (F.col("statistic") > KPSS_LIMIT).alias(f"_rejected_{d}"))
        tests = tests.join(one, "series_key", "left")
    rejected = [F.coalesce(F.col(f"_rejected_{d}"), F.lit(False)) for d in range(MAX_DIFFERENCES)]
    count = F.lit(0)
    for k in reversed(range(MAX_DIFFERENCES)):
        count = F.when(rejected[k], 1 + count).otherwise(0)
    return tests.select("series_key", count.alias("d"), "sd")


def seasonally_differenced(series: DataFrame, chosen: DataFrame, season: int) -> DataFrame:
    """Series whose ``sd`` is 1 differenced at the season, the others as they are."""
    before = series.select("series_key", (F.col("t") + season).alias("t"), F.col("value").alias("_before"))
    rows = series.join(chosen, "series_key").join(before, ["series_key", "t"], "left")
    kept = rows.filter((F.col("sd") == 0) | F.col("_before").isNotNull())
    value = F.when(F.col("sd") == 1, F.col("value") - F.col("_before")).otherwise(F.col("value"))
    return kept.select("series_key", "t", value.alias("value"))


def _candidate(*values) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("int").alias(n) for n, v in zip(ORDERS, values, strict=True)])


def _starts(season: int, most: tuple[int, int, int, int]) -> Column:
    """Four models to begin with; a constant where there is at most one difference."""
    level = (F.col("d") + F.col("sd") < 2).cast("int")
    seasonal = 1 if season > 1 else 0
    p, q, sp, sq = most
    made = [(min(2, p), min(2, q), min(seasonal, sp), min(seasonal, sq)), (0, 0, 0, 0), (min(1, p), 0, min(seasonal, sp), 0), (0, min(1, q), 0, min(seasonal, sq))]
    d, sd = F.col("d"), F.col("sd")
    return F.array_distinct(F.array(*[_candidate(a, d, b, c, sd, e, level) for a, b, c, e in made]))


def _neighbours(season: int, most: tuple[int, int, int, int]) -> Column:
    """Models one step away from the best: one order up or down, both plain or both seasonal orders, or the constant."""
    steps = [(1, 0, 0, 0), (-1, 0, 0, 0), (0, 1, 0, 0), (0, -1, 0, 0), (1, 1, 0, 0), (-1, -1, 0, 0), (1, -1, 0, 0), (-1, 1, 0, 0)]
    if season > 1:
        steps += [(0, 0, 1, 0), (0, 0, -1, 0), (0, 0, 0, 1), (0, 0, 0, -1), (0, 0, 1, 1), (0, 0, -1, -1)]
    made = [_candidate(F.col("p") + a, F.col("d"), F.col("q") + b, F.col("sp") + c, F.col("sd"), F.col("sq") + e, F.col("drift")) for a, b, c, e in steps]
    turned = _candidate(F.col("p"), F.col("d"), F.col("q"), F.col("sp"), F.col("sd"), F.col("sq"), 1 - F.col("drift"))
    p, q, sp, sq = most
    inside = lambda m: m["p"].between(0, p) & m["q"].between(0, q) & m["sp"].between(0, sp) & m["sq"].between(0, sq)
    return F.filter(F.array(*made, F.when(F.col("d") + F.col("sd") < 2, turned)), lambda m: m.isNotNull() & inside(m))


def search(
    series: DataFrame, season: int, most: tuple[int, int, int, int] = (5, 5, 2, 2), given: DataFrame | None = None, rounds: int = ROUNDS
) -> DataFrame:
    """``series_key, p, d, q, sp, sd, sq, drift, aicc, tried``: the best model found for every series.

    Differences come from :func:`differences` (or ``given``: series_key, d, sd). From four models the search goes on to the
    best neighbour by AICc until none is better, at most ``rounds`` times. Models that cannot be fitted count as worst; a
    series for which none can be has a null AICc and the plain model.
    """
    arrays = stored(arima_ml.arrays_for(series, False), "search-series")
    counts = differences(series, season) if given is None else given
    tried = None
    best = stored(counts.select("series_key", "d", "sd"), "search-best")
    fresh = best.select("series_key", F.explode(_starts(season, most)).alias("m")).select("series_key", "m.*")
    for _ in range(rounds + 1):
        tasks = fresh.distinct().repartition("series_key", *ORDERS)
        rows = arrays.join(tasks, "series_key").repartition("series_key", *ORDERS)
        fitted = arima_ml.with_model(rows, lambda row: _model(row, season), lambda fit, row: fit.result())
        made = stored(fitted.select("series_key", *ORDERS, "aicc"), "search-round")
        tried = made if tried is None else tried.unionByName(made)
        # an order by all fields, so that ties have one winner
        rank = F.struct(F.col("aicc").isNull().alias("unfit"), F.col("aicc"), *ORDERS)
        best = tried.groupBy("series_key").agg(F.min(rank).alias("_b"), F.count(F.lit(1)).cast("int").alias("tried"))
        best = stored(best.select("series_key", "_b.*", "tried").drop("unfit"), "search-best")
        near = best.filter("aicc is not null").select("series_key", F.explode(_neighbours(season, most)).alias("m")).select("series_key", "m.*")
        fresh = stored(near.join(tried.select("series_key", *ORDERS), ["series_key", *ORDERS], "left_anti").distinct(), "search-next")
        if fresh.isEmpty():
            break
    return best.select("series_key", *ORDERS, "aicc", "tried")


def _model(row: dict, season: int) -> Sarima:
    return Sarima((row["p"], row["d"], row["q"]), (row["sp"], row["sd"], row["sq"]), season, with_constant=bool(row["drift"]))
