"""Autocorrelation and partial autocorrelation of many series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flightlens.functions.linalg import dot, let
from flightlens.operators.series import as_arrays


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def mean(values: Column) -> Column:
    """Mean of an array; null for an empty one."""
    return total(values) / F.nullif(F.size(values), F.lit(0))


def positive(value: Column) -> Column:
    return F.when(value > 0, value)


def autocorrelations(centred: Column, max_lag: int) -> Column:
    """Lags 1 to ``max_lag`` (at most length - 1) of an array with mean zero, denominator n."""

    def at_lag(k: Column) -> Column:
        size = F.size(centred) - k
        return dot(F.slice(centred, F.lit(1), size), F.slice(centred, k + 1, size))

    lags = F.filter(F.sequence(F.lit(1), F.lit(max_lag)), lambda k: k < F.size(centred))
    return let(positive(dot(centred, centred)), lambda power: F.transform(lags, lambda k: at_lag(k) / power))


def levinson(acf: Column) -> Column:
    """Durbin-Levinson recursion over an array of autocorrelations.

    Returns ``phi`` (autoregression of the highest order), ``v`` (share of variance left) and ``pacf``.
    """
    none = F.array().cast("array<double>")
    start = F.struct(none.alias("phi"), F.lit(1.0).alias("v"), none.alias("pacf"))

    def step(state: Column, k: Column) -> Column:
        past = F.reverse(F.slice(acf, F.lit(1), k - 1))
        share = F.when(state["v"] > 1e-12, state["v"])
        partial = (F.element_at(acf, k) - dot(state["phi"], past)) / share
        return let(
            partial,
            lambda p: F.struct(
                F.concat(
                    F.zip_with(state["phi"], F.reverse(state["phi"]), lambda a, b: a - p * b), F.array(p)
                ).alias("phi"),
                (state["v"] * (1 - p * p)).alias("v"),
                F.concat(state["pacf"], F.array(p)).alias("pacf"),
            ),
        )

    lags = F.filter(F.sequence(F.lit(1), F.size(acf) + 1), lambda k: k <= F.size(acf))
    return F.aggregate(lags, start, step)


def _acf(y: Column, max_lag: int) -> Column:
    centred = let(mean(y), lambda m: F.transform(y, lambda v: v - m))
    return let(centred, lambda x: autocorrelations(x, max_lag))


def autocorrelation(series: DataFrame, max_lag: int) -> DataFrame:
    """``series_key, lag, acf`` for lags 1 to ``max_lag``."""
    lags = as_arrays(series).select("series_key", F.posexplode(_acf(F.col("y"), max_lag)).alias("_i", "acf"))
    return lags.select("series_key", (F.col("_i") + 1).alias("lag"), "acf")


def correlogram(series: DataFrame, max_lag: int) -> DataFrame:
    """``series_key, lag, acf, pacf`` for lags 1 to ``max_lag``."""

    def both(y: Column) -> Column:
        return let(_acf(y, max_lag), lambda r: F.arrays_zip(r.alias("acf"), levinson(r)["pacf"].alias("pacf")))

    lags = as_arrays(series).select("series_key", F.posexplode(both(F.col("y"))).alias("_i", "_c"))
    return lags.select("series_key", (F.col("_i") + 1).alias("lag"), "_c.acf", "_c.pacf")
