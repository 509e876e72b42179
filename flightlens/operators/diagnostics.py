"""Tests on series and residuals, as column expressions on arrays: Ljung-Box, KPSS, conditional likelihood of given models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from flightlens.functions.linalg import let
from flightlens.functions.scalars import log_positive
from flightlens.operators.correlation import mean
from flightlens.operators.sarima import Sarima
from flightlens.operators.series import as_arrays, lagged

GAMMA_TERMS = 200  # of the series or continued fraction; at most some 20 + 3 sqrt(shape) are needed to double precision


def gamma_upper(shape: Column, log_gamma: Column, x: Column, terms: int = GAMMA_TERMS) -> Column:
    """The regularised upper incomplete gamma function Q(shape, x); ``log_gamma`` is the logarithm of Gamma(shape).

    Below shape + 1 the power series of the lower function is taken from one, beyond it the continued fraction (Lentz).
    """
    steps = F.sequence(F.lit(1), F.lit(terms))
    front = F.exp(shape * F.log(F.greatest(x, F.lit(1e-300))) - x - log_gamma)
    start = F.struct((1 / shape).alias("term"), (1 / shape).alias("total"))

    def add(s: Column, k: Column) -> Column:
        return let(s["term"] * x / (shape + k), lambda t: F.struct(t.alias("term"), (s["total"] + t).alias("total")))

    series = 1 - front * F.aggregate(steps, start, add, lambda s: s["total"])

    def turn(s: Column, k: Column) -> Column:
        an, b = -k * (k - shape), s["b"] + 2
        d = 1 / _away(an * s["d"] + b)
        c = _away(b + an / s["c"])
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    b = x + 1 - shape
    first = F.struct(b.alias("b"), F.lit(1e300).alias("c"), (1 / _away(b)).alias("d"), (1 / _away(b)).alias("h"))
    fraction = front * F.aggregate(steps, first, turn, lambda s: s["h"])
    return F.when(x <= 0, F.lit(1.0)).when(x < shape + 1, series).otherwise(fraction)


def _away(value: Column) -> Column:
    return F.when(F.abs(value) < 1e-300, F.lit(1e-300)).otherwise(value)


def chi_square_tail(x: Column, freedom: Column, most: int) -> Column:
    """P(chi-square with ``freedom`` degrees > x); null for less than one degree. ``most`` bounds the degrees."""
    logs = F.array(*[F.lit(math.lgamma(k / 2)) for k in range(1, most + 1)])
    tail = gamma_upper(freedom / 2, F.get(logs, freedom - 1), x / 2)
    return F.when((freedom >= 1) & (freedom <= most), tail)


def ljung_box(residuals: DataFrame, lags: int, fitted: int = 0, values: str = "e") -> DataFrame:
    """``series_key, lag, r, statistic, freedom, p_value``, one row per series and lag up to ``lags``.

    ``residuals`` holds an array per series. ``r`` is the autocorrelation around the mean, ``statistic`` is
    n (n + 2) sum of r[k]^2 / (n - k) up to the lag; ``fitted`` coefficients are taken off the degrees of freedom, and lags
    that leave none have no p-value. Lags at or beyond the length, and series without spread, have nulls.
    """

    def correlated(c: Column) -> Column:
        own = F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
        n = F.size(c)

        def at(k: Column) -> Column:
            size = F.greatest(n - k, F.lit(0))
            both = F.zip_with(F.slice(c, F.lit(1), size), F.slice(c, k + 1, size), lambda a, b: a * b)
            return F.when(k < n, F.aggregate(both, F.lit(0.0), lambda s, v: s + v) / F.when(own > 0, own))

        return let(own, lambda o: F.transform(F.sequence(F.lit(1), F.lit(lags)), at))

    centred = let(mean(F.col(values)), lambda m: F.transform(values, lambda v: v - m))
    wide = residuals.select("series_key", F.size(values).alias("n"), let(centred, correlated).alias("r"))
    k = F.col("lag")

    def running(r: Column, n: Column) -> Column:
        part = lambda s, i: s + F.get(r, i - 1) * F.get(r, i - 1) / (n - i)
        return F.transform(r, lambda v, at: n * (n + 2.0) * F.aggregate(F.sequence(F.lit(1), at + 1), F.lit(0.0), part))

    rows = wide.select("series_key", F.posexplode(F.arrays_zip("r", running(F.col("r"), F.col("n")).alias("q"))).alias("_at", "_v"))
    named = rows.select("series_key", (F.col("_at") + 1).alias("lag"), F.col("_v.r").alias("r"), F.col("_v.q").alias("statistic"))
    return named.withColumn("freedom", F.greatest(k - fitted, F.lit(0))).withColumn(
        "p_value", chi_square_tail(F.col("statistic"), F.col("freedom"), max(1, lags - fitted))
    )


def kpss(series: DataFrame, differences: int = 0) -> DataFrame:
    """``series_key, n, lags, statistic``: the KPSS test of a level, on the series differenced ``differences`` times.

    The sum of squared running sums of the centred values, over n squared times their long-run variance with Bartlett
    weights up to trunc(4 (n / 100)^(1/4)) lags. Over 0.463 a level is rejected at 5 %. Null without spread.
    """
    wide = as_arrays(series)
    values = F.col("y")
    for _ in range(differences):
        values = let(values, lambda y: lagged(y, 1))
    wide = wide.select("series_key", let(values, lambda y: let(mean(y), lambda m: F.transform(y, lambda v: v - m))).alias("c"))
    n = F.size("c")
    # the total is kept beside the sum of its squares
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("squares"))
    walk = F.aggregate(
        "c", start, lambda s, v: let(s["total"] + v, lambda t: F.struct(t.alias("total"), (s["squares"] + t * t).alias("squares"))), lambda s: s["squares"]
    )

    def covariance(k: Column) -> Column:
        size = F.greatest(n - k, F.lit(0))
        both = F.zip_with(F.slice("c", F.lit(1), size), F.slice("c", k + 1, size), lambda a, b: a * b)
        return F.aggregate(both, F.lit(0.0), lambda s, v: s + v) / n

    wide = wide.select("series_key", "c", n.alias("n"), F.floor(4 * F.pow(n / F.lit(100.0), F.lit(0.25))).cast("int").alias("lags"), walk.alias("walk"))
    weighted = F.transform(F.sequence(F.lit(0), F.col("lags")), lambda k: covariance(k) * F.when(k == 0, 1.0).otherwise(2 * (1 - k / (F.col("lags") + 1.0))))
    variance = F.aggregate(weighted, F.lit(0.0), lambda s, v: s + v)
    wide = wide.withColumn("variance", variance)
    statistic = F.col("walk") / (F.col("n").cast("double") * F.col("n") * F.when(F.col("variance") > 0, F.col("variance")))
    return wide.select("series_key", "n", "lags", statistic.alias("statistic"))


def _differenced(values: Column, lag: int) -> Column:
    return let(values, lambda y: lagged(y, lag))


def conditional_likelihood(series: DataFrame, model: Sarima, coefficients: dict[int, float], moving: dict[int, float]) -> DataFrame:
    """``series_key, used, sigma2, loglik, aic, aicc, bic, e`` of a model with given weights, conditional on its first values.

    ``coefficients`` and ``moving`` weigh the past of x and e by lag (the multiplied polynomials). x is the differenced
    series, less its mean if the model has a constant. The first max(ar lags) values are taken as given and errors before
    them as 0; ``e`` holds the errors after them. Null for series that are not longer.
    """
    values = F.transform("y", log_positive) if model.log else F.col("y")
    for lag in model.difference_lags:
        values = _differenced(values, lag)
    if model.constant:
        values = let(values, lambda x: let(mean(x), lambda m: F.transform(x, lambda v: v - m)))
    first, back = max(coefficients, default=0), max(moving, default=0)
    wide = as_arrays(series).select("series_key", values.alias("x"))

    def driven(v: Column, t: Column) -> Column:
        out = v
        for lag, weight in coefficients.items():
            out = out - weight * F.get("x", t - lag)
        return F.when(t >= first, out)

    wide = wide.withColumn("w", F.slice(F.transform("x", driven), first + 1, F.greatest(F.size("x") - first, F.lit(0))))
    if back:
        # the state holds the last errors, newest last, beside all errors so far
        def step(s: Column, w: Column) -> Column:
            out = w
            for lag, weight in moving.items():
                out = out - weight * F.element_at(s["last"], -lag)
            return let(out, lambda e: F.struct(F.concat(F.slice(s["last"], 2, back - 1), F.array(e)).alias("last"), F.concat(s["e"], F.array(e)).alias("e")))

        start = F.struct(F.array_repeat(F.lit(0.0), back).alias("last"), F.array().cast("array<double>").alias("e"))
        wide = wide.withColumn("e", F.aggregate("w", start, step, lambda s: s["e"]))
    else:
        wide = wide.withColumn("e", F.col("w"))
    n = F.nullif(F.size("e"), F.lit(0))
    k = len(coefficients) + len(moving) + model.constant + 1
    wide = wide.select("series_key", n.alias("used"), (F.aggregate("e", F.lit(0.0), lambda s, v: s + v * v) / n).alias("sigma2"), "e")
    loglik = -0.5 * F.col("used") * (F.log(2 * math.pi * F.when(F.col("sigma2") > 0, F.col("sigma2"))) + 1)
    aic = 2 * k - 2 * F.col("loglik")
    return wide.withColumn("loglik", loglik).select(
        "series_key", "used", "sigma2", "loglik", aic.alias("aic"), (aic + 2 * k * (k + 1) / F.when(F.col("used") > k + 1, F.col("used") - k - 1)).alias("aicc"),
        (aic + k * (F.log("used") - 2)).alias("bic"), "e",
    )
