"""Seasonal-trend decomposition of many series, the strength of their season, and cleaning by what is left.

A series is one row with its values as an array, at most one per calendar day; the smoothers of ``functions.smoothing`` run
on it inside the task that holds the row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flightlens.functions import smoothing
from flightlens.operators.smooth import boxcox, inverse_boxcox

ROBUST = 15  # rounds of robustness weights


def _by_series(series: DataFrame, columns: dict[str, str], work: Callable[[np.ndarray], dict[str, np.ndarray] | None]) -> DataFrame:
    """``series_key, t`` and the columns that ``work`` makes of a series' values in order; null where it makes none.

    ``work`` gets all places, the missing ones bridged by lines so that the season stays in step; their rows have nulls.
    """
    ordered = F.sort_array(F.collect_list(F.struct("t", F.col("value").cast("double").alias("value"))))
    wide = series.groupBy("series_key").agg(ordered.alias("_p")).select("series_key", F.col("_p.t").alias("t"), F.col("_p.value").alias("y"))
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list[list]] = [[] for _ in names]
            for values in batch.column("y").to_pylist():
                known = np.array([v is not None and np.isfinite(v) for v in values], dtype=bool)
                filled = smoothing.interpolated(np.array([v if k else 0.0 for v, k in zip(values, known, strict=True)]), known)
                found = (work(filled) if known.any() else None) or {}
                for into, name in zip(made, names, strict=True):
                    out = np.full(len(values), None, dtype=object)
                    if name in found:
                        out[known] = found[name][known].tolist()
                    into.append(out.tolist())
            arrays = [pa.array(m, pa.list_(pa.bool_() if columns[n] == "boolean" else pa.float64())) for m, n in zip(made, names, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("series_key"), batch.column("t"), *arrays], ["series_key", "t", *names])

    schema = f"series_key string, t array<{dict(series.dtypes)['t']}>, " + ", ".join(f"{n} array<{kind}>" for n, kind in columns.items())
    zipped = wide.mapInArrow(run, schema).select("series_key", F.explode(F.arrays_zip("t", *names)).alias("_r"))
    return zipped.select("series_key", "_r.t", *[f"_r.{n}" for n in names])


def stl(series: DataFrame, season: int, seasonal_span: int = 11, trend_span: int | None = None, inner: int = 2, outer: int = 0) -> DataFrame:
    """``series_key, t, value, seasonal, trend, remainder, weight``; see :func:`smoothing.decompose`.

    A series shorter than two seasons has no season: its parts are null. Missing values are bridged by lines and
    have null parts.
    """

    def work(y: np.ndarray) -> dict[str, np.ndarray] | None:
        if len(y) < 2 * season:
            return None
        seasonal, trend, robust = smoothing.decompose(y, season, seasonal_span, trend_span, inner, outer)
        return {"seasonal": seasonal, "trend": trend, "remainder": y - seasonal - trend, "weight": robust}

    parts = _by_series(series, dict.fromkeys(("seasonal", "trend", "remainder", "weight"), "double"), work)
    return series.select("series_key", "t", "value").join(parts, ["series_key", "t"])


def seasonal_strength(series: DataFrame, season: int) -> DataFrame:
    """``series_key, strength``: how much of the variance around the trend the season explains, between 0 and 1.

    One less the variance of the remainder over that of remainder and season together, at least 0; null for a series
    without two seasons, 0 without spread.
    """
    parts = stl(series, season)
    whole = F.var_pop(F.col("remainder") + F.col("seasonal"))
    strength = F.greatest(F.lit(0.0), 1 - F.var_pop("remainder") / F.nullif(whole, F.lit(0.0)))
    both = parts.groupBy("series_key").agg(F.when(F.count("remainder") > 0, F.coalesce(strength, F.lit(0.0))).alias("strength"))
    return both


def clean_by_decomposition(
    series: DataFrame, season: int = 1, lambdas: DataFrame | None = None, fence: float = 3.0, strong: float = 0.6
) -> DataFrame:
    """Replace outliers; adds ``cleaned`` and ``is_outlier``, like ``smooth.clean_series`` but by decomposition.

    On the power-transformed scale (``lambdas``: series_key, lam; identity without): if the series holds two seasons, they
    are found robustly and taken off where they explain ``strong`` or more of the variance around the trend. The trend of
    the rest is a smooth of variable span. A remainder beyond the quartiles by ``fence`` interquartile ranges is an outlier;
    it is replaced by the line between its good neighbours, season put back. Missing values stay missing.
    """

    def work(z: np.ndarray) -> dict[str, np.ndarray] | None:
        if len(z) < 3:
            return {"is_outlier": np.zeros(len(z), dtype=bool), "filled": z}
        seasonal = np.zeros(len(z))
        if season > 1 and len(z) > 2 * season:
            found, trend, _ = smoothing.decompose(z, season, inner=1, outer=ROBUST)
            around = z - trend
            if around.var() > 0 and 1 - (around - found).var() / around.var() >= strong:
                seasonal = found
        flat = z - seasonal
        rest = flat - smoothing.variable_span(flat)
        q1, q3 = np.quantile(rest, [0.25, 0.75])
        reach = fence * (q3 - q1)
        spread = q3 - q1 > 1e-9 * np.abs(z).max()  # else the remainder is rounding
        bad = (rest < q1 - reach) | (rest > q3 + reach) if spread else np.zeros(len(z), dtype=bool)
        return {"is_outlier": bad, "filled": smoothing.interpolated(flat, ~bad) + seasonal}

    if lambdas is None:
        scaled = series.withColumn("_lam", F.lit(1.0))
    else:
        scaled = series.join(lambdas.select("series_key", F.col("lam").alias("_lam")), "series_key", "left").withColumn("_lam", F.coalesce("_lam", F.lit(1.0)))
    z = F.when(F.col("_lam") == 1, F.col("value").cast("double")).otherwise(boxcox(F.col("value"), F.col("_lam")))
    parts = _by_series(scaled.select("series_key", "t", z.alias("value")), {"is_outlier": "boolean", "filled": "double"}, work)
    joined = scaled.join(parts, ["series_key", "t"])
    back = F.when(F.col("_lam") == 1, F.col("filled")).otherwise(inverse_boxcox(F.col("filled"), F.col("_lam")))
    flag = F.coalesce("is_outlier", F.lit(False))
    return joined.select(*series.columns, flag.alias("is_outlier"), F.when(flag, back).otherwise(F.col("value")).alias("cleaned"))
