"""Smooth trends with standard errors: nearest-neighbour local regression, and a penalised spline for long series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flightlens.functions import local_fit

POINTS = 80
SPAN = 0.75
KNOTS = 10
# Penalties tried, relative to the size of the normal matrix.
PENALTIES = 10.0 ** np.arange(-10, 4.01, 0.25)
LONG = 1000  # observations in the longest series from which on the spline takes over
CURVE = "at array<double>, fit array<double>, error array<double>, sigma double, freedom double"


def _spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per place of the curve; a place without a finite fit has null, as has an error that is not finite."""
    zipped = df.select(*keys, "sigma", "freedom", F.explode(F.arrays_zip("at", "fit", "error")).alias("_r"))
    known = lambda c: F.when(~F.isnan(c), c)
    return zipped.select(
        *keys, F.col("_r.at").alias("x"), known(F.col("_r.fit")).alias("trend"), known(F.col("_r.error")).alias("error"),
        known(F.col("sigma")).alias("sigma"), "freedom",
    )


def _curves(wide: DataFrame, keys: list[str], work) -> DataFrame:
    """``work`` on every row but its keys (as Python values); rows it makes nothing of are left out."""
    kinds = dict(wide.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], CURVE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs = batch.select([c for c in batch.schema.names if c not in keys]).to_pylist()
            made = [work(**row) for row in inputs]
            good = [i for i, m in enumerate(made) if m is not None]
            ids = [batch.column(k).take(pa.array(good, pa.int64())) for k in keys]
            lists = [pa.array([made[i][n].tolist() for i in good], pa.list_(pa.float64())) for n in ("at", "fit", "error")]
            single = [pa.array([float(made[i][n]) for i in good], pa.float64()) for n in ("sigma", "freedom")]
            yield pa.RecordBatch.from_arrays([*ids, *lists, *single], [*keys, "at", "fit", "error", "sigma", "freedom"])

    return _spread(wide.mapInArrow(run, schema), keys)


def _usable(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.filter(finite(px) & finite(py)).select(*keys, px.alias("_x"), py.alias("_y"))


def loess(daily: DataFrame, keys: list[str], x: str, y: str, span: float = SPAN, points: int = POINTS) -> DataFrame:
    """``keys, x, trend, error, sigma, freedom``: local quadratics over the nearest ``span`` of a series' observations.

    The curve is taken at ``points`` places from the first to the last x; see ``functions.local_fit.loess``. A series is one
    row with two arrays, so this takes a daily table: at most one observation per calendar day; time grows with their
    square, memory does not. Longer series belong to :func:`spline`. Nulls and values that are not finite take no part; a series
    whose neighbourhoods hold fewer than three distinct x has no rows.
    """
    if not 0 < span <= 1:
        raise ValueError("span must lie above 0 and at most at 1")
    ordered = F.sort_array(F.collect_list(F.struct("_x", "_y")))
    wide = _usable(daily, keys, x, y).groupBy(*keys).agg(ordered.alias("_p"))
    wide = wide.select(*keys, F.col("_p._x").alias("xs"), F.col("_p._y").alias("ys"))
    return _curves(wide, keys, lambda xs, ys: local_fit.loess(np.array(xs), np.array(ys), span, points))


# --- spline ---


def _basis(u, knots: np.ndarray, positive) -> list:
    """Natural cubic spline functions of ``u`` in 0..1, numbers or columns: constant, line, and one per inner knot."""
    last, before = knots[-1], knots[-2]

    def bent(k: float):
        cube = lambda v: v * v * v
        return (cube(positive(u - float(k))) - cube(positive(u - float(last)))) / float(last - k)

    return [u * 0 + 1.0, u, *[bent(k) - bent(before) for k in knots[:-2]]]


def basis_values(u: np.ndarray, knots: np.ndarray) -> np.ndarray:
    return np.stack(_basis(u, knots, lambda v: np.clip(v, 0, None)), axis=1)


def curvature(knots: np.ndarray) -> np.ndarray:
    """Integral of the products of second derivatives, which are lines between knots."""
    second = np.zeros((len(knots), len(knots)))  # row: knot, column: function
    for j, k in enumerate(knots[:-2]):
        for at, value in enumerate(knots):
            high = np.clip(value - k, 0, None) / (knots[-1] - k)
            low = np.clip(value - knots[-2], 0, None) / (knots[-1] - knots[-2])
            second[at, j + 2] = 6 * (high - low)
    total = np.zeros_like(second)
    for left, right, width in zip(second[:-1], second[1:], np.diff(knots), strict=True):
        both = np.outer(left, left) + np.outer(right, right)
        total += width / 6 * (2 * both + np.outer(left, right) + np.outer(right, left))
    return total


def penalised(normal: np.ndarray, right: np.ndarray, square: float, n: float, penalty: np.ndarray):
    """Coefficients, their covariance over sigma squared, residual sum of squares and freedom, by generalised
    cross-validation over ``PENALTIES``."""
    # whitened by the normal matrix, penalties are a diagonal: one decomposition serves all of them
    root = np.linalg.cholesky(normal)
    half = np.linalg.solve(root, np.linalg.solve(root, penalty).T)
    values, vectors = np.linalg.eigh((half + half.T) / 2)
    values = np.clip(values, 0, None)
    seen = vectors.T @ np.linalg.solve(root, right)
    scale = np.trace(normal) / np.trace(penalty)
    best = None
    for strength in PENALTIES * scale:
        kept = 1 / (1 + strength * values)
        left = max(square - float((seen * seen * (2 * kept - kept * kept)).sum()), 0.0)
        used = float(kept.sum())
        score = n * left / (n - used) ** 2
        if best is None or score < best[0]:
            best = score, kept, left, n - used
    _, kept, left, freedom = best
    turned = np.linalg.solve(root.T, vectors)
    return turned @ (kept * seen), (turned * kept) @ turned.T, left, freedom


def spline(df: DataFrame, keys: list[str], x: str, y: str, knots: int = KNOTS, points: int = POINTS) -> DataFrame:
    """``keys, x, trend, error, sigma, freedom``: penalised cubic regression spline, natural at both ends.

    Knots lie evenly between the first and last x of a series. The penalty on its curvature is chosen by generalised
    cross-validation; the error is that of the Bayesian covariance. Observations are first summed per x, then into the normal
    equations, both combined before the shuffle, so a series may have any number of observations; only matrices of
    ``knots`` squared reach the solver. A series with no more distinct x than knots has no rows, nor has one whose x leave
    the knots undetermined. Nulls and values that are not finite take no part.
    """
    grid = np.linspace(0.0, 1.0, knots)
    cells = _usable(df, keys, x, y).groupBy(*keys, "_x").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_sy"), F.sum(F.col("_y") * F.col("_y")).alias("_syy")
    )
    ends = cells.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), (F.sum("_sy") / F.sum("_n")).alias("_mean"), F.count(F.lit(1)).alias("_places")
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    m, n, sy = F.col("_mean"), F.col("_n"), F.col("_sy")
    cells = cells.join(ends.filter(F.col("_places") > knots), same).withColumns(
        {"_u": (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), "_c": sy - n * m, "_cc": F.col("_syy") - 2 * m * sy + n * m * m}
    )
    columns: list[Column] = _basis(F.col("_u"), grid, lambda v: F.greatest(v, F.lit(0.0)))
    cells = cells.withColumns({f"_b{i}": c for i, c in enumerate(columns)})
    pairs = [(i, j) for i in range(knots) for j in range(i + 1)]
    sums = cells.groupBy(*keys, "_lo", "_hi", "_mean").agg(
        F.sum("_n").cast("double").alias("n"), F.sum("_cc").alias("square"),
        *[F.sum(n * F.col(f"_b{i}") * F.col(f"_b{j}")).alias(f"_m{i}_{j}") for i, j in pairs],
        *[F.sum(F.col("_c") * F.col(f"_b{i}")).alias(f"_r{i}") for i in range(knots)],
    )
    wide = sums.select(
        *keys, "n", "square", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_mean").alias("mean"),
        F.array(*[f"_m{i}_{j}" for i, j in pairs]).alias("lower"), F.array(*[f"_r{i}" for i in range(knots)]).alias("right"),
    )
    penalty, shown = curvature(grid), basis_values(np.linspace(0.0, 1.0, points), grid)

    def work(n, square, lo, hi, mean, lower, right):
        normal = np.zeros((knots, knots))
        normal[np.tril_indices(knots)] = lower
        normal += np.tril(normal, -1).T
        try:
            found, covariance, left, freedom = penalised(normal, np.array(right), square, n, penalty)
        except np.linalg.LinAlgError:
            return None
        sigma = float(np.sqrt(left / freedom))
        error = sigma * np.sqrt(np.einsum("pi,ij,pj->p", shown, covariance, shown))
        at = lo + (hi - lo) * np.arange(points) / max(1, points - 1)
        return {"at": at, "fit": mean + shown @ found, "error": error, "sigma": sigma, "freedom": freedom}

    return _curves(wide, keys, work)


def smooth_trend(daily: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """:func:`loess` if the longest series has fewer than 1000 observations, else :func:`spline`, for all series alike.

    Counts the observations of the longest series first, one job over ``daily``.
    """
    longest = _usable(daily, keys, x, y).groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return loess(daily, keys, x, y) if longest < LONG else spline(daily, keys, x, y)
