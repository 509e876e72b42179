"""Seasonal ARIMA for many daily series at once, by two-stage least squares.

Each series is one row holding its values as an array; a series has at most one value per calendar day.
All steps are column expressions on that row, so the only shuffle is the one that gathers the series.

Definition, for orders ``(p, d, q)``, seasonal orders ``(P, D, Q)`` and season length ``S``:

1. ``x`` is the series (or its log) differenced ``d`` times at lag 1 and ``D`` times at lag ``S``. With a
   constant the mean of x is taken off. Unless told otherwise, a constant is used when ``d + D < 2``.
2. If ``q`` or ``Q`` is positive, a long autoregression from the autocorrelations of x (Durbin-Levinson)
   gives innovations ``e``.
3. Least squares of ``x[t]`` on ``x`` at lags ``i + S*I`` (``i <= p``, ``I <= P``) and ``e`` at lags
   ``j + S*J`` (``j <= q``, ``J <= Q``), lag 0 left out. Coefficients at product lags are free.
4. Forecasts run the recursion with future innovations zero and undo the differences.

These are estimates by a definition of their own, not maximum likelihood.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flightlens.functions.linalg import dot, let, solve
from flightlens.functions.scalars import log_positive
from flightlens.operators.correlation import autocorrelations, levinson, mean, positive
from flightlens.operators.series import as_arrays, lagged


def _lags(order: int, seasonal: int, season: int) -> list[int]:
    return sorted({i + season * j for i in range(order + 1) for j in range(seasonal + 1)} - {0})


@dataclass(frozen=True)
class Sarima:
    order: tuple[int, int, int]
    seasonal: tuple[int, int, int]
    season: int
    log: bool = False
    with_constant: bool | None = None

    @property
    def ar_lags(self) -> list[int]:
        return _lags(self.order[0], self.seasonal[0], self.season)

    @property
    def ma_lags(self) -> list[int]:
        return _lags(self.order[2], self.seasonal[2], self.season)

    @property
    def difference_lags(self) -> list[int]:
        return [1] * self.order[1] + [self.season] * self.seasonal[1]

    @property
    def constant(self) -> bool:
        return len(self.difference_lags) < 2 if self.with_constant is None else self.with_constant

    @property
    def long_order(self) -> int:
        return max(self.ar_lags + self.ma_lags) + 3

    def difference_weights(self) -> dict[int, int]:
        """Lag to weight of the product of all differences, lag 0 left out."""
        weights = {0: 1}
        for lag in self.difference_lags:
            shifted = dict(weights)
            for at, weight in weights.items():
                shifted[at + lag] = shifted.get(at + lag, 0) - weight
            weights = shifted
        return {at: weight for at, weight in weights.items() if at and weight}


def fit(series: DataFrame, model: Sarima) -> DataFrame:
    """One row per series: ``series_key, n, constant, ar, ma`` and the state ``y, x, e`` to forecast from.

    ``ar`` and ``ma`` follow ``model.ar_lags`` and ``model.ma_lags``. A series too short or too regular to
    solve has null coefficients.
    """
    values = F.transform("y", log_positive) if model.log else F.col("y")
    wide = as_arrays(series).select("series_key", values.alias("y"))
    return wide.select("series_key", F.size("y").alias("n"), "y", _estimate(F.col("y"), model).alias("_m")).select(
        "series_key", "n", "y", "_m.*"
    )


def _estimate(y: Column, model: Sarima) -> Column:
    def differenced(values: Column, lags: list[int]) -> Column:
        if not lags:
            return values
        return let(lagged(values, lags[0]), lambda rest: differenced(rest, lags[1:]))

    def standardise(x: Column) -> Column:
        centre = mean(x) if model.constant else F.lit(0.0)
        return let(
            centre,
            lambda m: let(
                F.transform(x, lambda v: v - m),
                lambda c: let(
                    F.coalesce(positive(F.sqrt(dot(c, c) / F.nullif(F.size(c), F.lit(0)))), F.lit(1.0)),
                    lambda s: let(F.transform(c, lambda v: v / s), lambda z: regress(x, m, s, z)),
                ),
            ),
        )

    def regress(x: Column, m: Column, s: Column, z: Column) -> Column:
        return let(_innovations(z, model), lambda e: let(_coefficients(z, e, model), lambda b: result(x, m, s, e, b)))

    def result(x: Column, m: Column, s: Column, e: Column, b: Column) -> Column:
        first = 1 if model.constant else 0
        n_ar, n_ma = len(model.ar_lags), len(model.ma_lags)
        ar = F.slice(b, first + 1, n_ar)
        level = F.get(b, F.lit(0)) * s + m * (1 - F.aggregate(ar, F.lit(0.0), lambda acc, v: acc + v))
        return F.struct(
            x.alias("x"),
            F.transform(e, lambda v: v * s).alias("e"),
            (level if model.constant else F.lit(0.0)).alias("constant"),
            ar.alias("ar"),
            F.slice(b, first + n_ar + 1, n_ma).alias("ma"),
        )

    return let(y, lambda values: let(differenced(values, model.difference_lags), standardise))


def _innovations(z: Column, model: Sarima) -> Column:
    """Residuals of the long autoregression, null where it has no full past; all null if not needed."""
    unknown = F.lit(None).cast("double")
    if not model.ma_lags:
        return F.transform(z, lambda v: unknown)
    order = model.long_order

    def residuals(phi: Column) -> Column:
        def at(v: Column, i: Column) -> Column:
            past = F.reverse(F.slice(z, i - order + 1, F.lit(order)))
            return F.when(i >= order, v - dot(phi, past))

        return F.transform(z, at)

    # too short for the long autoregression: no innovations, hence no coefficients
    return F.when(
        F.size(z) > 2 * order,
        let(let(autocorrelations(z, order), lambda r: levinson(r)["phi"]), residuals),
    ).otherwise(F.transform(z, lambda v: unknown))


def _coefficients(z: Column, e: Column, model: Sarima) -> Column:
    ar, ma = model.ar_lags, model.ma_lags
    size = len(ar) + len(ma) + (1 if model.constant else 0)
    if size == 0:
        return F.array().cast("array<double>")
    start = max(ar + [lag + (model.long_order if ma else 0) for lag in ma] + [0])
    one = [F.lit(1.0)] if model.constant else []

    def design(t: Column) -> Column:
        past = [F.get(z, t - lag) for lag in ar] + [F.get(e, t - lag) for lag in ma]
        return F.array(*one, *past, F.get(z, t))

    times = F.filter(F.sequence(F.lit(start), F.greatest(F.size(z), F.lit(start))), lambda t: t < F.size(z))

    def moments(rows: Column) -> Column:
        def product(i: Column, j: Column) -> Column:
            pairs = F.aggregate(
                rows, F.lit(0.0), lambda acc, row: acc + F.element_at(row, i) * F.element_at(row, j)
            )
            return pairs / F.nullif(F.size(rows), F.lit(0))

        return F.transform(
            F.sequence(F.lit(1), F.lit(size)),
            lambda i: F.transform(F.sequence(F.lit(1), F.lit(size + 1)), lambda j: product(i, j)),
        )

    def solved(rows: Column) -> Column:
        unknown = F.array_repeat(F.lit(None).cast("double"), size)
        return F.when(F.size(rows) > size, solve(moments(rows), size, tolerance=1e-9)).otherwise(unknown)

    return let(F.transform(times, design), solved)


def forecast(fitted: DataFrame, model: Sarima, horizon: int) -> DataFrame:
    """``series_key, t, value`` for the ``horizon`` positions after the end; t counts from 1."""
    undo = model.difference_weights()

    def weighted(lags: list[int], weights: Column, history: Column) -> list[Column]:
        return [F.get(weights, F.lit(i)) * F.try_element_at(history, F.lit(-lag)) for i, lag in enumerate(lags)]

    def step(state: Column, _: Column) -> Column:
        change = F.col("constant")
        for part in weighted(model.ar_lags, F.col("ar"), state["x"]) + weighted(model.ma_lags, F.col("ma"), state["e"]):
            change = change + part

        def advance(x: Column) -> Column:
            level = x
            for lag, weight in undo.items():
                level = level - weight * F.try_element_at(state["y"], F.lit(-lag))
            return F.struct(
                F.concat(state["y"], F.array(level)).alias("y"),
                F.concat(state["x"], F.array(x)).alias("x"),
                F.concat(state["e"], F.array(F.lit(0.0))).alias("e"),
            )

        return let(change, advance)

    def tail(name: str, length: int) -> Column:
        keep = F.least(F.size(name), F.lit(max(length, 1)))
        return F.slice(name, F.size(name) - keep + 1, keep)

    start = F.struct(
        tail("y", max(undo, default=1)).alias("y"),
        tail("x", max(model.ar_lags, default=1)).alias("x"),
        tail("e", max(model.ma_lags, default=1)).alias("e"),
    )
    steps = F.sequence(F.lit(1), F.lit(horizon))
    path = F.aggregate(steps, start, step, lambda state: F.slice(state["y"], -horizon, horizon))
    rows = fitted.select("series_key", F.posexplode(path).alias("_h", "value"))
    value = F.exp("value") if model.log else F.col("value")
    return rows.select("series_key", (F.col("_h") + 1).alias("t"), value.alias("value"))
