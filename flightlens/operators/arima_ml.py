"""Seasonal ARIMA by maximum likelihood: fit, standard errors, information criteria, forecast intervals.

A series is one row that holds its values as an array, at most one value per calendar day. Series are dealt over the tasks by
key; inside a task numpy handles one series after the other, and for each series all trial parameters side by side.

Model, for orders ``(p, d, q)``, ``(P, D, Q)`` and season length ``S``: with x the series differenced ``d`` times at lag 1
and ``D`` times at lag ``S``, less its mean m where the model has a constant,

    (1 - ar(B)) (1 - sar(B^S)) x[t] = (1 + ma(B)) (1 + sma(B^S)) e[t],    e[t] independent, normal, variance sigma2.

The likelihood is exact: autocovariances follow from the two polynomials, and the recursion of Durbin and Levinson turns them
into one-step errors and their variances v[t] (in units of sigma2). Concentrated over sigma2 it is a sum of squares of
``e / sqrt(v)`` times the geometric mean of ``sqrt(v)``, so it is minimised by damped least squares. Coefficients are varied by
way of partial autocorrelations, which keeps both polynomials stationary and invertible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from flightlens.functions.scalars import log_positive
from flightlens.operators.sarima import Sarima, forecast
from flightlens.operators.series import as_arrays

STEADY = 1e-10  # excess of the error variance over its limit from which on it is taken as the limit
STEP = 1e-5  # for slopes by central differences
ROUNDS = 100
DAMPING = 10.0 ** np.arange(-6, 5, 2)

_FITTED = T.StructType(
    [
        *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("x", "e", "coefficients", "errors", "ar", "ma")],
        *[T.StructField(c, T.DoubleType()) for c in ("mean", "constant", "sigma2", "loglik", "aic", "aicc", "bic")],
        T.StructField("used", T.IntegerType()),
        T.StructField("converged", T.BooleanType()),
    ]
)


def coefficient_names(model: Sarima) -> list[str]:
    """What the entries of ``coefficients`` and ``errors`` are, in order."""
    p, q, sp, sq = model.order[0], model.order[2], model.seasonal[0], model.seasonal[2]
    names = [f"{kind}_{i}" for kind, n in (("ar", p), ("ma", q), ("sar", sp), ("sma", sq)) for i in range(1, n + 1)]
    return [*names, "mean"] if model.constant else names


class Shape:
    """Where the parameters of a model lie, and the polynomials they make; parameters are rows of a matrix."""

    def __init__(self, model: Sarima):
        self.model, self.season = model, model.season
        sizes = (model.order[0], model.order[2], model.seasonal[0], model.seasonal[2])
        ends = np.cumsum(sizes).tolist()
        self.ar, self.ma, self.sar, self.sma = (slice(e - n, e) for e, n in zip(ends, sizes, strict=True))
        self.size = ends[-1] + model.constant
        self.blocks = [b for b in (self.ar, self.ma, self.sar, self.sma) if b.stop > b.start]

    def lag_weights(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the past of x and e, lag 1 first, of the multiplied polynomials."""
        return -self._times(-c[:, self.ar], -c[:, self.sar]), self._times(c[:, self.ma], c[:, self.sma])

    def _times(self, plain: np.ndarray, seasonal: np.ndarray) -> np.ndarray:
        s = self.season
        out = np.zeros((len(plain), plain.shape[1] + s * seasonal.shape[1] + 1))
        for j in range(seasonal.shape[1] + 1):
            weight = seasonal[:, j - 1 : j] if j else np.ones((len(plain), 1))
            out[:, s * j : s * j + 1] += weight
            out[:, s * j + 1 : s * j + 1 + plain.shape[1]] += weight * plain
        return out[:, 1:]

    def natural(self, u: np.ndarray) -> np.ndarray:
        """Coefficients from free numbers: their hyperbolic tangents are partial autocorrelations."""
        c = u.copy()
        for block in self.blocks:
            sign = -1.0 if block in (self.ma, self.sma) else 1.0
            partial = np.tanh(u[:, block])
            made = np.zeros_like(partial)
            for k in range(partial.shape[1]):
                made[:, :k] = made[:, :k] - partial[:, k : k + 1] * made[:, :k][:, ::-1]
                made[:, k] = partial[:, k]
            c[:, block] = sign * made
        return c


def differenced(y: np.ndarray, model: Sarima) -> np.ndarray:
    for lag in model.difference_lags:
        y = y[lag:] - y[:-lag] if len(y) > lag else y[:0]
    return y


def autocovariances(ar: np.ndarray, ma: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` autocovariances of unit-variance processes, one per row of lag weights."""
    rows, m, q = len(ar), ar.shape[1], ma.shape[1]
    theta = np.concatenate([np.ones((rows, 1)), ma], axis=1)
    psi = np.zeros((rows, q + 1))
    for j in range(q + 1):
        psi[:, j] = theta[:, j] + sum((ar[:, i] * psi[:, j - 1 - i] for i in range(min(m, j))), np.zeros(rows))
    driven = np.stack([(theta[:, k:] * psi[:, : q + 1 - k]).sum(1) for k in range(q + 1)], axis=1)
    weights = np.concatenate([np.ones((rows, 1)), -ar], axis=1)
    system = np.zeros((rows, m + 1, m + 1))
    for k in range(m + 1):
        for i in range(m + 1):
            system[:, k, abs(k - i)] += weights[:, i]
    right = np.zeros((rows, max(count, m + 1)))
    right[:, : q + 1] = driven[:, : right.shape[1]]
    out = np.zeros_like(right)
    out[:, : m + 1] = np.linalg.solve(system, right[:, : m + 1, None])[:, :, 0]
    back = ar[:, ::-1]
    for k in range(m + 1, count):
        out[:, k] = right[:, k] + (back * out[:, k - m : k]).sum(1)
    return out[:, :count]


def innovations(x: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-step errors and their variances (unit innovation variance), each (rows, n), exactly."""
    rows, n = x.shape
    m, q = ar.shape[1], ma.shape[1]
    gamma = autocovariances(ar, ma, n)
    e, v = np.empty((rows, n)), np.ones((rows, n))
    e[:, 0], v[:, 0] = x[:, 0], gamma[:, 0]
    phi = np.zeros((rows, 0))
    t = 1
    while t < n and (t <= max(m, q) or v[:, t - 1].max() - 1 > STEADY):
        last = (gamma[:, t] - (phi * gamma[:, t - 1 : 0 : -1]).sum(1)) / v[:, t - 1]
        phi = np.concatenate([phi - last[:, None] * phi[:, ::-1], last[:, None]], axis=1)
        v[:, t] = v[:, t - 1] * (1 - last * last)
        e[:, t] = x[:, t] - (phi * x[:, t - 1 :: -1][:, :t]).sum(1)
        t += 1
    if t < n:  # from here on the errors follow the model's own recursion
        w = x[:, t:].copy()
        for i in range(m):
            w -= ar[:, i : i + 1] * x[:, t - 1 - i : n - 1 - i]
        back = ma[:, ::-1]
        for k in range(t, n):
            e[:, k] = w[:, k - t] - (back * e[:, k - q : k]).sum(1) if q else w[:, k - t]
    return e, v


class Fit:
    """The likelihood of one differenced series under a model."""

    def __init__(self, x: np.ndarray, model: Sarima):
        self.x, self.shape, self.n = x, Shape(model), len(x)
        self.centre, self.spread = (float(x.mean()) if model.constant else 0.0), float(x.std()) or 1.0

    def errors(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (self.x - c[:, -1:]) if self.shape.model.constant else np.repeat(self.x[None], len(c), axis=0)
        return innovations(x, *self.shape.lag_weights(c))

    def scaled(self, c: np.ndarray) -> np.ndarray:
        """Numbers whose squares add up to what the likelihood falls with."""
        with np.errstate(all="ignore"):
            e, v = self.errors(c)
            return e / np.sqrt(v) * np.exp(np.log(v).mean(1) / 2)[:, None]

    def of_free(self, u: np.ndarray) -> np.ndarray:
        c = self.shape.natural(u)
        if self.shape.model.constant:
            c[:, -1] = self.centre + self.spread * u[:, -1]
        return c

    def slopes(self, at: np.ndarray, build) -> np.ndarray:
        steps = STEP * np.concatenate([np.eye(len(at)), -np.eye(len(at))])
        r = self.scaled(build(at + steps))
        return ((r[: len(at)] - r[len(at) :]) / (2 * STEP)).T

    def starts(self) -> list[np.ndarray]:
        """Two places to start from: sample partial autocorrelations for the autoregressive part, and a moving average."""
        x = self.x - self.centre
        size = float(x @ x) or 1.0
        r = lambda k: float(x[k:] @ x[: len(x) - k]) / size if k < len(x) else 0.0
        first, second = np.zeros(self.shape.size), np.zeros(self.shape.size)
        phi: list[float] = []
        v = 1.0
        for k in range(1, self.shape.ar.stop - self.shape.ar.start + 1):
            last = (r(k) - sum(p * r(k - 1 - i) for i, p in enumerate(phi))) / v
            phi, v = [p - last * b for p, b in zip(phi, phi[::-1], strict=True)] + [last], max(1e-3, v * (1 - last * last))
            first[self.shape.ar.start + k - 1] = np.arctanh(np.clip(last, -0.9, 0.9))
        for k in range(self.shape.sar.stop - self.shape.sar.start):
            first[self.shape.sar.start + k] = np.arctanh(np.clip(r(self.shape.season * (k + 1)), -0.9, 0.9))
        second[self.shape.ma] = np.arctanh(np.clip(-r(1), -0.9, 0.9)) if self.shape.ma.stop > self.shape.ma.start else 0
        second[self.shape.sma] = np.arctanh(np.clip(-r(self.shape.season), -0.9, 0.9)) if self.shape.sma.stop > self.shape.sma.start else 0
        return [first, second]

    def minimise(self, u: np.ndarray) -> tuple[float, np.ndarray, bool]:
        """Damped least squares; several dampings are tried at once and the best is taken."""
        r = self.scaled(self.of_free(u[None]))[0]
        best = float(r @ r)
        for _ in range(ROUNDS):
            j = self.slopes(u, self.of_free)
            if not np.isfinite(j).all() or not np.isfinite(best):
                return np.inf, u, False
            normal, slope = j.T @ j, j.T @ r
            scale = np.diag(np.diag(normal) + 1e-9 * best)
            trials = u - np.stack([np.linalg.lstsq(normal + d * scale, slope, rcond=None)[0] for d in DAMPING])
            trials = np.clip(trials, u - 2, u + 2)
            rs = self.scaled(self.of_free(trials))
            sums = np.where(np.isfinite(rs).all(1), (np.nan_to_num(rs) ** 2).sum(1), np.inf)
            k = int(np.argmin(sums))
            if sums[k] >= best * (1 - 1e-12):
                return best, u, True
            done = sums[k] > best * (1 - 1e-10)
            best, u, r = float(sums[k]), trials[k], rs[k]
            if done:
                return best, u, True
        return best, u, False

    def result(self) -> dict | None:
        """The fitted row; None if the series is too short or has no spread."""
        model, size = self.shape.model, self.shape.size
        if self.n <= size + 1 or not np.isfinite(self.x).all() or np.ptp(self.x) == 0:
            return None
        tries = [self.minimise(u) for u in self.starts()] if size else [(0.0, np.zeros(0), True)]
        _, u, converged = min(tries, key=lambda f: f[0])
        c = self.of_free(u[None])
        return self.described(c[0], converged) if np.isfinite(c).all() else None

    def described(self, c: np.ndarray, converged: bool = True) -> dict:
        """All that follows from coefficients: errors, variance, likelihood, criteria, standard errors."""
        model, size, n = self.shape.model, self.shape.size, self.n
        e, v = (a[0] for a in self.errors(c[None]))
        sigma2 = float((e * e / v).mean())
        loglik = -0.5 * (n * (np.log(2 * np.pi * sigma2) + 1) + np.log(v).sum())
        k = size + 1
        aic = 2 * k - 2 * loglik
        errors = [None] * size
        if size:
            r = self.scaled(c[None])[0]
            scale = np.ones(size)
            if model.constant:
                scale[-1] = self.spread
            j = self.slopes(np.zeros(size), lambda d: c + d * scale) / scale
            with np.errstate(all="ignore"):
                spread = np.linalg.pinv(j.T @ j, hermitian=True).diagonal() * (r @ r) / n if np.isfinite(j).all() else np.full(size, np.nan)
            errors = [float(np.sqrt(s)) if s > 0 else None for s in spread]
        ar, ma = (w[0] for w in self.shape.lag_weights(c[None]))
        mean = float(c[-1]) if model.constant else 0.0
        return {
            "x": self.x.tolist(), "e": e.tolist(), "coefficients": c.tolist(), "errors": errors,
            "ar": [float(ar[lag - 1]) for lag in model.ar_lags], "ma": [float(ma[lag - 1]) for lag in model.ma_lags],
            "mean": mean, "constant": mean * (1 - float(ar.sum())), "sigma2": sigma2, "loglik": float(loglik), "aic": float(aic),
            "aicc": float(aic + 2 * k * (k + 1) / (n - k - 1)) if n > k + 1 else None, "bic": float(aic + k * (np.log(n) - 2)),
            "used": n, "converged": bool(converged),
        }


def with_model(rows: DataFrame, model_of, solve) -> DataFrame:
    """Rows of series (a column ``y`` among others) with the fitted columns; null where nothing can be fitted.

    ``model_of(row)`` names the model of a row, ``solve(fit, row)`` turns a likelihood and the row into a result.
    """
    plain = [f for f in rows.schema]
    fitted = T.StructType([*plain, *_FITTED])
    names = [f.name for f in _FITTED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                model, y = model_of(row), row["y"]
                known = y is not None and all(v is not None and np.isfinite(v) for v in y)
                x = differenced(np.array(y, dtype=float), model) if known else np.zeros(0)
                made.append((solve(Fit(x, model), row) if len(x) else None) or {})
            columns = [pa.array([m.get(c) for m in made], types[c]) for c in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    types = {f.name: _ARROW[f.dataType.simpleString()] for f in _FITTED}
    return rows.mapInArrow(run, fitted)


_ARROW = {"array<double>": pa.list_(pa.float64()), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}


def arrays_for(series: DataFrame, log: bool) -> DataFrame:
    """(series_key, n, y): one row per series, dealt by key so that neighbours in size do not share a task."""
    values = F.transform("y", log_positive) if log else F.col("y")
    return as_arrays(series).select("series_key", F.size("y").alias("n"), values.alias("y"))


def fit(series: DataFrame, model: Sarima) -> DataFrame:
    """One row per series: ``series_key, n, y`` and the columns of the fit.

    ``coefficients`` and ``errors`` (standard errors) follow :func:`coefficient_names`; ``ar``, ``ma``, ``constant`` are the
    multiplied polynomials in the form that :func:`forecast` reads. A series that is too short, has no spread or misses a
    value has nulls there. Not ``converged``: the likelihood still rose when the rounds were over.
    """
    return with_model(arrays_for(series, model.log), lambda row: model, lambda f, row: f.result())


def at_coefficients(series: DataFrame, model: Sarima, coefficients: list[float]) -> DataFrame:
    """The columns of :func:`fit` for given coefficients instead of the best ones."""
    given = np.array(coefficients, dtype=float)
    return with_model(arrays_for(series, model.log), lambda row: model, lambda f, row: f.described(given))


def psi_weights(model: Sarima, ar: Column, ma: Column, horizon: int) -> Column:
    """The first ``horizon`` weights of past errors in the undifferenced series, from weights at ``ar_lags`` and ``ma_lags``."""
    undo = model.difference_weights()
    # the autoregression of the undifferenced series: the product of both polynomials, as lag -> sum of columns
    whole: dict[int, Column] = {}
    for d, weight in {0: 1, **undo}.items():
        for lag, value in {0: F.lit(-1.0), **{lag: F.get(ar, F.lit(i)) for i, lag in enumerate(model.ar_lags)}}.items():
            if lag + d:
                whole[lag + d] = whole.get(lag + d, F.lit(0.0)) + weight * value
    moving = {lag: F.get(ma, F.lit(i)) for i, lag in enumerate(model.ma_lags)}

    def step(psi: Column, j: Column) -> Column:
        value = F.lit(0.0)
        for lag, weight in moving.items():
            value = value + F.when(j == lag, weight).otherwise(0.0)
        for lag, weight in whole.items():
            value = value + weight * F.coalesce(F.get(psi, j - lag), F.lit(0.0))
        return F.concat(psi, F.array(value))

    first = F.array(F.lit(1.0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(horizon - 1)), first, step) if horizon > 1 else first


def forecast_intervals(fitted: DataFrame, model: Sarima, horizon: int, width: float = 1.959963984540054) -> DataFrame:
    """``series_key, t, value, se, low, high``: forecasts, their standard errors and normal intervals; t counts from 1.

    The error variance ``h`` days ahead is ``sigma2`` times the sum of the first ``h`` squared psi weights. With a log model
    ``se`` is on the log scale and the interval is that of the log, taken back.
    """
    points = forecast(fitted, model, horizon)
    variance = F.transform(
        F.sequence(F.lit(1), F.lit(horizon)),
        lambda h: F.aggregate(F.slice("_psi", F.lit(1), h), F.lit(0.0), lambda s, w: s + w * w),
    )
    psi = fitted.select("series_key", "sigma2", psi_weights(model, F.col("ar"), F.col("ma"), horizon).alias("_psi"))
    spread = psi.select("series_key", "sigma2", F.posexplode(variance).alias("_h", "_v"))
    errors = spread.select("series_key", (F.col("_h") + 1).alias("t"), F.sqrt(F.col("sigma2") * F.col("_v")).alias("se"))
    joined = points.join(errors, ["series_key", "t"])
    if model.log:
        return joined.withColumns({"low": F.col("value") * F.exp(-width * F.col("se")), "high": F.col("value") * F.exp(width * F.col("se"))})
    return joined.withColumns({"low": F.col("value") - width * F.col("se"), "high": F.col("value") + width * F.col("se")})
