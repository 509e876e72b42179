"""Likelihood fit, standard errors, intervals and diagnostics of seasonal ARIMA against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightlens.operators import arima_ml, diagnostics, order_search, sarima
from flightlens.operators.sarima import Sarima


def simulate(rng, n, ar=(), ma=(), sar=(), sma=(), season=7, mean=0.0, sigma=1.0, d=0, sd=0, warm=400):
    """A series from the recursion of the multiplied polynomials."""
    model = Sarima((len(ar), 0, len(ma)), (len(sar), 0, len(sma)), season)
    weights = arima_ml.Shape(model).lag_weights(np.array([[*ar, *ma, *sar, *sma, 0.0]]))
    a, b = weights[0][0], weights[1][0]
    e = rng.normal(0, sigma, n + warm)
    x = np.zeros(n + warm)
    for t in range(n + warm):
        x[t] = e[t] + sum(w * x[t - 1 - i] for i, w in enumerate(a[:t])) + sum(w * e[t - 1 - i] for i, w in enumerate(b[:t]))
    y = x[warm:] + mean
    for _ in range(d):
        y = np.cumsum(y)
    for _ in range(sd):
        y = np.array([y[t::-season].sum() for t in range(n)])
    return y


@pytest.fixture(scope="module")
def frame(spark):
    def build(**series):
        rows = [(k, t + 1, float(v)) for k, y in series.items() for t, v in enumerate(y)]
        return spark.createDataFrame(rows, "series_key string, t int, value double")

    return build


def dense_loglik(x, ar, ma):
    """Gaussian log-likelihood at the best variance, from the whole covariance matrix of a long moving average."""
    n, m = len(x), 3000
    psi = np.zeros(m)
    theta = [1.0, *ma]
    for j in range(m):
        psi[j] = (theta[j] if j < len(theta) else 0) + sum(a * psi[j - 1 - i] for i, a in enumerate(ar[:j]))
    gamma = np.array([psi[k:] @ psi[: m - k] for k in range(n)])
    cov = gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    sigma2 = x @ np.linalg.solve(cov, x) / n
    return -0.5 * (n * (np.log(2 * np.pi * sigma2) + 1) + np.linalg.slogdet(cov)[1]), sigma2


@pytest.mark.parametrize(("order", "seasonal", "given"), [
    ((2, 0, 0), (0, 0, 0), [0.5, -0.3]), ((0, 0, 2), (0, 0, 0), [0.6, 0.2]), ((1, 0, 1), (0, 0, 0), [0.7, -0.4]),
    ((1, 0, 1), (1, 0, 1), [0.3, 0.4, 0.5, -0.6]), ((0, 0, 0), (0, 0, 0), []),
])
def test_likelihood_like_the_dense_matrix(order, seasonal, given):
    x = np.random.default_rng(1).normal(size=80).cumsum() * 0.2
    model = Sarima(order, seasonal, 4, with_constant=False)
    got = arima_ml.Fit(x, model).described(np.array(given))
    ar, ma = (w[0].tolist() for w in arima_ml.Shape(model).lag_weights(np.array([given])))
    loglik, sigma2 = dense_loglik(x, ar, ma)
    assert got["loglik"] == pytest.approx(loglik, abs=1e-7) and got["sigma2"] == pytest.approx(sigma2, rel=1e-8)


def test_fit_finds_planted_coefficients(spark, frame):
    rng = np.random.default_rng(2)
    cases = {
        "ar": (Sarima((2, 0, 0), (0, 0, 0), 7), dict(ar=(0.5, -0.3), mean=4.0)),
        "arma": (Sarima((1, 1, 1), (0, 0, 0), 7), dict(ar=(0.6,), ma=(0.5,), d=1)),
        "seasonal": (Sarima((1, 0, 1), (1, 0, 0), 7), dict(ar=(0.4,), ma=(0.3,), sar=(0.6,), mean=-2.0)),
        "airline": (Sarima((0, 1, 1), (0, 1, 1), 7), dict(ma=(-0.4,), sma=(-0.6,), d=1, sd=1)),
    }
    for name, (model, planted) in cases.items():
        many = {f"{name}{k}": simulate(rng, 600, **planted) for k in range(3)}
        table = frame(**many)
        truth = [*planted.get("ar", ()), *planted.get("ma", ()), *planted.get("sar", ()), *planted.get("sma", ())]
        two_stage = {r.series_key: r for r in sarima.fit(table, model).collect()}
        for r in arima_ml.fit(table, model).collect():
            assert r.converged and len(r.coefficients) == len(arima_ml.coefficient_names(model))
            for got, want, error in zip(r.coefficients, truth, r.errors, strict=False):
                assert abs(got - want) < 4 * error and error < 0.15
            assert r.sigma2 == pytest.approx(1, abs=0.25)
            other = arima_ml.Fit(np.array(r.x), model)
            plain = two_stage[r.series_key]
            if plain.ar is not None and None not in [*plain.ar, *plain.ma] and model.season not in [*model.ar_lags, *model.ma_lags]:
                mean = plain.constant / (1 - sum(plain.ar)) if model.constant else None
                at = other.described(np.array([*plain.ar, *plain.ma, *([mean] if model.constant else [])]))
                assert r.loglik >= at["loglik"] - 1e-6
            around = [other.described(np.array(r.coefficients) + step)["loglik"] for step in 0.01 * np.eye(len(r.coefficients))]
            assert max(around) < r.loglik


def test_criteria_and_forecast_columns(spark, frame):
    model = Sarima((1, 1, 1), (1, 0, 0), 5)
    y = simulate(np.random.default_rng(3), 250, ar=(0.5,), ma=(0.2,), sar=(0.4,), season=5, d=1)
    r = arima_ml.fit(frame(a=y), model).collect()[0]
    k = len(r.coefficients) + 1
    assert (r.n, r.used) == (250, 249)
    assert r.aic == pytest.approx(2 * k - 2 * r.loglik) and r.bic == pytest.approx(k * math.log(249) - 2 * r.loglik)
    assert r.aicc == pytest.approx(r.aic + 2 * k * (k + 1) / (249 - k - 1))
    phi, _, seasonal, mean = r.coefficients
    weights = dict(zip(model.ar_lags, r.ar, strict=True))
    assert weights == pytest.approx({1: phi, 5: seasonal, 6: -phi * seasonal})
    assert r.constant == pytest.approx(mean * (1 - phi) * (1 - seasonal))
    given = arima_ml.at_coefficients(frame(a=y), model, r.coefficients).collect()[0]
    assert given.loglik == pytest.approx(r.loglik) and given.e == pytest.approx(r.e)


def test_series_that_cannot_be_fitted(spark, frame):
    table = frame(short=[1.0, 2.0, 4.0], flat=[5.0] * 50, fine=list(np.random.default_rng(4).normal(size=50)))
    table = table.union(spark.createDataFrame([("gap", t, None if t == 7 else float(t * t % 11)) for t in range(1, 40)], table.schema))
    got = {r.series_key: r for r in arima_ml.fit(table, Sarima((1, 0, 1), (0, 0, 0), 7)).collect()}
    assert set(got) == {"short", "flat", "gap", "fine"} and got["fine"].converged
    assert all(got[k].coefficients is None and got[k].loglik is None for k in ("short", "flat", "gap"))
    assert arima_ml.fit(table.limit(0), Sarima((1, 0, 0), (0, 0, 0), 7)).count() == 0
    assert arima_ml.forecast_intervals(arima_ml.fit(table, Sarima((1, 0, 0), (0, 0, 0), 7)), Sarima((1, 0, 0), (0, 0, 0), 7), 3).filter("series_key = 'short' and value is not null").count() == 0


def test_interval_widths_like_simulated_paths(spark, frame):
    rng = np.random.default_rng(5)
    model = Sarima((1, 1, 1), (0, 1, 1), 7)
    y = simulate(rng, 300, ar=(0.5,), ma=(0.3,), sma=(-0.5,), d=1, sd=1)
    fitted = arima_ml.fit(frame(a=y), model)
    r = fitted.collect()[0]
    ahead = {x.t: x for x in arima_ml.forecast_intervals(fitted, model, 30).collect()}
    ar, ma = dict(zip(model.ar_lags, r.ar, strict=True)), dict(zip(model.ma_lags, r.ma, strict=True))
    undo = model.difference_weights()
    paths = np.zeros((20000, 30))
    past_y, past_x, past_e = np.tile(r.y, (20000, 1)), np.tile(r.x, (20000, 1)), np.tile(r.e, (20000, 1))
    for h in range(30):
        e = rng.normal(0, math.sqrt(r.sigma2), 20000)
        x = r.constant + e + sum(w * past_x[:, -lag] for lag, w in ar.items()) + sum(w * past_e[:, -lag] for lag, w in ma.items())
        v = x - sum(w * past_y[:, -lag] for lag, w in undo.items())
        paths[:, h] = v
        past_y, past_x, past_e = (np.concatenate([p[:, 1:], c[:, None]], axis=1) for p, c in ((past_y, v), (past_x, x), (past_e, e)))
    for h in (1, 2, 7, 8, 15, 30):
        assert ahead[h].se == pytest.approx(paths[:, h - 1].std(), rel=0.03)
        assert ahead[h].value == pytest.approx(paths[:, h - 1].mean(), abs=4 * ahead[h].se / math.sqrt(20000))
        assert (ahead[h].high - ahead[h].low) == pytest.approx(2 * 1.959963984540054 * ahead[h].se)


def test_chi_square_tail(spark):
    rows = [(k, x) for k in (1, 2, 3, 7, 20, 41) for x in (0.0, 0.01, 0.7, 3.0, 9.5, 30.0, 90.0)]
    table = spark.createDataFrame(rows, "k int, x double").withColumn("p", diagnostics.chi_square_tail(F.col("x"), F.col("k"), 41))
    for r in table.collect():
        if r.k % 2 == 0:  # a finite sum
            want = math.exp(-r.x / 2) * sum((r.x / 2) ** i / math.factorial(i) for i in range(r.k // 2))
        else:
            want = math.erfc(math.sqrt(r.x / 2))
            for i in range((r.k - 1) // 2):
                want += math.exp(-r.x / 2) * (r.x / 2) ** (i + 0.5) / math.gamma(i + 1.5)
        assert r.p == pytest.approx(want, rel=1e-10, abs=1e-300)


def test_ljung_box(spark):
    rng = np.random.default_rng(6)
    noise, tied = rng.normal(size=200), np.convolve(rng.normal(size=203), [1, 0.8, 0.5, 0.3])[3:203]
    table = spark.createDataFrame([("noise", noise.tolist()), ("tied", tied.tolist()), ("tiny", [1.0, 2.0]), ("flat", [1.0] * 9)], "series_key string, e array<double>")
    got = {(r.series_key, r.lag): r for r in diagnostics.ljung_box(table, 12, fitted=2).collect()}
    for name, e in (("noise", noise), ("tied", tied)):
        c, total = e - e.mean(), 0.0
        for k in range(1, 13):
            r = c[k:] @ c[:-k] / (c @ c)
            total += r * r / (200 - k)
            row = got[name, k]
            assert row.r == pytest.approx(r) and row.statistic == pytest.approx(200 * 202 * total) and row.freedom == max(0, k - 2)
            assert (row.p_value is None) == (k <= 2)
    assert got["noise", 12].p_value > 0.01 > 1e-6 > got["tied", 12].p_value
    assert got["tiny", 5].statistic is None and got["flat", 1].r is None


def test_kpss(frame):
    rng = np.random.default_rng(7)
    level, walk = rng.normal(size=300), rng.normal(size=300).cumsum()
    got = {r.series_key: r for r in diagnostics.kpss(frame(level=level, walk=walk, flat=[2.0] * 30)).collect()}
    for name, y in (("level", level), ("walk", walk)):
        c, lags = y - y.mean(), math.trunc(4 * (300 / 100) ** 0.25)
        var = c @ c / 300 + 2 * sum((1 - k / (lags + 1)) * (c[k:] @ c[:-k]) / 300 for k in range(1, lags + 1))
        assert got[name].statistic == pytest.approx((c.cumsum() ** 2).sum() / 300**2 / var) and got[name].lags == lags
    assert got["level"].statistic < 0.463 < got["walk"].statistic and got["flat"].statistic is None
    assert diagnostics.kpss(frame(walk=walk), 1).collect()[0].statistic < 0.463


def test_conditional_likelihood(frame):
    y = np.random.default_rng(8).normal(size=60).cumsum()
    model = Sarima((2, 1, 1), (0, 0, 1), 5)
    ar, ma = {1: 0.4, 2: -0.2}, {1: 0.5, 5: 0.3, 6: 0.15}
    got = diagnostics.conditional_likelihood(frame(a=y), model, ar, ma).collect()[0]
    x = np.diff(y)
    x = x - x.mean()
    e = {}
    for t in range(2, len(x)):
        e[t] = x[t] - sum(w * x[t - i] for i, w in ar.items()) - sum(w * e.get(t - i, 0.0) for i, w in ma.items())
    sigma2 = sum(v * v for v in e.values()) / len(e)
    assert got.e == pytest.approx(list(e.values())) and got.used == len(e) and got.sigma2 == pytest.approx(sigma2)
    assert got.loglik == pytest.approx(-len(e) / 2 * (math.log(2 * math.pi * sigma2) + 1))


def test_search_picks_planted_orders(spark, frame):
    rng = np.random.default_rng(9)
    table = frame(ar2=simulate(rng, 300, ar=(0.6, -0.5), mean=3), ma1=simulate(rng, 300, ma=(0.8,), d=1))
    got = {r.series_key: r for r in order_search.search(table, season=1, most=(3, 2, 0, 0)).collect()}
    assert (got["ar2"].p, got["ar2"].d, got["ar2"].q) == (2, 0, 0)
    assert (got["ma1"].d, got["ma1"].q) == (1, 1)
    for key, planted in (("ar2", Sarima((2, 0, 0), (0, 0, 0), 1)), ("ma1", Sarima((0, 1, 1), (0, 0, 0), 1))):
        fitted = arima_ml.fit(table.filter(F.col("series_key") == key), planted).collect()[0]
        assert got[key].aicc <= fitted.aicc + 1e-6


def test_differences(frame):
    rng = np.random.default_rng(10)
    n = 210
    week = np.tile(np.arange(7.0), 30) * 3
    table = frame(level=rng.normal(size=n), walk=rng.normal(size=n).cumsum(), week=week + rng.normal(size=n), twice=rng.normal(size=n).cumsum().cumsum())
    got = {r.series_key: (r.d, r.sd) for r in order_search.differences(table, 7).collect()}
    assert got["level"] == (0, 0) and got["walk"][0] == 1 and got["week"] == (0, 1) and got["twice"][0] == 2
