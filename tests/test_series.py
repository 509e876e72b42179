from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightlens.operators import correlation, sarima, series, smooth

START = date(2018, 1, 1)


def make(spark, **values):
    data = [
        (k, i + 1, START + timedelta(days=i), None if v is None else float(v))
        for k, vs in values.items()
        for i, v in enumerate(vs)
    ]
    return spark.createDataFrame(data, "series_key string, t int, date date, value double")


def values_of(df, key="a", column="value"):
    return [r[column] for r in df.filter(F.col("series_key") == key).orderBy("t").collect()]


# --- shaping ---


def test_daily_series_counts_sums_and_gaps(spark, rows):
    days = ["2019-01-01", "2019-01-01", "2019-01-02", "2019-01-04"]
    df = spark.createDataFrame([(d, float(i), "r") for i, d in enumerate(days)], "day string, v double, role string")
    df = df.withColumn("day", F.to_timestamp("day"))
    counts = series.daily_series(df, "day")
    assert rows(counts, "series_key", "t", "value") == [("all", 1, 2.0), ("all", 2, 1.0), ("all", 3, 1.0)]
    sums = series.daily_series(df, "day", "v", "role")
    assert rows(sums) == [("r", 1, date(2019, 1, 1), 1.0), ("r", 2, date(2019, 1, 2), 2.0), ("r", 3, date(2019, 1, 4), 3.0)]


def test_period_renumbers(spark, rows):
    cut = series.period(make(spark, a=range(10)), date(2018, 1, 4), date(2018, 1, 6))
    assert rows(cut, "t", "value") == [(1, 3.0), (2, 4.0), (3, 5.0)]


def test_truncate(spark):
    long = make(spark, a=range(800))
    assert series.truncate(long, 2018, 2020).count() == 731
    assert series.truncate(long.filter("t <= 100"), 2018, 2020).count() == 100


def test_difference(spark):
    squares = make(spark, a=[1, 4, 9, 16, 25], b=[1, 1])
    assert values_of(series.difference(squares, [1, 1])) == [2, 2, 2]
    assert series.difference(squares, [1, 1]).filter("series_key = 'b'").count() == 0
    assert values_of(series.difference(make(spark, a=[1, None, 9, 16]), [1])) == [None, None, 7]
    doubling = series.difference(make(spark, a=[1, 2, 4, 8, 16]), [1, 1], log=True)
    assert values_of(doubling) == pytest.approx([0, 0, 0], abs=1e-12)


def test_concat(spark, rows):
    joined = series.concat(make(spark, a=[1, 2]), make(spark, a=[3], b=[9]))
    assert rows(joined) == [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("b", 1, 9.0)]


def test_compare(spark, rows):
    table = series.compare(make(spark, a=[1000]), make(spark, a=[2000, 3000]), make(spark, a=[2500]), 2018, "CO2", 1000.0)
    days = [START + timedelta(days=i) for i in range(3)]
    assert rows(table.select("date", "data_source", "CO2")) == [
        (days[0], "forecast", 1.0), (days[0], "real", 1.0), (days[1], "forecast", 2.0), (days[1], "real", 2.5),
        (days[2], "forecast", 3.0), (days[2], "real", None),
    ]


# --- correlation ---


def brute_acf(x, lags):
    x = np.asarray(x) - np.mean(x)
    return [float((x[k:] * x[:-k]).sum() / (x * x).sum()) for k in range(1, min(lags, len(x) - 1) + 1)]


def brute_pacf(acf):
    """Last coefficient of the Yule-Walker system of each order."""
    full = [1.0, *acf]
    found = []
    for k in range(1, len(acf) + 1):
        matrix = np.array([[full[abs(i - j)] for j in range(k)] for i in range(k)])
        found.append(float(np.linalg.solve(matrix, np.array(acf[:k]))[-1]))
    return found


def test_alternating(spark):
    found = correlation.correlogram(make(spark, a=[1, -1, 1, -1]), 2).orderBy("lag").collect()
    assert [r.acf for r in found] == pytest.approx([-0.75, 0.5])


def test_correlogram_against_brute_force(spark):
    rng = np.random.default_rng(1)
    data = {k: rng.normal(size=n).cumsum() for k, n in (("a", 300), ("b", 40), ("c", 6))}
    found = correlation.correlogram(make(spark, **data), 50)
    for key, x in data.items():
        got = found.filter(F.col("series_key") == key).orderBy("lag").collect()
        expected = brute_acf(x, 50)
        assert [r.lag for r in got] == list(range(1, len(expected) + 1))
        assert [r.acf for r in got] == pytest.approx(expected, rel=1e-9, abs=1e-12)
        assert [r.pacf for r in got] == pytest.approx(brute_pacf(expected), rel=1e-6, abs=1e-8)


def test_correlogram_of_constant_and_single(spark):
    found = correlation.correlogram(make(spark, flat=[3, 3, 3], one=[1]), 5).collect()
    assert [(r.series_key, r.lag, r.acf) for r in found if r.acf is not None] == []


# --- smoothing ---


def test_boxcox_round_trip(spark):
    df = spark.createDataFrame([(v, lam) for v in (0.5, 1.0, 30.0) for lam in (-1.0, 0.0, 0.5, 1.0, 2.0)], "v double, lam double")
    back = df.select("v", smooth.inverse_boxcox(smooth.boxcox(F.col("v"), F.col("lam")), F.col("lam")).alias("w"))
    assert all(r.w == pytest.approx(r.v) for r in back.collect())


def test_lambda_of_known_spreads(spark):
    level = np.repeat(np.arange(1, 41) * 50.0, 7)
    wave = np.tile([-3, -2, -1, 0, 1, 2, 3], 40)
    flat, proportional = level + 5 * wave, level * (1 + 0.02 * wave)
    found = {r.series_key: r for r in smooth.boxcox_lambda(make(spark, flat=flat, prop=proportional), 7).collect()}
    assert found["flat"].lam == 1.0 and found["flat"].cv == pytest.approx(0, abs=1e-9)
    assert found["prop"].lam == 0.0 and found["prop"].cv == pytest.approx(0, abs=1e-9)


def test_clean_finds_planted_spikes(spark):
    noise = np.random.default_rng(7).uniform(-4, 4, 140)
    base = [float(100 + 10 * (i % 7) + 0.1 * i + noise[i]) for i in range(140)]
    spikes, spiked = [0, 50, 100, 139], list(base)
    for at in spikes:
        spiked[at] = 900
    spiked[90] = None
    cleaned = smooth.clean_series(make(spark, a=spiked))
    assert [i for i, flag in enumerate(values_of(cleaned, column="is_outlier")) if flag] == spikes
    out = values_of(cleaned, column="cleaned")
    assert out[0] == base[1] and out[139] == base[138] and out[90] is None
    assert [out[i] for i in (50, 100)] == pytest.approx([(base[i - 1] + base[i + 1]) / 2 for i in (50, 100)])
    rest = set(range(140)) - {*spikes, 90}
    assert [out[i] for i in rest] == [base[i] for i in rest]


def test_clean_draws_a_line_over_a_run(spark):
    base = [float(v) for v in np.random.default_rng(3).uniform(-1, 1, 70)]
    spiked = base[:30] + [50.0, -50.0] + base[32:]
    out = values_of(smooth.clean_series(make(spark, a=spiked)), column="cleaned")
    assert out[30:32] == pytest.approx([base[29] + (base[32] - base[29]) * k / 3 for k in (1, 2)])


def test_clean_uses_lambda(spark):
    noise = np.random.default_rng(7).uniform(-0.1, 0.1, 70)
    base = [float(np.exp(1 + 0.1 * (i % 7) + noise[i])) for i in range(70)]
    base[30] = 500.0
    raw = make(spark, a=base)
    lambdas = spark.createDataFrame([("a", 0.0)], "series_key string, lam double")
    out = values_of(smooth.clean_series(raw, lambdas), column="cleaned")
    assert out[30] == pytest.approx(np.sqrt(base[29] * base[31]))


def test_local_trend_of_a_line_and_brute_force(spark):
    rng = np.random.default_rng(4)
    x = [int(v) for v in sorted(rng.choice(400, 250, replace=False))]
    line = [("line", a, 3.0 + 0.5 * a) for a in x]
    noisy = [("noise", a, float(rng.normal())) for a in x]
    df = spark.createDataFrame(line + noisy, "k string, x int, y double")
    found = smooth.local_trend(df, ["k"], "x", "y", 30, 7).collect()
    assert {r.x for r in found} == {p for p in range(0, 400, 7) if min(x) <= p <= max(x)}
    ys = {k: np.array([v for kk, _, v in line + noisy if kk == k]) for k in ("line", "noise")}
    for r in found:
        d = np.array(x) - r.x
        w = np.clip(1 - np.abs(d / 30.0) ** 3, 0, None) ** 3
        design = np.stack([np.ones(len(x)), d], axis=1) * np.sqrt(w)[:, None]
        expected = np.linalg.lstsq(design, ys[r.k] * np.sqrt(w), rcond=None)[0][0]
        assert r.trend == pytest.approx(expected, abs=1e-8)


# --- forecasting ---


def test_seasonal_difference_repeats_the_last_season(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=60)
    model = sarima.Sarima((0, 0, 0), (0, 1, 0), 7, with_constant=False)
    out = values_of(sarima.forecast(sarima.fit(make(spark, a=y), model), model, 15))
    assert out == pytest.approx([y[-7 + i % 7] for i in range(15)])


def test_drift_continues_a_line(spark):
    model = sarima.Sarima((0, 1, 0), (0, 0, 0), 7)
    out = values_of(sarima.forecast(sarima.fit(make(spark, a=np.arange(30) * 2.0 + 5), model), model, 4))
    assert out == pytest.approx([65, 67, 69, 71])


def test_both_differences_against_brute_force(spark):
    y = list(np.random.default_rng(8).normal(size=80).cumsum())
    model = sarima.Sarima((0, 2, 0), (0, 1, 0), 5)
    assert not model.constant
    out = values_of(sarima.forecast(sarima.fit(make(spark, a=y), model), model, 20))
    for h in range(20):
        n = len(y)
        y.append(2 * y[n - 1] - y[n - 2] + y[n - 5] - 2 * y[n - 6] + y[n - 7])
    assert out == pytest.approx(y[80:])


def test_autoregression_is_least_squares(spark):
    rng = np.random.default_rng(0)
    y = np.zeros(500)
    for t in range(1, 500):
        y[t] = 0.8 * y[t - 1] + rng.normal()
    y += 50
    model = sarima.Sarima((1, 0, 0), (0, 0, 0), 7)
    fitted = sarima.fit(make(spark, a=y), model).first()
    design = np.stack([np.ones(499), y[:-1]], axis=1)
    c, phi = np.linalg.lstsq(design, y[1:], rcond=None)[0]
    assert fitted["ar"][0] == pytest.approx(phi, rel=1e-8) and fitted["constant"] == pytest.approx(c, rel=1e-8)
    out = values_of(sarima.forecast(sarima.fit(make(spark, a=y), model), model, 3))
    expected, last = [], y[-1]
    for _ in range(3):
        last = c + phi * last
        expected.append(last)
    assert out == pytest.approx(expected)


def brute_two_stage(y, model, horizon):
    """The definition in ``sarima`` written out with dense linear algebra."""
    x = np.asarray(y, float)
    x = np.log(x) if model.log else x
    level = list(x)
    for lag in model.difference_lags:
        x = x[lag:] - x[:-lag]
    mu = x.mean() if model.constant else 0.0
    sd = np.sqrt(((x - mu) ** 2).mean())
    z, h = (x - mu) / sd, model.long_order
    full = [1.0] + [float((z[k:] * z[:-k]).sum() / (z * z).sum()) for k in range(1, h + 1)]
    phi = np.linalg.solve([[full[abs(i - j)] for j in range(h)] for i in range(h)], full[1:])
    e = np.full(len(z), np.nan)
    for t in range(h, len(z)):
        e[t] = z[t] - sum(phi[k] * z[t - 1 - k] for k in range(h))
    start = max(model.ar_lags + [m + h for m in model.ma_lags])
    rows = [
        [1.0] * model.constant + [z[t - a] for a in model.ar_lags] + [e[t - m] for m in model.ma_lags]
        for t in range(start, len(z))
    ]
    beta = list(np.linalg.lstsq(np.array(rows), z[start:], rcond=None)[0])
    c = beta.pop(0) if model.constant else 0.0
    ar, ma = beta[: len(model.ar_lags)], beta[len(model.ar_lags):]
    constant = c * sd + mu * (1 - sum(ar)) if model.constant else 0.0
    xs, es = list(x), list(e * sd)
    undo = model.difference_weights()
    for _ in range(horizon):
        new = constant + sum(a * xs[-lag] for a, lag in zip(ar, model.ar_lags))
        new += sum(m * es[-lag] for m, lag in zip(ma, model.ma_lags))
        level.append(new - sum(w * level[-lag] for lag, w in undo.items()))
        xs.append(new)
        es.append(0.0)
    out = np.array(level[len(y):])
    return constant, ar, ma, np.exp(out) if model.log else out


@pytest.mark.parametrize(
    "model",
    [
        sarima.Sarima((3, 1, 3), (1, 0, 0), 31),
        sarima.Sarima((2, 1, 1), (0, 1, 0), 31),
        sarima.Sarima((3, 1, 3), (1, 0, 0), 7, log=True),
        sarima.Sarima((1, 0, 0), (0, 1, 1), 7),
    ],
)
def test_models_against_brute_force(spark, model):
    rng = np.random.default_rng(6)
    data = {}
    for key in "ab":
        e = rng.normal(size=731)
        noise = e.copy()
        for t in range(1, 731):
            noise[t] += 0.5 * noise[t - 1] + 0.3 * e[t - 1]
        data[key] = 1000 + 30 * np.sin(np.arange(731) * 2 * np.pi / 7) + 10 * noise
    fitted = sarima.fit(make(spark, **data), model)
    coefs = {r.series_key: r for r in fitted.collect()}
    out = sarima.forecast(fitted, model, 40)
    for key, y in data.items():
        constant, ar, ma, path = brute_two_stage(y, model, 40)
        assert coefs[key].constant == pytest.approx(constant, rel=1e-5, abs=1e-9)
        assert coefs[key].ar == pytest.approx(ar, rel=1e-5, abs=1e-7)
        assert coefs[key].ma == pytest.approx(ma, rel=1e-5, abs=1e-7)
        assert values_of(out, key) == pytest.approx(list(path), rel=1e-6)


def test_moving_average_is_recovered(spark):
    rng = np.random.default_rng(9)
    e = rng.normal(size=3000)
    y = e[1:] + 0.6 * e[:-1]
    fitted = sarima.fit(make(spark, a=y), sarima.Sarima((0, 0, 1), (0, 0, 0), 7)).first()
    assert fitted["ma"][0] == pytest.approx(0.6, abs=0.06)


def test_short_series_has_no_coefficients(spark):
    model = sarima.Sarima((3, 1, 3), (1, 0, 0), 31)
    fitted = sarima.fit(make(spark, a=range(20), b=[1]), model)
    assert all(v is None for r in fitted.collect() for v in [*r.ar, *r.ma])
    assert {r.value for r in sarima.forecast(fitted, model, 2).collect()} == {None}


def test_lags_and_weights():
    model = sarima.Sarima((3, 1, 3), (1, 0, 0), 31)
    assert model.ar_lags == [1, 2, 3, 31, 32, 33, 34] and model.ma_lags == [1, 2, 3] and model.constant
    model = sarima.Sarima((2, 1, 1), (0, 1, 0), 31)
    assert model.difference_weights() == {1: -1, 31: -1, 32: 1} and not model.constant
