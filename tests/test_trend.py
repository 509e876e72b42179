"""Trends with errors, fit statistics and exact quantiles against plain versions."""

from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightlens.operators import polyfit, quantiles, trend

SCHEMA = "k string, x double, y double"


def frame(spark, **series):
    return spark.createDataFrame([(k, float(a), float(b)) for k, (x, y) in series.items() for a, b in zip(x, y, strict=True)], SCHEMA)


def curves(df):
    found = {}
    for r in df.orderBy("k", "x").collect():
        found.setdefault(r.k, []).append(r)
    return found


def plain_operator(x, at, near):
    """Rows that take observations to fits, one weighted least-squares problem per place."""
    rows = []
    for place in at:
        gap = np.abs(x - place)
        w = np.clip(1 - (gap / np.sort(gap)[near - 1]) ** 3, 0, None) ** 3
        design = np.vander(x - place, 3, increasing=True) * np.sqrt(w)[:, None]
        rows.append(np.linalg.pinv(design)[0] * np.sqrt(w))
    return np.array(rows)


def test_loess_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.sort(rng.choice(600, 150, replace=False)).astype(float)
    y = np.sin(x / 60) + rng.normal(0, 0.2, 150)
    parabola = 3 - 0.2 * x + 0.001 * x * x
    found = curves(trend.loess(frame(spark, noisy=(x, y), exact=(x, parabola)), ["k"], "x", "y", span=0.4, points=25))
    at = np.linspace(x[0], x[-1], 25)
    whole, shown = plain_operator(x, x, 60), plain_operator(x, at, 60)
    rest = np.eye(150) - whole
    freedom = np.trace(rest @ rest.T)
    sigma = np.sqrt(((rest @ y) ** 2).sum() / freedom)
    rows = found["noisy"]
    assert [r.x for r in rows] == pytest.approx(at)
    assert [r.trend for r in rows] == pytest.approx(shown @ y, abs=1e-9)
    assert [r.error for r in rows] == pytest.approx(sigma * np.sqrt((shown**2).sum(axis=1)), rel=1e-8)
    assert (rows[0].sigma, rows[0].freedom) == pytest.approx((sigma, freedom))
    assert [r.trend for r in found["exact"]] == pytest.approx(3 - 0.2 * at + 0.001 * at * at, abs=1e-8)


def test_loess_awkward_series(spark):
    x = np.arange(40.0)
    rows = [("few", 1.0, 1.0), ("few", 2.0, 1.0), ("tied", 1.0, 1.0), ("tied", 1.0, 2.0), ("tied", 1.0, 3.0), ("tied", 2.0, 3.0)]
    rows += [("none", None, 1.0), ("none", 1.0, None), ("nan", 1.0, float("nan")), (None, 1.0, float("inf"))]
    rows += [(None, float(a), 7.0) for a in x]
    df = spark.createDataFrame(rows, SCHEMA)
    found = trend.loess(df, ["k"], "x", "y").collect()
    assert {r.k for r in found} == {None} and len(found) == 80
    assert [r.trend for r in found] == pytest.approx([7.0] * 80) and max(r.sigma for r in found) < 1e-6
    assert trend.loess(df.limit(0), ["k"], "x", "y").count() == 0
    with pytest.raises(ValueError):
        trend.loess(df, ["k"], "x", "y", span=0)


def natural_splines(x, knots):
    """Interpolating natural splines of the unit values at the knots, and their curvature, by the usual tridiagonal system."""
    k, h = len(knots), np.diff(knots)
    q, r = np.zeros((k, k - 2)), np.zeros((k - 2, k - 2))
    for j in range(1, k - 1):
        q[j - 1 : j + 2, j - 1] = 1 / h[j - 1], -1 / h[j - 1] - 1 / h[j], 1 / h[j]
        r[j - 1, j - 1] = (h[j - 1] + h[j]) / 3
        if j < k - 2:
            r[j - 1, j] = r[j, j - 1] = h[j] / 6
    second = np.zeros((k, k))
    second[1:-1] = np.linalg.solve(r, q.T)
    i = np.clip(np.searchsorted(knots, x, side="right") - 1, 0, k - 2)
    a, b = (knots[i + 1] - x) / h[i], (x - knots[i]) / h[i]
    eye = np.eye(k)
    bent = ((a**3 - a) * h[i] ** 2 / 6)[:, None] * second[i] + ((b**3 - b) * h[i] ** 2 / 6)[:, None] * second[i + 1]
    return a[:, None] * eye[i] + b[:, None] * eye[i + 1] + bent, q @ np.linalg.solve(r, q.T)


def test_spline_brute_force(spark):
    """Another basis of the same space, dense hat matrices, every penalty tried in turn."""
    rng = np.random.default_rng(2)
    x = np.sort(rng.integers(0, 900, 2500)).astype(float)
    y = 50 + 10 * np.sin(x / 120) + rng.normal(0, 3, 2500)
    rows = curves(trend.spline(frame(spark, a=(x, y)), ["k"], "x", "y", points=40))["a"]
    knots = np.linspace(0, 1, 10)
    u = (x - x[0]) / (x[-1] - x[0])
    basis, penalty = natural_splines(u, knots)
    own = trend.basis_values(u, knots)
    scale = np.trace(own.T @ own) / np.trace(trend.curvature(knots))
    best = None
    for strength in trend.PENALTIES * scale:
        hat = np.linalg.solve(basis.T @ basis + strength * penalty, basis.T)
        left = ((y - basis @ (hat @ y)) ** 2).sum()
        used = (basis * hat.T).sum()
        score = len(x) * left / (len(x) - used) ** 2
        if best is None or score < best[0]:
            best = score, strength, hat, left, len(x) - used
    _, strength, hat, left, freedom = best
    shown, _ = natural_splines(np.linspace(0, 1, 40), knots)
    covariance = np.linalg.inv(basis.T @ basis + strength * penalty) * left / freedom
    assert [r.trend for r in rows] == pytest.approx(shown @ (hat @ y), rel=1e-6)
    assert [r.error for r in rows] == pytest.approx(np.sqrt(np.einsum("pi,ij,pj->p", shown, covariance, shown)), rel=1e-5)
    assert rows[0].freedom == pytest.approx(freedom, rel=1e-6)
    assert np.abs(np.array([r.trend for r in rows]) - (50 + 10 * np.sin(np.linspace(x[0], x[-1], 40) / 120))).max() < 1.5


def test_spline_line_few_places_and_choice(spark):
    x = np.arange(1200.0)
    df = frame(spark, line=(x, 5 - 0.01 * x), few=(np.arange(10.0), np.arange(10.0))).unionByName(
        spark.createDataFrame([("line", None, 1.0), ("none", 1.0, None)], SCHEMA)
    )
    found = curves(trend.spline(df, ["k"], "x", "y"))
    assert set(found) == {"line"}
    assert [r.trend for r in found["line"]] == pytest.approx([5 - 0.01 * r.x for r in found["line"]], abs=1e-6)
    assert set(curves(trend.smooth_trend(df, ["k"], "x", "y"))) == {"line"}
    assert set(curves(trend.smooth_trend(df.filter("x < 999"), ["k"], "x", "y"))) == {"line", "few"}
    assert trend.smooth_trend(df.limit(0), ["k"], "x", "y").count() == 0


def test_fit_statistics_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(900, 1000, 400))
    y = 4 + 0.5 * x + rng.normal(0, 2, 400)
    df = frame(spark, a=(x, y), exact=(range(4), range(4)), few=([1, 2], [1, 2])).unionByName(frame(spark, b=(x / 100, y)))
    model = polyfit.fit_statistics(df, "k", "x", "y").cache()
    found = {r.k: r for r in model.collect()}
    for key, places in (("a", x), ("b", x / 100)):
        centre = places.mean()
        design = np.vander(places - centre, 4, increasing=True)
        inverse = np.linalg.inv(design.T @ design)
        c = np.linalg.lstsq(design, y, rcond=None)[0]
        rss = ((y - design @ c) ** 2).sum()
        sigma = np.sqrt(rss / 396)
        shift = np.array([[0 if j < k else comb(j, k) * (-centre) ** (j - k) for j in range(4)] for k in range(4)])
        r = found[key]
        assert (r.n, r.freedom) == (400, 396) and r.sigma == pytest.approx(sigma, rel=1e-8)
        assert r.r2 == pytest.approx(1 - rss / ((y - y.mean()) ** 2).sum(), abs=1e-9)
        assert [r[f"se{k}"] for k in range(4)] == pytest.approx(sigma * np.sqrt(np.diag(shift @ inverse @ shift.T)), rel=1e-4)
        at = spark.createDataFrame([(key, float(places[0] + 1)), ("unknown", 1.0)], "k string, x double")
        shown = {p.k: p for p in polyfit.predict(at, model, "k", "x").collect()}
        row = np.vander([places[0] + 1 - centre], 4, increasing=True)[0]
        assert shown[key].fitted == pytest.approx(row @ c, rel=1e-8)
        assert shown[key].fit_error == pytest.approx(sigma * np.sqrt(row @ inverse @ row), rel=1e-6)
        assert shown[key].prediction_error == pytest.approx(sigma * np.sqrt(1 + row @ inverse @ row), rel=1e-8)
        assert shown["unknown"].fitted is None
    assert found["exact"].sigma is None and found["exact"].freedom == 0 and found["exact"].r2 == pytest.approx(1)
    assert found["few"].sigma is None and found["few"].r2 is None


def test_exact_quantiles_are_those_of_percentile(spark):
    rng = np.random.default_rng(4)
    groups = {
        "wide": np.exp(rng.normal(0, 30, 3000)), "small": rng.normal(size=50), "one": [5.0], "same": [2.5] * 800,
        "ties": rng.integers(0, 4, 2000), "huge": [-1.7e308, 1.7e308, *rng.normal(size=300)], "spike": [0.0] * 700 + [1e-300] * 700 + [1e300],
    }
    rows = [(k, 1, float(v)) for k, values in groups.items() for v in values]
    rows += [(None, 1, float(v)) for v in range(500)] + [("small", 1, None), ("small", 1, float("nan")), ("void", 1, float("inf"))]
    df = spark.createDataFrame(rows, "k string, _all int, v double")
    ps = [0.0, 0.25, 0.5, 0.613, 0.75, 1.0]
    found = {(r.k, r.probability): r.quantile for r in quantiles.exact_quantiles(df, ["k"], "v", ps, gathered=100).collect()}
    assert len(found) == len(ps) * (len(groups) + 1)
    for (k, p), q in found.items():
        values = np.array([v for kk, _, v in rows if kk == k and v is not None and np.isfinite(v)])
        low, high = np.quantile(values, p, method="lower"), np.quantile(values, p, method="higher")
        part = (len(values) - 1) * p - np.floor((len(values) - 1) * p)
        assert q == pytest.approx(low * (1 - part) + high * part, rel=1e-12), (k, p)
    assert quantiles.exact_quantiles(df.limit(0), ["k"], "v", ps).count() == 0


def test_quantiles_gather_no_large_group(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    found = quantiles.exact_quantiles(df, [], "v", [0.5], gathered=1000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in plan
    values = sorted(i * 7919 % 20_011 for i in range(20_000))
    assert found.first().quantile == (values[9_999] + values[10_000]) / 2
