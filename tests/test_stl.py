"""Decomposition and cleaning of series against plain loops and planted outliers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightlens.functions import smoothing
from flightlens.operators import stl


def plain_local(y, weights, span, at, degree):
    """One point of a local regression, by sorting distances and solving the weighted normal equations."""
    n = len(y)
    q = min(span, n)
    order = sorted(range(n), key=lambda k: (abs(k - at), k))
    near = sorted(order[:q])
    if len(near) > 1 and max(near) - min(near) != q - 1:
        raise AssertionError("neighbours are not in a row")
    reach = max(abs(k - at) for k in near) + max(0, span - n) // 2
    w = np.array([weights[k] * (1 if abs(k - at) <= 0.001 * reach else 0 if abs(k - at) > 0.999 * reach else (1 - (abs(k - at) / reach) ** 3) ** 3) for k in near])
    x = np.array(near, dtype=float) - at
    design = np.stack([x**d for d in range(degree + 1)], axis=1)
    solved = np.linalg.lstsq(design * np.sqrt(w)[:, None], np.array(y)[near] * np.sqrt(w), rcond=None)[0]
    return solved[0]


@pytest.mark.parametrize(("span", "degree"), [(7, 1), (7, 0), (15, 1), (61, 1)])
def test_local_line_like_normal_equations(span, degree):
    rng = np.random.default_rng(1)
    y, w = rng.normal(size=40), rng.uniform(0.2, 1, 40)
    at = np.arange(-1, 41)
    got = smoothing.local_line(y, w, span, at, degree)
    assert got == pytest.approx([plain_local(y, w, span, a, degree) for a in at])


def plain_pass(y, p, span):
    """One pass of the decomposition, place by place."""
    n, ones = len(y), np.ones(len(y))
    cycle = np.zeros(n + 2 * p)
    for place in range(p):
        sub = y[place::p]
        for k in range(-1, len(sub) + 1):
            cycle[place + (k + 1) * p] = plain_local(sub, np.ones(len(sub)), span, k, 1)
    low = cycle
    for width in (p, p, 3):
        low = np.array([low[k : k + width].mean() for k in range(len(low) - width + 1)])
    low_span = p if p % 2 else p + 1
    seasonal = np.array([cycle[p + k] - plain_local(low, ones, low_span, k, 1) for k in range(n)])
    wide = smoothing.odd(1.5 * p / (1 - 1.5 / span))
    trend = np.array([plain_local(y - seasonal, ones, wide, k, 1) for k in range(n)])
    return seasonal, trend


def test_pass_like_plain_loops():
    rng = np.random.default_rng(2)
    y = rng.normal(size=75) + np.sin(np.arange(75) * 2 * np.pi / 7) * 4 + np.arange(75) * 0.1
    seasonal, trend, robust = smoothing.decompose(y, 7, 9, inner=1)
    want = plain_pass(y, 7, 9)
    assert seasonal == pytest.approx(want[0]) and trend == pytest.approx(want[1]) and (robust == 1).all()


def test_robust_weights_leave_outliers_out():
    rng = np.random.default_rng(3)
    n = 210
    season, line = 3 * np.sin(2 * np.pi * np.arange(n) / 7), 0.05 * np.arange(n)
    y = season + line + rng.normal(0, 0.2, n)
    y[[40, 101, 150]] += [15, -20, 9]
    seasonal, trend, robust = smoothing.decompose(y, 7, inner=1, outer=15)
    assert (robust[[40, 101, 150]] == 0).all() and (robust > 0.3).mean() > 0.9
    plain = smoothing.decompose(y, 7)[1]
    assert np.abs(trend - line)[10:-10].max() < 0.6 < np.abs(plain - line).max()
    assert np.abs(seasonal - season)[10:-10].max() < 0.6


def plain_running(y, span):
    n = len(y)
    half = max(2, int(0.5 * span * n + 0.5))
    width = min(2 * half + 1, n)
    smooth, left = [], []
    for k in range(n):
        start = min(max(k - half, 0), n - width)
        x = np.arange(start, start + width, dtype=float)
        part = y[start : start + width]
        slope = ((x - x.mean()) * (part - part.mean())).sum() / ((x - x.mean()) ** 2).sum()
        smooth.append(part.mean() + slope * (k - x.mean()))
        left.append(abs(y[k] - smooth[-1]) / (1 - 1 / width - (k - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum()))
    return np.array(smooth), np.array(left)


def test_running_lines_like_least_squares():
    y = np.random.default_rng(4).normal(size=90).cumsum()
    for span in (0.05, 0.2, 0.5):
        got, want = smoothing.running_lines(y, span), plain_running(y, span)
        assert got[0] == pytest.approx(want[0]) and got[1] == pytest.approx(want[1])


def test_variable_span_follows_the_curve():
    rng = np.random.default_rng(5)
    x = np.linspace(0, 1, 400)
    truth = np.where(x < 0.5, 0, np.sin(40 * x))
    got = smoothing.variable_span(truth + rng.normal(0, 0.2, 400))
    flat, wave = slice(20, 170), slice(230, 380)
    assert np.abs(got - truth)[flat].mean() < 0.06 and np.abs(got - truth)[wave].mean() < 0.2
    assert np.corrcoef(got[wave], truth[wave])[0, 1] > 0.95
    assert smoothing.variable_span(np.arange(30.0)) == pytest.approx(np.arange(30.0))


@pytest.fixture(scope="module")
def table(spark):
    def build(**series):
        rows = [(k, t + 1, None if v is None else float(v), "x") for k, y in series.items() for t, v in enumerate(y)]
        return spark.createDataFrame(rows, "series_key string, t int, value double, note string")

    return build


def test_planted_outliers_are_found_and_replaced(table):
    rng = np.random.default_rng(6)
    n = 150
    truth = 100 + 0.2 * np.arange(n) + 12 * np.sin(2 * np.pi * np.arange(n) / 7)
    seasonal = truth + rng.normal(0, 0.8, n)
    smooth = 50 + 10 * np.sin(np.arange(n) / 25) + rng.normal(0, 0.8, n)
    planted = {20: 30, 75: -40, 76: 35, 149: 25}
    for k, v in planted.items():
        seasonal[k] += v
        smooth[k] += v
    got = stl.clean_by_decomposition(table(seasonal=seasonal, smooth=smooth), 7)
    rows = got.collect()
    assert got.columns == ["series_key", "t", "value", "note", "is_outlier", "cleaned"] and len(rows) == 2 * n
    for key, base in (("seasonal", truth), ("smooth", smooth - sum(v * np.eye(n)[k] for k, v in planted.items()))):
        bad = {r.t - 1: r.cleaned for r in rows if r.series_key == key and r.is_outlier}
        assert set(planted) <= set(bad) and len(bad) <= 6
        assert all(abs(bad[k] - base[k]) < 6 for k in planted)
    assert all(r.cleaned == r.value for r in rows if not r.is_outlier)


def test_short_flat_and_missing(spark, table):
    gap = [float(k % 7) for k in range(40)]
    gap[5] = None
    rows = stl.clean_by_decomposition(table(one=[1.0], two=[1.0, 9.0], flat=[3.0] * 30, gap=gap), 7).collect()
    assert len(rows) == 73 and not any(r.is_outlier for r in rows) and all(r.cleaned == r.value for r in rows)
    parts = stl.stl(table(short=[1.0] * 13, gap=gap), 7).collect()
    assert all(r.trend is None for r in parts if r.series_key == "short") and sum(r.trend is None for r in parts if r.series_key == "gap") == 1
    assert all(r.seasonal + r.trend + r.remainder == pytest.approx(r.value) for r in parts if r.trend is not None)
    empty = table(a=[1.0]).limit(0)
    assert stl.stl(empty, 7).count() == 0 and stl.clean_by_decomposition(empty, 7).count() == 0


def test_strength_and_scale(table):
    rng = np.random.default_rng(7)
    n = 140
    noise = rng.normal(size=n)
    got = {r.series_key: r.strength for r in stl.seasonal_strength(table(strong=noise * 0.2 + 5 * np.sin(2 * np.pi * np.arange(n) / 7), weak=noise, short=[1.0, 2.0]), 7).collect()}
    assert got["strong"] > 0.9 > 0.64 > got["weak"] and got["short"] is None
    powers = np.exp(rng.normal(0, 0.1, n) + 3)
    powers[60] *= 30
    lam = table(a=[0]).select("series_key", F.lit(0.0).alias("lam"))
    rows = stl.clean_by_decomposition(table(a=powers), 7, lam).collect()
    assert [r.t for r in rows if r.is_outlier] == [61] and 10 < next(r.cleaned for r in rows if r.t == 61) < 40
