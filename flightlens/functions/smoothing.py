"""Smoothers of one series as arrays: local regression, seasonal-trend decomposition, a smoother of variable span."""

from __future__ import annotations

import numpy as np

TINY = 1e-12
# The three spans of the variable-span smoother, as parts of the series, and its smallest number.
TWEETER, MIDRANGE, WOOFER = 0.05, 0.2, 0.5
SMALL = 1e-7


def odd(value: float) -> int:
    """The next odd whole number."""
    n = int(np.ceil(value))
    return n if n % 2 else n + 1


def local_line(y: np.ndarray, weights: np.ndarray, span: int, at: np.ndarray, degree: int = 1) -> np.ndarray:
    """Local regression of values at places 0, 1, 2 ..., evaluated at whole places ``at``, which may lie one span outside.

    Each point takes the ``span`` nearest places with tricube weights of their distance over that of the furthest; a span
    beyond the series widens the reach by half of what is missing. Degree 0 is a weighted mean, 1 a line. Where all
    weights are 0 the result is undefined (nan).
    """
    n = len(y)
    q = min(span, n)
    first = np.clip(at - (q - 1) // 2, 0, n - q)
    places = first[:, None] + np.arange(q)
    far = np.abs(places - at[:, None]).astype(float)
    reach = far.max(axis=1, keepdims=True) + (max(0, span - n) // 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = far / np.maximum(reach, TINY)
        w = np.where(far <= 0.001 * reach, 1.0, np.where(far > 0.999 * reach, 0.0, (1 - part**3) ** 3)) * weights[places]
        w = w / w.sum(axis=1, keepdims=True)
        if degree:
            middle = (w * places).sum(axis=1, keepdims=True)
            off = places - middle
            spread = (w * off * off).sum(axis=1, keepdims=True)
            wide = np.sqrt(spread) > 0.001 * max(1, n - 1)
            w = np.where(wide, w * (1 + (at[:, None] - middle) * off / np.where(wide, spread, 1)), w)
        return (w * y[places]).sum(axis=1)


def moving_mean(y: np.ndarray, width: int) -> np.ndarray:
    """Means of ``width`` values in a row; shorter by width - 1."""
    sums = np.concatenate([[0.0], np.cumsum(y)])
    return (sums[width:] - sums[:-width]) / width


def decompose(
    y: np.ndarray, season: int, seasonal_span: int = 11, trend_span: int | None = None, inner: int = 2, outer: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seasonal, trend, robustness weights) of a series of at least two seasons, by iterated local regression.

    A pass smooths the values of each place of the season, less the trend, by local lines that reach one season beyond both
    ends; takes off what a low-pass filter (means of a season twice, of three, a local line) leaves of them; and smooths
    the rest to the trend. ``inner`` passes are made, then ``outer`` times bisquare weights of the remainder, 0 from six
    times its median size on, are set and the passes made again.
    """
    n, p = len(y), season
    trend_span = trend_span or odd(1.5 * p / (1 - 1.5 / seasonal_span))
    low_span = odd(p)
    trend, seasonal, robust = np.zeros(n), np.zeros(n), np.ones(n)
    every = np.arange(n)
    for k in range(outer + 1):
        for _ in range(inner):
            left = y - trend
            cycle = np.zeros(n + 2 * p)
            for place in range(p):
                sub = left[place::p]
                cycle[place::p] = local_line(sub, robust[place::p], seasonal_span, np.arange(-1, len(sub) + 1))
            low = moving_mean(moving_mean(moving_mean(cycle, p), p), 3)
            seasonal = cycle[p : p + n] - local_line(low, np.ones(n), low_span, every)
            trend = local_line(y - seasonal, robust, trend_span, every)
        if k < outer:
            size = np.abs(y - seasonal - trend)
            reach = 6 * np.median(size)
            part = size / max(reach, TINY)
            robust = np.where(part >= 0.999, 0.0, np.where(part <= 0.001, 1.0, (1 - part**2) ** 2))
            if reach <= TINY:
                break
    return seasonal, trend, robust


def running_lines(y: np.ndarray, span: float) -> tuple[np.ndarray, np.ndarray]:
    """(smooth, size of the cross-validated remainder) of lines over neighbours at places 0, 1, 2 ...

    ``span`` is the part of the series a line takes; at the ends it stays the first or last so many values.
    """
    n = len(y)
    half = max(2, int(0.5 * span * n + 0.5))
    width = min(2 * half + 1, n)
    x = np.arange(n, dtype=float)
    first = np.clip(np.arange(n) - half, 0, n - width)
    centre = y.mean()  # sums of small numbers keep their digits
    sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (x, x * x, y - centre, x * (y - centre))]
    sx, sxx, sy, sxy = (s[first + width] - s[first] for s in sums)
    mx, my = sx / width, sy / width
    var, cov = sxx - sx * mx, sxy - sx * my
    slope = np.where(var > 0, cov / np.where(var > 0, var, 1), 0.0)
    smooth = my + slope * (x - mx)
    pull = 1 / width + np.where(var > 0, (x - mx) ** 2 / np.where(var > 0, var, 1), 0.0)
    left = 1 - pull
    return smooth + centre, np.where(left > 0, np.abs(y - centre - smooth) / np.where(left > 0, left, 1), 0.0)


def variable_span(y: np.ndarray, bass: float = 0.0) -> np.ndarray:
    """A smooth whose span goes with the curve: at every place the span of three with the least cross-validated remainder.

    Remainders and chosen spans are smoothed themselves, the result lies between the smooths of the two spans next to the
    chosen one. ``bass`` up to 10 leans towards the widest.
    """
    if len(y) < 3:
        return np.full(len(y), y.mean()) if len(y) else y
    spans = (TWEETER, MIDRANGE, WOOFER)
    smooths, sizes = [], []
    for span in spans:
        smooth, size = running_lines(y, span)
        smooths.append(smooth)
        sizes.append(running_lines(size, MIDRANGE)[0])
    best = np.argmin(np.array(sizes), axis=0)
    least, widest = np.min(np.array(sizes), axis=0), sizes[2]
    chosen = np.array(spans)[best]
    if 0 < bass <= 10:
        lean = (least < widest) & (least > 0)
        ratio = np.maximum(SMALL, least / np.where(lean, widest, 1))
        chosen = np.where(lean, chosen + (WOOFER - chosen) * ratio ** (10 - bass), chosen)
    chosen = np.clip(running_lines(chosen, MIDRANGE)[0], TWEETER, WOOFER)
    up = (chosen - MIDRANGE) / (WOOFER - MIDRANGE)
    down = (MIDRANGE - chosen) / (MIDRANGE - TWEETER)
    mixed = np.where(chosen >= MIDRANGE, (1 - up) * smooths[1] + up * smooths[2], (1 - down) * smooths[1] + down * smooths[0])
    return running_lines(mixed, TWEETER)[0]


def interpolated(y: np.ndarray, good: np.ndarray) -> np.ndarray:
    """``y`` with lines between good neighbours where it is not good; the ends take the only neighbour."""
    at = np.flatnonzero(good)
    return np.interp(np.arange(len(y)), at, y[at]) if len(at) else y
