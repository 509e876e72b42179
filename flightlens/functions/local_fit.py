"""Local quadratic regression of one series, in numpy."""

from __future__ import annotations

import numpy as np

BLOCK = 256  # evaluation points worked on at a time


def local_quadratic(x: np.ndarray, y: np.ndarray, at: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fit at the places ``at``; with it the squared length and the own weight of the linear operator's row.

    Tricube weights reach to the ``near``-th nearest observation. NaN where fewer than three distinct places have weight.
    """
    fit, length, own = (np.full(len(at), np.nan) for _ in range(3))
    for start in range(0, len(at), BLOCK):
        gap = x[None, :] - at[start : start + BLOCK, None]
        reach = np.partition(np.abs(gap), near - 1, axis=1)[:, near - 1]
        u = gap / np.where(reach > 0, reach, 1.0)[:, None]
        w = np.clip(1 - np.abs(u) ** 3, 0, None) ** 3
        powers = [u**k for k in range(5)]
        s = [(w * p).sum(axis=1) for p in powers]
        r = [(w * w * p).sum(axis=1) for p in powers]
        t = np.stack([(w * p * y).sum(axis=1) for p in powers[:3]], axis=1)
        place = np.arange(3)
        normal = np.stack(s, axis=1)[:, place[:, None] + place]
        squared = np.stack(r, axis=1)[:, place[:, None] + place]
        low = np.where(w > 0, x, np.inf).min(axis=1)
        high = np.where(w > 0, x, -np.inf).max(axis=1)
        middle = (w > 0) & (x > low[:, None]) & (x < high[:, None])
        sound = (reach > 0) & middle.any(axis=1)
        if sound.any():
            first = np.linalg.solve(normal[sound], np.tile(np.eye(3)[:, :1], (int(sound.sum()), 1, 1)))[:, :, 0]
            rows = start + np.flatnonzero(sound)
            fit[rows] = (first * t[sound]).sum(axis=1)
            length[rows] = np.einsum("pi,pij,pj->p", first, squared[sound], first)
            own[rows] = first[:, 0]
    return fit, length, own


def loess(x: np.ndarray, y: np.ndarray, span: float, points: int) -> dict[str, np.ndarray | float] | None:
    """Curve at ``points`` places from the first to the last ``x``: at, fit, error; and sigma and freedom of the whole fit.

    The residual variance is the residual sum of squares over the trace of (I - L)(I - L)', L being the operator that
    takes observations to their fits. None where the span covers no three distinct places.
    """
    near = min(len(x), int(len(x) * span + 1e-5))
    if near < 3:
        return None
    seen, length, own = local_quadratic(x, y, x, near)
    if np.isnan(seen).any():
        return None
    freedom = len(x) - 2 * own.sum() + length.sum()
    sigma = float(np.sqrt(((y - seen) ** 2).sum() / freedom)) if freedom > 1e-9 else np.nan
    at = x[0] + (x[-1] - x[0]) * np.arange(points) / max(1, points - 1)
    fit, length, _ = local_quadratic(x, y, at, near)
    return {"at": at, "fit": fit, "error": sigma * np.sqrt(length), "sigma": sigma, "freedom": float(freedom)}
