"""Generalised additive model with pairwise interactions, boosted in turn over features. Plain numpy, for small samples."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np

RIDGE = 1.0


@dataclass
class Gam:
    """Additive log-odds: ``edges`` cut each feature into bins; tables hold what a bin, or a pair of bins, adds."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        return score(vars(self), x)


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for every row: one table look-up and one addition per term. ``model``: fields of a Gam."""
    total = np.full(len(x), model["intercept"])
    for edges, table, column in zip(model["edges"], model["tables"], x.T, strict=True):
        total += table[np.searchsorted(edges, column, side="right")]
    coarse = model["coarse"]
    for (a, b), table in model["pairs"].items():
        total += table[np.searchsorted(coarse[a], x[:, a], side="right"), np.searchsorted(coarse[b], x[:, b], side="right")]
    return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Value per bin of a tree with up to three leaves over ordered bins with gradient and curvature sums g, h."""

    def best(lo: int, hi: int) -> tuple[float, int]:
        gs, hs = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        if hi - lo < 2:
            return 0.0, lo
        left, right = gs[:-1] ** 2 / (hs[:-1] + RIDGE), (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + RIDGE)
        gain = left + right - gs[-1] ** 2 / (hs[-1] + RIDGE)
        k = int(np.argmax(gain))
        return float(gain[k]), lo + k + 1

    n = len(g)
    cuts = [0, n]
    for _ in range(2):
        options = [best(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        gain, at = max(options)
        if gain <= 1e-9:
            break
        cuts = sorted([*cuts, at])
    out = np.zeros(n)
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a grid of bins into four parts: its gain, and the value of every cell."""
    cg, ch = (np.pad(m, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for m in (g, h))
    part = lambda c: (c[1:-1, 1:-1], c[1:-1, -1:] - c[1:-1, 1:-1], c[-1:, 1:-1] - c[1:-1, 1:-1], c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + c[1:-1, 1:-1])
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    quarters = list(zip(part(cg), part(ch), strict=True))
    gain = sum(a**2 / (b + RIDGE) for a, b in quarters)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = [a[i, j] / (b[i, j] + RIDGE) for a, b in quarters]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + RIDGE)), out


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, rounds: int = 150, pair_rounds: int = 60,
    pairs: int = 6, rate: float = 0.15,
) -> Gam:
    """Fit by cyclic boosting: every round passes over the features, each time one small tree with a small step.

    Afterwards pairs are ranked by the gain of their best four-way cut on what the features leave unexplained, and the
    best ones are boosted in the same way. No rows: probability one half everywhere; one label only: close to it.
    """
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    width = x.shape[1]
    cut = lambda c, n: np.unique(np.quantile(c, np.arange(1, n) / n)) if len(c) else np.zeros(0)
    model = Gam([cut(x[:, j], bins) for j in range(width)], [cut(x[:, j], coarse_bins) for j in range(width)])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not len(y):
        return model
    prior = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(prior / (1 - prior)))
    fine = [np.searchsorted(model.edges[j], x[:, j], side="right") for j in range(width)]
    rough = [np.searchsorted(model.coarse[j], x[:, j], side="right") for j in range(width)]
    total = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j in range(width):
            p = 1 / (1 + np.exp(-total))
            n = len(model.tables[j])
            step = rate * _tree(np.bincount(fine[j], y - p, n), np.bincount(fine[j], p * (1 - p), n))
            model.tables[j] += step
            total += step[fine[j]]
    p = 1 / (1 + np.exp(-total))

    def grid(a: int, b: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        cell = rough[a] * shape[1] + rough[b]
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))

    ranked = sorted(((_quadrants(*grid(a, b, p))[0], (a, b)) for a, b in combinations(range(width), 2)), key=lambda t: (-t[0], t[1]))
    model.pairs = {pair: np.zeros((len(model.coarse[pair[0]]) + 1, len(model.coarse[pair[1]]) + 1)) for gain, pair in ranked[:pairs] if gain > 0}
    for _ in range(pair_rounds):
        for (a, b), table in model.pairs.items():
            p = 1 / (1 + np.exp(-total))
            step = rate * _quadrants(*grid(a, b, p))[1]
            table += step
            total += step[rough[a], rough[b]]
    return model
