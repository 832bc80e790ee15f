"""Generalised additive model with pairwise interactions, fitted by cyclic boosting of shallow trees.

Every feature is cut into bins. Boosting goes round the features: a tree of at most three leaves over the bins of one
feature lowers the logistic loss and is added to that feature's lookup table, so no feature can take the part of
another. The pairs whose residuals gain most from a four-leaf tree get two-dimensional tables in the same way. A score
is the sum of one table entry per feature and pair, turned into a probability.
"""

from __future__ import annotations

import dataclasses

import numpy as np

PAIR_BINS = 8


def bin_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Quantiles, and the least value on its own: what lies between it and the next seen value sides with the latter."""
    if not len(x):
        return np.zeros(0)
    return np.unique(np.append(np.quantile(x, np.arange(1, bins) / bins), np.nextafter(x.min(), np.inf)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclasses.dataclass
class AdditiveModel:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, f], "right")]
        if self.pairs:
            small = {f: np.searchsorted(self.coarse[f], x[:, f], "right") for p in self.pairs for f in p}
            for (a, b), grid in zip(self.pairs, self.grids, strict=True):
                z += grid[small[a], small[b]]
        return sigmoid(z)


def _line_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf value per bin of a tree with up to three leaves over ordered bins."""
    leaves = [(0, len(g))]
    sums = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))

    def gain(lo, hi):
        d = sums[0][hi] - sums[0][lo]
        return d * d / (sums[1][hi] - sums[1][lo] + ridge)

    for _ in range(2):
        best = (1e-12, None, None)
        for lo, hi in leaves:
            if hi - lo > 1:
                cuts = np.arange(lo + 1, hi)
                got = gain(lo, cuts) + gain(cuts, hi) - gain(lo, hi)
                k = int(np.argmax(got))
                if got[k] > best[0]:
                    best = (got[k], (lo, hi), int(cuts[k]))
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for lo, hi in leaves:
        out[lo:hi] = -(sums[0][hi] - sums[0][lo]) / (sums[1][hi] - sums[1][lo] + ridge)
    return out


def _cross_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Best tree that cuts each of two axes once: its gain and leaf values on the grid."""
    G, H = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h))
    m, n = g.shape
    i, j = np.meshgrid(np.arange(1, max(m, 2)), np.arange(1, max(n, 2)), indexing="ij")
    i, j = np.minimum(i, m), np.minimum(j, n)
    quarter = lambda S: (S[i, j], S[i, n] - S[i, j], S[m, j] - S[i, j], S[m, n] - S[i, n] - S[m, j] + S[i, j])
    gs, hs = quarter(G), quarter(H)
    got = sum(a * a / (b + ridge) for a, b in zip(gs, hs, strict=True))
    k = np.unravel_index(int(np.argmax(got)), got.shape)
    out = np.zeros((m, n))
    cut = i[k], j[k]
    for value, rows, cols in zip([-a[k] / (b[k] + ridge) for a, b in zip(gs, hs, strict=True)], (slice(0, cut[0]), slice(0, cut[0]), slice(cut[0], m), slice(cut[0], m)), (slice(0, cut[1]), slice(cut[1], n), slice(0, cut[1]), slice(cut[1], n)), strict=True):
        out[rows, cols] = value
    return float(got[k]), out


def fit_additive(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 120, rate: float = 0.15, pairs: int = 6, pair_rounds: int = 40, ridge: float = 2.0) -> AdditiveModel:
    """Deterministic fit; without rows, or with one class only, the score is the (smoothed) share of label 1."""
    n, d = x.shape
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    edges = [bin_edges(x[:, f], bins) for f in range(d)]
    coarse = [bin_edges(x[:, f], PAIR_BINS) for f in range(d)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if n == 0 or y.min() == y.max():
        return AdditiveModel(edges, tables, coarse, [], [], base)
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    z = np.full(n, base)
    for _ in range(rounds):
        for f in range(d):
            p = sigmoid(z)
            size = len(tables[f])
            step = rate * _line_tree(np.bincount(at[f], p - y, size), np.bincount(at[f], p * (1 - p), size), ridge)
            tables[f] += step
            z += step[at[f]]
    small = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]

    def grid(a: int, b: int, w: np.ndarray) -> np.ndarray:
        m, k = len(coarse[a]) + 1, len(coarse[b]) + 1
        return np.bincount(small[a] * k + small[b], w, m * k).reshape(m, k)

    p = sigmoid(z)
    gains = sorted(((_cross_tree(grid(a, b, p - y), grid(a, b, p * (1 - p)), ridge)[0], a, b) for a in range(d) for b in range(a)), reverse=True)
    chosen = [(a, b) for _, a, b in gains[:pairs]]
    grids = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in chosen]
    for _ in range(pair_rounds):
        for (a, b), table in zip(chosen, grids, strict=True):
            p = sigmoid(z)
            step = rate * _cross_tree(grid(a, b, p - y), grid(a, b, p * (1 - p)), ridge)[1]
            table += step
            z += step[small[a], small[b]]
    return AdditiveModel(edges, tables, coarse, chosen, grids, base)
