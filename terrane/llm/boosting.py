"""Gradient-boosted trees for two classes on dense features, in NumPy: small, seeded and exact to rerun."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 16


@dataclass(frozen=True)
class Forest:
    """Complete binary trees: feature and threshold of each inner node, value of each leaf."""

    start: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 of each row."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1]))
        for f, t, v in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (len(v) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 70, depth: int = 4, rate: float = 0.25, least: float = 5.0, ridge: float = 1.0, share: float = 0.4, seed: int = 0) -> Forest:
    """Trees on the logistic loss, grown level by level over histograms of at most BINS bins, each on a seeded share of the rows."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    limits = np.full((k, BINS), np.inf)
    for j, c in enumerate(cuts):
        limits[j, : len(c)] = c
    rate_of_one = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(rate_of_one / (1 - rate_of_one)))
    margin, columns = np.full(n, start), np.arange(k) * BINS
    features, thresholds, leaves = [], [], []
    rng = np.random.default_rng(seed)
    for _ in range(trees):
        some = rng.random(n) < share if n > 2000 else np.ones(n, bool)
        p = 1 / (1 + np.exp(-margin))
        g, h = (y - p)[some], np.maximum(p * (1 - p), 1e-6)[some]
        bins, g_wide, h_wide = columns[None, :] + binned[some], np.repeat(g, k), np.repeat(h, k)
        at, own_x = np.zeros(len(g), np.int64), x[some]
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            width, base = 2**level, 2**level - 1
            code = ((at - base)[:, None] * (k * BINS) + bins).ravel()
            gs = np.bincount(code, g_wide, width * k * BINS).reshape(width, k, BINS).cumsum(2)
            hs = np.bincount(code, h_wide, width * k * BINS).reshape(width, k, BINS).cumsum(2)
            g_all, h_all = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + ridge) + (g_all - gs) ** 2 / (h_all - hs + ridge) - g_all**2 / (h_all + ridge)
            gain[(hs < least * 0.1) | (h_all - hs < least * 0.1) | ~np.isfinite(limits)[None]] = -1
            best = gain.reshape(width, -1).argmax(1)
            f, b = best // BINS, best % BINS
            good = gain.reshape(width, -1).max(1) > 1e-9
            feature[base : base + width] = f
            threshold[base : base + width] = np.where(good, limits[f, b], np.inf)
            own = at - base
            at = 2 * at + 1 + (own_x[np.arange(len(g)), f[own]] > threshold[base : base + width][own])
        leaf = at - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        features.append(feature), thresholds.append(threshold), leaves.append(value)
        margin += Forest(0.0, feature[None], threshold[None], value[None]).margin(x)
    return Forest(start, np.array(features), np.array(thresholds), np.array(leaves))
