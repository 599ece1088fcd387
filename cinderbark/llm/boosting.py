"""Histogram gradient-boosted trees for a binary label, trained in numpy.

Features are binned once (at most ``BINS`` quantile bins each); a tree grows
level by level from histograms of gradients and Hessians.  Trees are complete
binary trees of one depth, so a model is three arrays, and scoring walks all
rows down one level at a time with whole-array operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Forest:
    """``feature``, ``cut``: (trees, 2**depth - 1), heap order; ``leaf``: (trees, 2**depth).

    A row goes right if its value is greater than the cut.
    """

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float

    @property
    def depth(self) -> int:
        return int(self.leaf.shape[1]).bit_length() - 1

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - (len(leaf) - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(x)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, least: int = 8, ridge: float = 1.0) -> Forest:
    """Fit ``y`` (0 or 1).  Without rows the score is one half; with one class only, near that class."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, m = x.shape
    inner = 2**depth - 1
    mean = (y.sum() + 0.5) / (n + 1.0)
    bias = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    binned = np.column_stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)]) if n else np.zeros((0, m), int)
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    raw = np.full(n, bias)
    for t in range(trees if n and 0 < y.sum() < n else 0):
        p = 1.0 / (1.0 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            base = (at - first) * (BINS + 1)
            gain_best = np.zeros(nodes)
            for j in range(m):
                if not len(cuts[j]):
                    continue
                key = base + binned[:, j]
                size = nodes * (BINS + 1)
                gs, hs, cs = (np.bincount(key, w, size).reshape(nodes, -1).cumsum(axis=1) for w in (g, h, None))
                left_g, left_h, left_c = gs[:, : len(cuts[j])], hs[:, : len(cuts[j])], cs[:, : len(cuts[j])]
                all_g, all_h, all_c = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                gain[(left_c < least) | (all_c - left_c < least)] = 0.0
                k = gain.argmax(axis=1)
                best = gain[np.arange(nodes), k]
                better = best > gain_best + 1e-12
                gain_best[better] = best[better]
                feature[t, first : first + nodes][better] = j
                cut[t, first : first + nodes][better] = cuts[j][k[better]]
            at = 2 * at + 1 + (x[np.arange(n), feature[t][at]] > cut[t][at])
        slot = at - inner
        leaf[t] = rate * np.bincount(slot, g, inner + 1) / (np.bincount(slot, h, inner + 1) + ridge)
        raw += leaf[t][slot]
    return Forest(feature, cut, leaf, bias)
