"""Gradient-boosted trees for a yes/no label, on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, depth-wise trees of fixed depth, Newton leaf values. Trained where it is used; deterministic."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 24, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2
        self.base = 0.0
        self.forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (feature, threshold) of inner nodes, leaf values

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        weight = np.ones(len(y)) if weight is None else weight
        n, f = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        mean = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = weight * (p - y), weight * p * (1 - p) + 1e-6
            inner = 2**self.depth - 1
            feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                own = node - first
                best = np.zeros(width)
                for j in range(f):
                    k = len(cuts[j]) + 1
                    if k < 2:
                        continue
                    spot = own * k + binned[:, j]
                    g = np.bincount(spot, grad, width * k).reshape(width, k).cumsum(1)
                    h = np.bincount(spot, hess, width * k).reshape(width, k).cumsum(1)
                    gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    for w in np.flatnonzero(top > best + 1e-9):
                        best[w], feature[first + w], threshold[first + w] = top[w], j, cuts[j][at[w]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
            leaf = node - inner
            leaves = 2**self.depth
            value = -self.rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + self.l2)
            score += value[leaf]
            self.forest.append((feature, threshold, value))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in self.forest:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            score += value[node - (2**self.depth - 1)]
        return score
