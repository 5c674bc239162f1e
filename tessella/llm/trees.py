"""Gradient-boosted regression trees for two classes, on numpy arrays."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Trees of one depth, each a full binary tree of (feature, threshold) with a value for every leaf."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 30, depth: int = 4, rate: float = 0.35, ridge: float = 1.0) -> None:
        self.depth = depth
        quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], quantiles)) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)])
        rate_of = np.average(y, weights=weight)
        self.start = float(np.log(rate_of / (1 - rate_of)))
        self.feature, self.threshold, self.value = [], [], []
        margin = np.full(len(y), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            self._grow(x, binned, weight * (y - p), weight * p * (1 - p), rate, ridge)
            margin += self._tree(x, len(self.feature) - 1)

    def _grow(self, x: np.ndarray, binned: np.ndarray, gradient: np.ndarray, curve: np.ndarray, rate: float, ridge: float) -> None:
        inner = 2**self.depth - 1
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(x), int)
        for level in range(self.depth):
            first, n = 2**level - 1, 2**level
            at = node - first
            best = np.full(n, 1e-6)
            for f, edges in enumerate(self.edges):
                if not len(edges):
                    continue
                k = len(edges) + 1
                g = np.bincount(at * k + binned[f], gradient, n * k).reshape(n, k).cumsum(1)
                h = np.bincount(at * k + binned[f], curve, n * k).reshape(n, k).cumsum(1)
                gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                cut = gain[:, :-1].argmax(1)
                found = gain[np.arange(n), cut]
                for j in np.flatnonzero(found > best):
                    best[j], feature[first + j], threshold[first + j] = found[j], f, edges[cut[j]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, curve, inner + 1) + ridge)
        self.feature.append(feature)
        self.threshold.append(threshold)
        self.value.append(value)

    def _tree(self, x: np.ndarray, k: int) -> np.ndarray:
        node, rows = np.zeros(len(x), int), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[k][node]] > self.threshold[k][node])
        return self.value[k][node - (2**self.depth - 1)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        out = np.full(len(x), self.start)
        for k in range(len(self.feature)):
            out += self._tree(x, k)
        return out
