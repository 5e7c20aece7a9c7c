"""Gradient-boosted regression trees on binned features with a logistic loss, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of fixed depth kept as arrays, so a batch is scored level by level."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 24, least: float = 5.0, damping: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.damping = trees, depth, rate, bins, least, damping

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        self.base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        score = np.full(n, self.base)
        nodes = (1 << self.depth) - 1
        self.feature = np.zeros((self.trees, nodes), np.int32)
        self.cut = np.full((self.trees, nodes), np.inf)
        self.leaf = np.zeros((self.trees, nodes + 1))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)  # position within the level
            for level in range(self.depth):
                width, first = 1 << level, (1 << level) - 1
                best, feature, cut = np.full(width, 1e-9), np.zeros(width, np.int32), np.full(width, np.inf)
                cut_bin = np.full(width, self.bins + 1)
                for j in range(m):
                    if not len(self.edges[j]):
                        continue
                    key = node * (self.bins + 1) + binned[:, j]
                    g = np.bincount(key, grad, width * (self.bins + 1)).reshape(width, -1).cumsum(axis=1)
                    h = np.bincount(key, hess, width * (self.bins + 1)).reshape(width, -1).cumsum(axis=1)
                    gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                    gain = gl**2 / (hl + self.damping) + (gt - gl) ** 2 / (ht - hl + self.damping) - gt**2 / (ht + self.damping)
                    gain[(hl < self.least / 10) | (ht - hl < self.least / 10)] = 0
                    gain[:, len(self.edges[j]) :] = 0
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(width), k]
                    better = top > best
                    best[better], feature[better], cut_bin[better] = top[better], j, k[better]
                    cut[better] = self.edges[j][k[better]]
                self.feature[t, first : first + width], self.cut[t, first : first + width] = feature, cut
                node = node * 2 + (binned[np.arange(n), feature[node]] > cut_bin[node])
            size = 1 << self.depth
            self.leaf[t] = self.rate * np.bincount(node, grad, size) / (np.bincount(node, hess, size) + self.damping)
            score += self.leaf[t][node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of class 1."""
        rows = np.arange(len(x))
        score = np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = node + (1 << level) - 1
                node = node * 2 + (x[rows, feature[at]] > cut[at])
            score += leaf[node]
        return 1 / (1 + np.exp(-score))
