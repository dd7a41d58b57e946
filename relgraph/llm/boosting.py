"""Gradient-boosted regression trees on a bounded table of features, in NumPy."""

from __future__ import annotations

import numpy as np

BINS = 64


class BoostedTrees:
    """Least-squares boosting of depth-limited trees over binned features.

    Rows may carry weights. Training is deterministic. A model is a few arrays and travels to the workers as it is.
    """

    def __init__(self, trees: int = 160, depth: int = 4, rate: float = 0.08, least_weight: float = 5.0, shrink: float = 3.0):
        self.trees, self.depth, self.rate, self.least_weight, self.shrink = trees, depth, rate, least_weight, shrink

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=np.int64)
        for j, e in enumerate(self.edges):
            out[:, j] = np.searchsorted(e, x[:, j], side="right")
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        w = np.ones(len(y)) if weight is None else weight.astype(float)
        qs = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], qs)) for j in range(x.shape[1])]
        b = self._binned(x)
        n, m = b.shape
        self.base = float(np.average(y, weights=w))
        pred = np.full(n, self.base)
        flat = b + np.arange(m) * BINS
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature, self.cut, self.value = [], [], []
        for _ in range(self.trees):
            grad = (y - pred) * w
            node = np.zeros(n, dtype=np.int64)  # place within the level
            feature, cut = np.full(inner, -1), np.zeros(inner, dtype=np.int64)
            for level in range(self.depth):
                k = 2**level
                key = (node[:, None] * (m * BINS) + flat).ravel()
                g = np.bincount(key, np.repeat(grad, m), minlength=k * m * BINS).reshape(k, m, BINS).cumsum(2)
                c = np.bincount(key, np.repeat(w, m), minlength=k * m * BINS).reshape(k, m, BINS).cumsum(2)
                gt, ct = g[:, :1, -1:], c[:, :1, -1:]
                gr, cr = gt - g, ct - c
                gain = g**2 / (c + self.shrink) + gr**2 / (cr + self.shrink) - gt**2 / (ct + self.shrink)
                gain[(c < self.least_weight) | (cr < self.least_weight)] = -1
                best = gain.reshape(k, -1).argmax(1)
                good = gain.reshape(k, -1)[np.arange(k), best] > 1e-9
                f, t = best // BINS, best % BINS
                at = k - 1 + np.arange(k)
                feature[at], cut[at] = np.where(good, f, -1), t
                right = good[node] & (b[np.arange(n), f[node]] > t[node])
                node = node * 2 + right
            sums = np.bincount(node, grad, minlength=leaves)
            value = self.rate * sums / (np.bincount(node, w, minlength=leaves) + self.shrink)
            pred += value[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.value.append(value)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        rows = np.arange(len(b))
        pred = np.full(len(b), self.base)
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(b), dtype=np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                f = feature[at]
                node = node * 2 + ((f >= 0) & (b[rows, f] > cut[at]))
            pred += value[node]
        return pred
