"""Gradient-boosted trees with logistic loss on binned features, in numpy; fitted on the driver on a bounded sample."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, least: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.base = 0.0
        self.edges: list[np.ndarray] = []
        self.feature = np.zeros((0, 0), dtype=np.int64)
        self.cut = np.zeros((0, 0), dtype=np.int64)
        self.leaf = np.zeros((0, 0))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """x: rows by features; y: 0 or 1. Without both classes the model is a constant."""
        n, width = x.shape
        inner = 2**self.depth - 1
        self.feature = np.zeros((self.rounds, inner), dtype=np.int64)
        self.cut = np.full((self.rounds, inner), 255, dtype=np.int64)
        self.leaf = np.zeros((self.rounds, inner + 1))
        p = (y.sum() + 0.5) / (n + 1.0)
        self.base = float(np.log(p / (1 - p)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
        if not n or y.min() == y.max():
            return self
        b = self._binned(x)
        score = np.full(n, self.base)
        for r in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            grad, hess = y - q, q * (1 - q) + 1e-9
            node = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                count = 2**level
                best = np.full(count, 1e-6)
                pick, at = np.zeros(count, dtype=np.int64), np.full(count, 255, dtype=np.int64)
                for j in range(width):
                    k = node * self.bins + b[:, j]
                    g = np.bincount(k, grad, count * self.bins).reshape(count, -1).cumsum(1)
                    h = np.bincount(k, hess, count * self.bins).reshape(count, -1).cumsum(1)
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
                    gain[(h < self.least) | (ht - h < self.least)] = 0
                    top = gain.argmax(1)
                    won = gain[np.arange(count), top] > best
                    best = np.where(won, gain[np.arange(count), top], best)
                    pick, at = np.where(won, j, pick), np.where(won, top, at)
                own = slice(count - 1, 2 * count - 1)
                self.feature[r, own], self.cut[r, own] = pick, at
                node = 2 * node + (b[np.arange(n), pick[node]] > at[node])
            size = 2**self.depth
            value = self.rate * np.bincount(node, grad, size) / (np.bincount(node, hess, size) + 1)
            self.leaf[r] = value
            score = score + value[node]
        return self

    def decide(self, x: np.ndarray) -> np.ndarray:
        """The log odds of each row."""
        score = np.full(len(x), self.base)
        if not len(x) or not self.leaf.any():
            return score
        b = self._binned(x)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                k = node + 2**level - 1
                node = 2 * node + (b[rows, feature[k]] > cut[k])
            score += leaf[node]
        return score

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.decide(x)))
