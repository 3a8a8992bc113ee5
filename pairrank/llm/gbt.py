"""Gradient-boosted trees for two classes and isotonic calibration, in numpy, for small fits."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of complete trees of fixed depth over quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, smooth: float = 1.0, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.smooth, self.least = rounds, depth, rate, bins, smooth, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(c, quantiles)) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)])
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
        self.start = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.start)
        inner = 2**self.depth - 1
        self.feature = np.zeros((self.rounds, inner), np.int64)
        self.cut = np.full((self.rounds, inner), np.inf)
        self.leaf = np.zeros((self.rounds, inner + 1))
        for tree in range(self.rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-margin))
            slope, curve = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                gain, choice = np.full(count, 1e-9), [None] * count
                sums = np.bincount(node, slope, count), np.bincount(node, curve, count)
                for f, edges in enumerate(self.edges):
                    if not len(edges):
                        continue
                    cells = node * (len(edges) + 1) + binned[:, f]
                    left = [np.cumsum(np.bincount(cells, w, count * (len(edges) + 1)).reshape(count, -1), axis=1)[:, :-1] for w in (slope, curve)]
                    right = [s[:, None] - a for s, a in zip(sums, left)]
                    score = left[0]**2 / (left[1] + self.smooth) + right[0]**2 / (right[1] + self.smooth)
                    score -= (sums[0]**2 / (sums[1] + self.smooth))[:, None]
                    score[np.minimum(left[1], right[1]) * 4 < self.least] = 0
                    top = score.argmax(axis=1)
                    for k in np.flatnonzero(score[np.arange(count), top] > gain):
                        gain[k], choice[k] = score[k, top[k]], (f, edges[top[k]])
                for k, chosen in enumerate(choice):
                    if chosen:
                        self.feature[tree, first + k], self.cut[tree, first + k] = chosen
                node = 2 * node + (x[np.arange(len(y)), self.feature[tree, first + node]] > self.cut[tree, first + node])
            total = np.bincount(node, slope, inner + 1) / (np.bincount(node, curve, inner + 1) + self.smooth)
            self.leaf[tree] = self.rate * total
            margin += self.leaf[tree][node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            out += leaf[node]
        return out


class Isotonic:
    """Least-squares non-decreasing map (pooled adjacent violators), linear between block centres."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        blocks: list[list[float]] = []  # mean of y, weight, sum of x
        for a, b in zip(x[order], y[order]):
            blocks.append([float(b), 1.0, float(a)])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m, w, s = blocks.pop()
                last = blocks[-1]
                last[0] = (last[0] * last[1] + m * w) / (last[1] + w)
                last[1] += w
                last[2] += s
        # One virtual row of each class keeps the ends off 0 and 1, so order within a block still shows.
        self.x = np.array([s / w for _, w, s in blocks]) if blocks else np.zeros(1)
        self.y = np.array([(m * w + 0.5) / (w + 1) for m, w, _ in blocks]) if blocks else np.full(1, 0.5)
        self.y = np.maximum.accumulate(self.y)
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)
