"""Gradient-boosted trees on histograms and isotonic calibration, in numpy: for bounded training samples."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class BoostedTrees:
    """Binary logistic boosting; trees are complete, of fixed depth, with splits on quantile bins."""

    trees: int = 50
    depth: int = 3
    rate: float = 0.15
    bins: int = 48
    l2: float = 2.0
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    features: np.ndarray | None = None  # (trees, 2**depth - 1)
    cuts: np.ndarray | None = None
    leaves: np.ndarray | None = None  # (trees, 2**depth)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        n, f = x.shape
        w = np.ones(n) if weight is None else weight
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)
        width = self.bins
        flat = binned + np.arange(f) * width
        inner, total = 2**self.depth - 1, f * width
        mean = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        self.features, self.cuts, self.leaves = np.zeros((self.trees, inner), np.int32), np.full((self.trees, inner), np.inf), np.zeros((self.trees, 2**self.depth))
        score = np.full(n, self.base)
        for t in range(self.trees):
            p = sigmoid(score)
            g, h = w * (p - y), w * np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                k = 2**level
                key = (node[:, None] * total + flat).ravel()
                gs = np.bincount(key, np.repeat(g, f), k * total).reshape(k, f, width).cumsum(2)
                hs = np.bincount(key, np.repeat(h, f), k * total).reshape(k, f, width).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                gain[(hs < 1.0) | (ht - hs < 1.0)] = 0
                best = gain.reshape(k, -1).argmax(1)
                bf, bb = best // width, best % width
                for i in range(k):
                    at = k - 1 + i
                    if gain[i, bf[i], bb[i]] > 1e-6 and bb[i] < len(self.edges[bf[i]]):
                        self.features[t, at], self.cuts[t, at] = bf[i], self.edges[bf[i]][bb[i]]
                node = 2 * node + (x[np.arange(n), self.features[t, k - 1 + node]] > self.cuts[t, k - 1 + node])
            gl, hl = np.bincount(node, g, 2**self.depth), np.bincount(node, h, 2**self.depth)
            self.leaves[t] = -self.rate * gl / (hl + self.l2)
            score += self.leaves[t][node]
        return self

    def leaf_ids(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each tree in which a row ends."""
        out, rows = np.empty((len(x), self.trees), np.uint8), np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, self.features[t, at]] > self.cuts[t, at])
            out[:, t] = node
        return out

    def at_leaves(self, ids: np.ndarray) -> np.ndarray:
        """Log-odds of rows given by leaf_ids()."""
        out = np.full(len(ids), self.base)
        for t in range(self.trees):
            out += self.leaves[t][ids[:, t]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        return self.at_leaves(self.leaf_ids(x))

    def leaf_sums(self, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        """(trees, leaves): sums of a value of each row over the leaves of each tree."""
        n = 2**self.depth
        key = ids.astype(np.int64) + np.arange(self.trees) * n
        return np.bincount(key.ravel(), np.repeat(values, self.trees), self.trees * n).reshape(self.trees, n)

    def step(self, gradient: np.ndarray, hessian: np.ndarray) -> None:
        """Move the leaves by the mean over the trees of the Newton step that each tree's leaves would make alone."""
        self.leaves = np.round(self.leaves - gradient / (hessian + self.l2) / self.trees, 9)


class Isotonic:
    """Pool-adjacent-violators; between the pooled points scores are interpolated."""

    def __init__(self, score: np.ndarray, y: np.ndarray):
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of y, count, sum of score
        for s, v in zip(score[order], y[order], strict=True):
            blocks.append([v, 1.0, s])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        b = np.array(blocks)
        self.x, self.p = b[:, 2] / b[:, 1], (b[:, 0] + 0.5 * y.mean()) / (b[:, 1] + 0.5)  # shrunk a little toward the mean
        self.p = np.maximum.accumulate(self.p)

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.p)
