"""Gradient-boosted decision trees with logistic loss on binned features, in numpy."""

from __future__ import annotations

import numpy as np


def _bins(x: np.ndarray, n: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1])) for j in range(x.shape[1])]


class Boosted:
    """``rounds`` trees of ``depth`` levels; a tree is arrays of features, cuts and leaf values in heap order."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.n_bins, self.l2 = rounds, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = _bins(x, self.n_bins)
        code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            tree, leaf = self._grow(code, g, h)
            self.trees.append(tree)
            score += tree[2][leaf]
        return self

    def _grow(self, code: np.ndarray, g: np.ndarray, h: np.ndarray):
        inner = (1 << self.depth) - 1
        feature, cut, node = np.full(inner, -1), np.zeros(inner, np.int64), np.zeros(len(g), np.int64)
        width = self.n_bins + 1
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            gt, ht = g[rows].sum(), h[rows].sum()
            top = 1e-6
            for j in range(code.shape[1] if len(rows) > 8 else 0):
                gl = np.cumsum(np.bincount(code[rows, j], g[rows], width))[:-1]
                hl = np.cumsum(np.bincount(code[rows, j], h[rows], width))[:-1]
                gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
                b = int(np.argmax(gain))
                if gain[b] > top:
                    top, feature[k], cut[k] = gain[b], j, b
            right = code[rows, feature[k]] > cut[k] if feature[k] >= 0 else np.zeros(len(rows), bool)
            node[rows] = 2 * k + 1 + right
        leaf = node - inner
        values = -self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.l2)
        return (feature, cut, values), leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (code[rows, np.maximum(f, 0)] > cut[node]))
            out += values[node - len(feature)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators calibration: ascending scores and the probability from each on."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, t in zip(score[order], y[order]):
        blocks.append([s, float(t), 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, t2, n2 = blocks.pop()
            blocks[-1][1] += t2
            blocks[-1][2] += n2
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])
