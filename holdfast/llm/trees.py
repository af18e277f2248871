"""Gradient-boosted trees for several classes on a bounded training matrix, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Histogram trees boosted on the softmax loss, with a temperature and a bias for each class for calibrated probabilities.

    The fit is deterministic. ``thresholds`` cut each feature into at most ``bins`` bins by quantiles.
    """

    def __init__(self, classes: int, rounds: int = 14, depth: int = 4, rate: float = 0.4, bins: int = 32, min_leaf: int = 20, l2: float = 1.0):
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.min_leaf, self.l2 = classes, rounds, depth, rate, bins, min_leaf, l2
        self.temperature, self.bias = 1.0, np.zeros(classes)
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        n, f = x.shape
        w = np.ones(n) if weight is None else weight
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        b = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1)
        score = np.zeros((n, self.classes))
        onehot = np.eye(self.classes)[y]
        for _ in range(self.rounds):
            p = self._soft(score)
            turn = []
            for k in range(self.classes):
                g, h = (p[:, k] - onehot[:, k]) * w, np.maximum(p[:, k] * (1 - p[:, k]), 1e-6) * w
                tree = self._tree(b, g, h)
                turn.append(tree)
                score[:, k] += self._walk(tree, x)
            self.trees.append(turn)
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arrays of a full binary tree: feature (-1 in leaves), threshold, value."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        todo = [(0, np.arange(len(g)))]
        while todo:
            node, rows = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = -self.rate * gs / (hs + self.l2)
            if 2 * node + 2 >= size or len(rows) < 2 * self.min_leaf:
                continue
            best = (1e-6, -1, 0)
            for j, c in enumerate(self.cuts):
                if not len(c):
                    continue
                gb = np.bincount(b[rows, j], g[rows], len(c) + 1).cumsum()[:-1]
                hb = np.bincount(b[rows, j], h[rows], len(c) + 1).cumsum()[:-1]
                nb = np.bincount(b[rows, j], minlength=len(c) + 1).cumsum()[:-1]
                gain = gb**2 / (hb + self.l2) + (gs - gb) ** 2 / (hs - hb + self.l2) - gs**2 / (hs + self.l2)
                gain[(nb < self.min_leaf) | (len(rows) - nb < self.min_leaf)] = 0
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), j, i)
            if best[1] < 0:
                continue
            feature[node], cut[node] = best[1], self.cuts[best[1]][best[2]]
            left = b[rows, best[1]] <= best[2]
            todo += [(2 * node + 1, rows[left]), (2 * node + 2, rows[~left])]
        return feature, cut, value

    def _walk(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            f = feature[at]
            down = 2 * at + 1 + (x[rows, np.maximum(f, 0)] >= cut[at])
            at = np.where(f >= 0, down, at)
        return value[at]

    @staticmethod
    def _soft(score: np.ndarray) -> np.ndarray:
        e = np.exp(score - score.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.classes))
        for turn in self.trees:
            for k, tree in enumerate(turn):
                out[:, k] += self._walk(tree, x)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._soft(self.scores(x) / self.temperature + self.bias)

    def calibrate(self, x: np.ndarray, y: np.ndarray, l2: float = 0.1, steps: int = 200) -> BoostedTrees:
        """Choose the temperature and the bias of each class under which the held-out rows are likeliest, classes weighing the same.

        Biases are held small by ``l2``; they shift the border between classes, so that probabilities decide otherwise than scores.
        """
        s, n = self.scores(x), np.bincount(y, minlength=self.classes)
        w = 1 / (np.maximum(n, 1)[y] * (n > 0).sum())
        onehot = np.eye(self.classes)[y]
        best = (np.inf, 1.0, np.zeros(self.classes))
        for t in np.exp(np.linspace(np.log(0.25), np.log(8.0), 57)):
            bias = np.zeros(self.classes)
            for _ in range(steps):
                bias -= 1.0 * (((self._soft(s / t + bias) - onehot) * w[:, None]).sum(0) + l2 * bias)
            loss = -(w * np.log(np.maximum(self._soft(s / t + bias)[np.arange(len(y)), y], 1e-12))).sum() + l2 / 2 * (bias**2).sum()
            if loss < best[0]:
                best = (loss, float(t), bias - bias.mean())
        _, self.temperature, self.bias = best
        return self
