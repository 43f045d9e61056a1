"""Gradient boosted trees for small tables, in NumPy: logistic loss, depth-limited trees on binned features."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 16, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        share = y.mean()
        self.start = float(np.log(share / (1 - share)))
        f, self.trees = np.full(len(y), self.start), []
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f = f + self.rate * self._leaf(tree, b)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], 1)

    def _grow(self, b: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> list:
        """Nodes in heap order: (feature, bin) or the leaf's value."""
        tree: list = [None] * (2 ** (self.depth + 1) - 1)
        rows = {0: np.arange(len(b))}
        for node in range(len(tree)):
            if node not in rows:
                continue
            own = rows[node]
            g, h = grad[own], hess[own]
            best = (1e-9, None)
            if node < 2**self.depth - 1 and len(own) >= 10:
                total = g.sum() ** 2 / (h.sum() + self.ridge)
                for j in range(b.shape[1]):
                    k = len(self.cuts[j]) + 1
                    gs, hs = np.cumsum(np.bincount(b[own, j], g, k)), np.cumsum(np.bincount(b[own, j], h, k))
                    gain = gs**2 / (hs + self.ridge) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + self.ridge) - total
                    i = int(np.argmax(gain[:-1])) if k > 1 else 0
                    if k > 1 and gain[i] > best[0]:
                        best = (float(gain[i]), (j, i))
            if best[1] is None:
                tree[node] = float(g.sum() / (h.sum() + self.ridge))
            else:
                tree[node] = best[1]
                left = b[own, best[1][0]] <= best[1][1]
                rows[2 * node + 1], rows[2 * node + 2] = own[left], own[~left]
        return tree

    def _leaf(self, tree: list, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(b))
        rows = {0: np.arange(len(b))}
        for node, what in enumerate(tree):
            own = rows.get(node)
            if own is None or not len(own):
                continue
            if isinstance(what, float):
                out[own] = what
            else:
                left = b[own, what[0]] <= what[1]
                rows[2 * node + 1], rows[2 * node + 2] = own[left], own[~left]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        b, f = self._binned(x), np.full(len(x), self.start)
        for tree in self.trees:
            f = f + self.rate * self._leaf(tree, b)
        return 1 / (1 + np.exp(-f))
