"""Gradient-boosted trees for small tables: trained on the driver, applied to arrays anywhere."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of shallow trees over binned features; a score is a probability."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, smallest: int = 8):
        self.trees, self.depth, self.rate, self.bins, self.smallest = trees, depth, rate, bins, smallest
        self.edges: list[np.ndarray] = []
        self.model: list[list[tuple]] = []
        self.start = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        f = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            tree, out = self._tree(b, y - p, np.maximum(p * (1 - p), 1e-6))
            self.model.append(tree)
            f += out
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[list[tuple], np.ndarray]:
        """Nodes (feature, bin, left, right) or (None, value); rows go left if their bin is at most the node's."""
        nodes: list[tuple] = []
        out = np.zeros(len(g))

        def grow(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append((None, 0.0))
            best = (1e-9, None)
            if depth < self.depth and len(rows) >= 2 * self.smallest:
                whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
                for j in range(b.shape[1]):
                    n = len(self.edges[j]) + 1
                    gs, hs, cs = (np.cumsum(np.bincount(b[rows, j], w, n))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                    gain = gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - whole
                    gain[(cs < self.smallest) | (len(rows) - cs < self.smallest)] = -1
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), (j, int(gain.argmax())))
            if best[1] is None:
                value = self.rate * g[rows].sum() / (h[rows].sum() + 1)
                nodes[at] = (None, value)
                out[rows] = value
            else:
                j, k = best[1]
                low = b[rows, j] <= k
                left = grow(rows[low], depth + 1)
                nodes[at] = (j, k, left, grow(rows[~low], depth + 1))
            return at

        grow(np.arange(len(g)), 0)
        return nodes, out

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        if not len(x):
            return np.empty(0)
        b = self._binned(x)
        f = np.full(len(x), self.start)
        for tree in self.model:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                for node in np.unique(at):
                    if tree[node][0] is not None:
                        j, k, left, right = tree[node]
                        rows = np.flatnonzero(at == node)
                        at[rows] = np.where(b[rows, j] <= k, left, right)
            f += np.array([n[1] if n[0] is None else 0.0 for n in tree])[at]
        return 1 / (1 + np.exp(-f))
