"""Gradient-boosted trees on a small labelled sample, with histograms, in numpy: logistic loss, depth-limited trees, deterministic."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """fit on the driver; the trees are a few kilobytes and travel with the function that applies them."""

    def __init__(self, trees: int = 70, depth: int = 5, rate: float = 0.2, bins: int = 32, least: int = 6, ridge: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        cuts = [self._cuts(x[:, j]) for j in range(m)]
        width = self.bins  # at most bins - 1 cuts
        codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.int32)
        places = codes + np.arange(m, dtype=np.int32) * width
        open_bins = np.array([[b < len(c) for b in range(width)] for c in cuts])
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(n, self.base)
        size = 2 ** (self.depth + 1) - 1

        def sums(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
            """Gradients, curvatures and rows in every bin of every feature: one histogram for all features."""
            at_bins = places[rows].ravel()
            return np.stack([np.bincount(at_bins, weights=None if w is None else np.repeat(w[rows], m), minlength=m * width) for w in (g, h, None)])

        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-score))
            g, h = q - y, q * (1 - q)
            feature, limit, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            members, bins = {0: np.arange(n)}, {}
            for node in range(size):
                mine = members.pop(node, None)
                if mine is None:
                    continue
                gs, hs = g[mine].sum(), h[mine].sum()
                value[node] = -self.rate * gs / (hs + self.ridge)
                if 2 * node + 2 >= size or len(mine) < 2 * self.least:
                    continue
                whole = bins.pop(node) if node in bins else sums(mine, g, h)
                gl, hl, nl = whole.reshape(3, m, width).cumsum(axis=2)
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(nl < self.least) | (len(mine) - nl < self.least) | ~open_bins] = -1
                j, b = divmod(int(gain.argmax()), width)
                if gain[j, b] > 1e-6:
                    feature[node], limit[node] = j, cuts[j][b]
                    left = codes[mine, j] <= b
                    parts = {2 * node + 1: mine[left], 2 * node + 2: mine[~left]}
                    members |= parts
                    small = min(parts, key=lambda k: len(parts[k]))
                    if 2 * small + 2 < size:  # the larger part's sums are what the smaller one's leave
                        bins[small] = sums(parts[small], g, h)
                        bins[4 * node + 3 - small] = whole - bins[small]
            self.forest.append((feature, limit, value))
            score = score + self._apply(x, self.forest[-1])
        return self

    def _cuts(self, column: np.ndarray) -> np.ndarray:
        """Limits between a feature's values: all of them where they are few, so that a rare sign counts too, else quantiles."""
        values = np.unique(column)
        return values[:-1] if len(values) <= self.bins else np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1]))

    def _apply(self, x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, limit, value = tree
        at = np.zeros(len(x), dtype=int)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            go = x[rows, np.maximum(f, 0)] <= limit[at]
            at = np.where(inner, np.where(go, 2 * at + 1, 2 * at + 2), at)
        return value[at]

    def probability(self, x: np.ndarray, block: int = 1024) -> np.ndarray:
        """Of each row, all trees at once, in blocks of rows that fit the processor's cache."""
        feature, limit, value = (np.stack(part) for part in zip(*self.forest, strict=True))
        size, roots = feature.shape[1], np.arange(len(feature)) * feature.shape[1]
        goes, feature, limit, value = (feature >= 0).ravel(), np.maximum(feature, 0).ravel(), limit.ravel(), value.ravel()
        out = np.empty(len(x))
        for a in range(0, len(x), block):
            part = np.ascontiguousarray(x[a : a + block])
            rows = (np.arange(len(part)) * x.shape[1])[:, None]
            flat, at = part.ravel(), np.zeros((len(part), len(roots)), dtype=np.int64) + roots
            for _ in range(self.depth):
                here = at - roots
                step = 2 * here + np.where(flat[rows + feature[at]] <= limit[at], 1, 2)
                at = np.where(goes[at], roots + np.minimum(step, size - 1), at)
            out[a : a + block] = value[at].sum(axis=1)
        return 1 / (1 + np.exp(-(self.base + out)))
