"""Gradient-boosted trees with a logistic loss over binned features, in numpy."""

from __future__ import annotations

import numpy as np


class Trees:
    """Complete binary trees of one depth: split features and thresholds by level order, leaf values."""

    def __init__(self, depth: int, bias: float):
        self.depth, self.bias = depth, bias
        self.features: list[np.ndarray] = []
        self.thresholds: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - (2**self.depth - 1)]
        return out

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 50, depth: int = 4, rate: float = 0.3, bins: int = 16, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Second-order boosting; every tree is grown level by level on histograms."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(depth, float(np.log(base / (1 - base))))
    margin = np.full(n, model.bias)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        f, t, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = at - first
            flat = ((slot[:, None] * m + np.arange(m)) * bins + code).ravel()
            gs = np.bincount(flat, np.repeat(g, m), width * m * bins).reshape(width, m, bins)
            hs = np.bincount(flat, np.repeat(h, m), width * m * bins).reshape(width, m, bins)
            gl, hl = gs.cumsum(2)[..., :-1], hs.cumsum(2)[..., :-1]
            ga, ha = gs.sum(2, keepdims=True), hs.sum(2, keepdims=True)
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain[(hl < least) | (ha - hl < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for w in range(width):
                j, b = divmod(int(best[w]), bins - 1)
                if gain[w, j, b] > 1e-6 and b < len(cuts[j]):
                    f[first + w], t[first + w] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
        leaf = at - inner
        gl, hl = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value = -rate * gl / (hl + ridge)
        model.features.append(f)
        model.thresholds.append(t)
        model.leaves.append(value)
        margin += value[leaf]
    return model
