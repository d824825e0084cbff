"""Gradient-boosted trees for a binary outcome over small non-negative integer features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    """Complete binary trees of one depth: ``feature`` and ``cut`` per inner node, ``leaf`` values in log-odds."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.leaf.shape[1]))
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += leaf[node - (len(leaf) - 1)]
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 4, rate: float = 0.35, least: float = 4.0, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss; ``x`` holds integers below ``BINS``."""
    n, width = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3) if n else 0.5
    base = float(np.log(mean / (1 - mean)))
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), BINS, np.int64), np.zeros((trees, leaves))
    score = np.full(n, base)
    columns = [np.ascontiguousarray(x[:, f]).astype(np.int64) for f in range(width)]
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best_gain, best_f, best_c = np.full(count, 1e-9), np.zeros(count, np.int64), np.full(count, BINS, np.int64)
            for f, column in enumerate(columns):
                key = local * BINS + column
                left_g = np.bincount(key, g, count * BINS).reshape(count, BINS).cumsum(1)
                left_h = np.bincount(key, h, count * BINS).reshape(count, BINS).cumsum(1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                right_g, right_h = all_g - left_g, all_h - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
                gain[(left_h < least * 0.05) | (right_h < least * 0.05)] = 0
                c = gain.argmax(1)
                value = gain[np.arange(count), c]
                better = value > best_gain
                best_gain[better], best_f[better], best_c[better] = value[better], f, c[better]
            feature[t, first : first + count], cut[t, first : first + count] = best_f, best_c
            node = 2 * node + 1 + (x[np.arange(n), best_f[local]] > best_c[local])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        score += leaf[t][at]
    return Trees(feature, cut, leaf, base)
