"""Histogram gradient-boosted trees for two classes, in numpy.

Features are cut into at most ``bins`` steps at their quantiles; a tree level is grown from one
histogram of gradients per feature. All trees are complete binary trees of one depth, flattened
into arrays, so scoring walks all rows down a tree at once: ``depth`` gathers per tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    base: float
    depth: int
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # go right where the value is greater
    value: np.ndarray  # (trees, leaves)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row; any number of rows, none included."""
        total = np.full(len(rows), self.base)
        at = np.arange(len(rows))
        inner = self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[at, feature[node]] > cut[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(
    rows: np.ndarray,
    labels: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    min_weight: float = 1.0,
    ridge: float = 1.0,
) -> Trees:
    """Boosted trees for labels 0 and 1. Without rows, or with one class, a constant score."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    base = float(np.log(share / (1 - share)))
    if len(labels) == 0 or labels.min() == labels.max():
        trees = 0
    columns = rows.shape[1]
    cuts = []
    binned = np.zeros(rows.shape, np.int64)
    for k in range(columns if trees else 0):
        edges = np.unique(np.quantile(rows[:, k], np.linspace(0, 1, bins + 1)[1:-1]))
        cuts.append(edges)
        binned[:, k] = np.searchsorted(edges, rows[:, k], "left")
    feature = np.zeros((trees, inner), np.int64)
    cut = np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    total = np.full(len(labels), base)
    for tree in range(trees):
        chance = 1 / (1 + np.exp(-total))
        slope, weight = labels - chance, chance * (1 - chance)
        node = np.zeros(len(labels), np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            best = np.full(count, 1e-9)
            for k in range(columns):
                cell = (node - first) * bins + binned[:, k]
                left_s = np.bincount(cell, slope, count * bins).reshape(count, bins).cumsum(1)
                left_w = np.bincount(cell, weight, count * bins).reshape(count, bins).cumsum(1)
                all_s, all_w = left_s[:, -1:], left_w[:, -1:]
                right_s, right_w = all_s - left_s, all_w - left_w
                gain = (
                    left_s**2 / (left_w + ridge)
                    + right_s**2 / (right_w + ridge)
                    - all_s**2 / (all_w + ridge)
                )
                gain[(left_w < min_weight) | (right_w < min_weight)] = 0
                gain = gain[:, : len(cuts[k])]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(1)
                better = np.flatnonzero(gain[np.arange(count), at] > best)
                best[better] = gain[better, at[better]]
                feature[tree, first + better] = k
                cut[tree, first + better] = cuts[k][at[better]]
            here = rows[np.arange(len(rows)), feature[tree, node]] > cut[tree, node]
            node = 2 * node + 1 + here
        leaf = node - inner
        sums = np.bincount(leaf, slope, leaves)
        value[tree] = rate * sums / (np.bincount(leaf, weight, leaves) + ridge)
        total += value[tree][leaf]
    return Trees(base, depth, feature, cut, value)
