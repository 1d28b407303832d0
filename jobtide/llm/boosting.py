"""Gradient-boosted trees for a yes-or-no label, on binned features.

Trees are complete and of one depth, so a row walks down all of them by array steps. Fitting
is meant for bounded samples; applying is for any number of rows.
"""

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Forest:
    edges: list[np.ndarray]
    feature: np.ndarray  # tree, inner node
    cut: np.ndarray
    leaf: np.ndarray  # tree, leaf
    base: float

    def binned(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, rows[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        return self._of_bins(self.binned(rows))

    def _of_bins(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.base)
        each = np.arange(len(bins))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(bins), np.int64)
            while len(node) and node[0] < inner:  # all rows are at the same depth
                node = 2 * node + 1 + (bins[each, feature[node]] > cut[node])
            total += leaf[node - inner]
        return total


def fit(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, trees: int = 40, depth: int = 4,
        rate: float = 0.3, smooth: float = 1.0) -> Forest:
    """Second-order boosting of the logistic loss; each split takes the best gain of its node."""
    edges = [np.unique(np.quantile(column, np.arange(1, BINS) / BINS)) for column in rows.T]
    share = np.average(labels, weights=weights)
    inner, width = 2 ** depth - 1, rows.shape[1]
    forest = Forest(edges, np.zeros((trees, inner), np.int64), np.full((trees, inner), BINS),
                    np.zeros((trees, inner + 1)), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    bins = forest.binned(rows)
    odds = np.full(len(rows), forest.base)
    for tree in range(trees):
        chance = 1 / (1 + np.exp(-odds))
        slope, bend = weights * (labels - chance), weights * chance * (1 - chance)
        node = np.zeros(len(rows), np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            place = (node - first) * BINS
            best = np.full(count, 1e-6)
            for j in range(width):
                key = place + bins[:, j]
                g = np.bincount(key, slope, count * BINS).reshape(count, BINS).cumsum(axis=1)
                h = np.bincount(key, bend, count * BINS).reshape(count, BINS).cumsum(axis=1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = (g ** 2 / (h + smooth) + (g_all - g) ** 2 / (h_all - h + smooth)
                        - g_all ** 2 / (h_all + smooth))
                at = gain.argmax(axis=1)
                top = gain[np.arange(count), at]
                better = top > best
                best[better] = top[better]
                forest.feature[tree, first:first + count][better] = j
                forest.cut[tree, first:first + count][better] = at[better]
            node = 2 * node + 1 + (bins[np.arange(len(rows)), forest.feature[tree, node]] > forest.cut[tree, node])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, bend, inner + 1)
        forest.leaf[tree] = rate * g / (h + smooth)
        odds += forest.leaf[tree][leaf]
    return forest
