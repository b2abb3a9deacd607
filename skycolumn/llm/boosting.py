"""Gradient-boosted trees for two classes: binned features, logistic loss, small trees in arrays."""

from __future__ import annotations

import numpy as np


class Boosted:
    """``edges`` bin the features; each tree is (feature, threshold bin, leaf values) of a complete binary tree."""

    def __init__(self, edges: list[np.ndarray], trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], base: float):
        self.edges, self.trees, self.base = edges, trees, base

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        bins, rows = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while (at < len(feature)).any():  # complete trees: all rows reach the leaves together
                at = 2 * at + 1 + (bins[rows, feature[at]] > cut[at])
            out += leaf[at - len(feature)]
        return out


def _bin_edges(column: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))
    return (values[1:] + values[:-1]) / 2 if len(values) > 1 else np.zeros(0)


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """``x`` rows of features, ``y`` 0 or 1."""
    edges = [_bin_edges(x[:, j], bins) for j in range(x.shape[1])]
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Boosted(edges, [], float(np.log(share / (1 - share))))
    codes, n_bins = model.binned(x), max([len(e) for e in edges], default=0) + 1
    score, inner = np.full(len(y), model.base), 2 ** depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, 255, np.int64)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            slot, best = at - first, np.full(width, 1e-9)
            for j in range(x.shape[1]):
                place = slot * n_bins + codes[:, j]
                g = np.bincount(place, gradient, width * n_bins).reshape(width, n_bins).cumsum(axis=1)
                h = np.bincount(place, weight, width * n_bins).reshape(width, n_bins).cumsum(axis=1)
                gain = g ** 2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                k = gain.argmax(axis=1)
                found = gain[np.arange(width), k]
                better = found > best
                best[better] = found[better]
                feature[first:first + width][better], cut[first:first + width][better] = j, k[better]
            at = 2 * at + 1 + (codes[np.arange(len(y)), feature[at]] > cut[at])
        slot = at - inner
        leaf = rate * np.bincount(slot, gradient, inner + 1) / (np.bincount(slot, weight, inner + 1) + ridge)
        score += leaf[slot]
        model.trees.append((feature, cut, leaf))
    return model
