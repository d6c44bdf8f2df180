"""Gradient-boosted trees of fixed depth for a binary label (logistic loss), on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Perfect binary trees: node i has the children 2i + 1 and 2i + 2; a row goes right where feature > cut."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        depth, rows = int(np.log2(self.leaf.shape[1])), np.arange(len(x))
        total = np.full(len(x), self.bias)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**depth - 1)]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 16, shrink: float = 5.0) -> Trees:
    """Each tree follows the loss' gradient; a split maximises the gain of the second-order expansion."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
    width = max(map(len, cuts)) + 1
    bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    total = np.full(len(y), bias)
    features, limits, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, limit = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            gains = np.full((count, x.shape[1], width), -np.inf)
            for f in range(x.shape[1]):
                cell = (node - first) * width + binned[:, f]
                g, h = (np.bincount(cell, weights, count * width).reshape(count, width).cumsum(axis=1) for weights in (gradient, hessian))
                gain = g**2 / (h + shrink) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + shrink) - g[:, -1:] ** 2 / (h[:, -1:] + shrink)
                gains[:, f, : len(cuts[f])] = gain[:, : len(cuts[f])]
            best = gains.reshape(count, -1).argmax(axis=1)
            for i, b in enumerate(best):
                f, c = divmod(int(b), width)
                if gains[i, f, c] > 1e-6:
                    feature[first + i], limit[first + i] = f, cuts[f][c]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > limit[node])
        at = node - (2**depth - 1)
        leaf = rate * np.bincount(at, gradient, 2**depth) / (np.bincount(at, hessian, 2**depth) + shrink)
        total += leaf[at]
        features.append(feature)
        limits.append(limit)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(limits), np.array(leaves), bias)
