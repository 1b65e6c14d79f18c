"""Gradient-boosted trees for two classes, small enough to fit on the driver and to broadcast."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of fixed depth on binned features, fitted to the gradients of the logistic loss.

    Each tree is complete: level by level a node is a feature and a threshold, a row goes right if it is above, and
    the leaves hold steps in log odds.
    """

    def __init__(self, rounds: int = 60, depth: int = 4, bins: int = 32, rate: float = 0.2, smooth: float = 1.0):
        self.rounds, self.depth, self.bins, self.rate, self.smooth = rounds, depth, bins, rate, smooth
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        n, n_features = x.shape
        weight = np.ones(n) if weight is None else weight
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(n_features)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(n_features)], axis=1)
        flat = binned + np.arange(n_features) * (self.bins + 1)
        share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, curvature = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
            place = np.zeros(n, np.int64)
            feature, threshold = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                cells = n_features * (self.bins + 1)
                at = (place[:, None] * cells + flat).ravel()
                sums = [np.bincount(at, np.repeat(v, n_features), width * cells).reshape(width, n_features, -1) for v in (gradient, curvature)]
                left = [np.cumsum(s, axis=2)[:, :, :-1] for s in sums]
                whole = [s.sum(axis=2, keepdims=True) for s in sums]
                gain = left[0] ** 2 / (left[1] + self.smooth) + (whole[0] - left[0]) ** 2 / (whole[1] - left[1] + self.smooth) - whole[0] ** 2 / (whole[1] + self.smooth)
                for node in range(width):
                    f, b = np.unravel_index(np.argmax(gain[node]), gain[node].shape)
                    if gain[node, f, b] > 1e-9 and b < len(edges[f]):
                        feature[first + node], threshold[first + node] = f, edges[f][b]
                node = first + place
                place = 2 * place + (x[np.arange(n), feature[node]] > threshold[node])
            g, h = np.bincount(place, gradient, 2**self.depth), np.bincount(place, curvature, 2**self.depth)
            leaves = self.rate * g / (h + self.smooth)
            self.trees.append((feature, threshold, leaves))
            score += leaves[place]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaves in self.trees:
            place = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2**level - 1 + place
                place = 2 * place + (x[rows, feature[node]] > threshold[node])
            score += leaves[place]
        return score
