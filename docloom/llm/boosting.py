"""Gradient-boosted trees on binned features, for the logistic loss (small enough to fit on the driver)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature, threshold and leaf values of complete trees

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 for each row."""
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Boosted:
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(mean / (1 - mean))), [])
    raw = np.full(len(y), model.start)
    inner = (1 << depth) - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = node - first
            best = np.zeros(width)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                k = len(e) + 1
                sums = [np.bincount(at * k + binned[:, f], weights=w, minlength=width * k).reshape(width, k) for w in (g, h)]
                left_g, left_h = (np.cumsum(s, axis=1)[:, :-1] for s in sums)
                all_g, all_h = (s.sum(axis=1, keepdims=True) for s in sums)
                right_g, right_h = all_g - left_g, all_h - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
                cut = gain.argmax(axis=1)
                top = gain[np.arange(width), cut]
                better = top > best + 1e-9
                best = np.where(better, top, best)
                feature[first : first + width][better] = f
                threshold[first : first + width][better] = e[cut[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + ridge)
        model.trees.append((feature, threshold, value))
        raw += value[leaf]
    return model
