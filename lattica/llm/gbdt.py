"""Histogram gradient-boosted trees for two classes, in numpy: level-wise trees, flattened for vectorised traversal."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Forest:
    """Complete binary trees as arrays: split feature and threshold of inner nodes, values of leaves."""

    def __init__(self, base: float, depth: int, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.depth, self.feature, self.threshold, self.value = base, depth, feature, threshold, value

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = 2**self.depth - 1
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x)) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, bins: int = 32, rate: float = 0.15, least: float = 3.0, l2: float = 1.0, weight: np.ndarray | None = None) -> Forest:
    """Second-order boosting of the logistic loss over binned features. least: smallest sum of second derivatives in a leaf.

    Without rows, or with one class, the forest has no trees and gives the smoothed base rate.
    """
    n = len(y)
    w = np.ones(n) if weight is None else weight
    base = float(np.log((w[y == 1].sum() + 0.5) / (w[y == 0].sum() + 0.5))) if n else 0.0
    none = Forest(base, depth, np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))
    if not n or y.min() == y.max():
        return none
    p = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(p)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)  # bin > k means x > cuts[k]
    score, features, thresholds, values = np.full(n, base), [], [], []
    place = np.arange(p) * bins
    for _ in range(rounds):
        q = sigmoid(score)
        g, h = w * (q - y), w * np.maximum(q * (1 - q), 1e-6)
        node = np.zeros(n, np.int64)
        f_, t_ = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            k = 2**level
            cell = (node[:, None] * (p * bins) + place + binned).ravel()
            sums = [np.bincount(cell, np.repeat(v, p), k * p * bins).reshape(k, p, bins) for v in (g, h)]
            gl, hl = (np.cumsum(s, 2)[:, :, :-1] for s in sums)
            gt, ht = sums[0].sum(2)[:, :, None], sums[1].sum(2)[:, :, None]
            gr, hr = gt - gl, ht - hl
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (hr < least)] = 0
            flat = gain.reshape(k, -1)
            best = flat.argmax(1)
            bf, bb = best // (bins - 1), best % (bins - 1)
            ok = flat[np.arange(k), best] > 1e-9
            for i in range(k):
                if ok[i] and bb[i] < len(cuts[bf[i]]):
                    f_[k - 1 + i], t_[k - 1 + i] = bf[i], cuts[bf[i]][bb[i]]
            node = 2 * node + (x[np.arange(n), f_[k - 1 + node]] > t_[k - 1 + node])
        gs, hs = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
        v_ = -rate * gs / (hs + l2)
        score += v_[node]
        features.append(f_)
        thresholds.append(t_)
        values.append(v_)
    return Forest(base, depth, np.array(features), np.array(thresholds), np.array(values))
