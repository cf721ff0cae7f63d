"""Histogram gradient-boosted trees for two classes, in numpy, flattened into arrays.

Features are cut into at most ``bins`` quantile bins, trees grow level by level on gradient and curvature sums per
bin, and every tree is stored in a complete binary layout: node i has the children 2i+1 and 2i+2. Scoring walks all
rows down all levels at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """feature, cut: (trees, inner nodes); value: (trees, leaves); a row goes right if x > cut. scale, shift: Platt."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    prior: float
    scale: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - inner]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.raw(x) + self.shift)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, smooth: float = 1.0, least: float = 2.0
) -> Trees:
    """Logistic boosting. Without rows or with one class only, the trees answer the smoothed prior."""
    n, k = x.shape
    positive = float(y.sum())
    prior = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    inner = 2**depth - 1
    out = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), prior)
    if positive in (0, n):
        return out
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # bin > b iff x > cuts[b]
    offset = binned + np.arange(k) * bins
    score = np.full(n, prior)
    feature, cut, value = [], [], []
    for _ in range(trees):
        p = sigmoid(score)
        grad, curve = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (k * bins) + offset).ravel()
            size = width * k * bins
            g = np.bincount(cell, np.repeat(grad, k), size).reshape(width, k, bins).cumsum(2)
            h = np.bincount(cell, np.repeat(curve, k), size).reshape(width, k, bins).cumsum(2)
            gt, ht = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + smooth) + (gt - g) ** 2 / (ht - h + smooth) - gt**2 / (ht + smooth)
            gain[(h < least) | (ht - h < least)] = 0
            for j, cc in enumerate(cuts):
                gain[:, j, len(cc) :] = 0
            best = gain.reshape(width, -1).argmax(1)
            for w in range(width):
                j, b = divmod(int(best[w]), bins)
                if gain[w, j, b] > 1e-9:
                    f[first + w], c[first + w] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > c[node])
        leaf = node - inner
        v = rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, curve, inner + 1) + smooth)
        score = score + v[leaf]
        feature.append(f)
        cut.append(c)
        value.append(v)
    return Trees(np.array(feature), np.array(cut), np.array(value), prior)


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray, rounds: int = 50, prior: float = 0.1) -> Trees:
    """Platt scaling on rows that the trees have not seen.

    Scale and shift are drawn toward 1 and 0 with the weight ``prior``, which many rows outweigh: few rows, none, or rows of
    one class are calibrated by the same rule.
    """
    z = model.raw(x)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * z + b)
        w = np.maximum(p * (1 - p), 1e-9)
        ga, gb = ((target - p) * z).sum() - prior * (a - 1), (target - p).sum() - prior * b
        haa, hab, hbb = (w * z * z).sum() + prior, (w * z).sum(), w.sum() + prior
        det = haa * hbb - hab * hab
        a, b = a + np.clip((hbb * ga - hab * gb) / det, -1, 1), b + np.clip((haa * gb - hab * ga) / det, -1, 1)
    model.scale, model.shift = float(max(a, 1e-3)), float(b)
    return model
