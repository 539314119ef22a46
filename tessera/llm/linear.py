"""Sparse logistic regression on a bounded sample, in numpy on the driver."""

from __future__ import annotations

import numpy as np


class Sparse:
    """Rows of (columns, values) in compressed form."""

    def __init__(self, rows: list, width: int):
        self.width, self.n = width, len(rows)
        sizes = [len(c) for c, _ in rows]
        self.row = np.repeat(np.arange(self.n), sizes)
        self.col = np.concatenate([np.asarray(c, np.int64) for c, _ in rows]) if rows else np.zeros(0, np.int64)
        self.val = np.concatenate([np.asarray(v, float) for _, v in rows]) if rows else np.zeros(0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col] * self.val, minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=g[self.row] * self.val, minlength=self.width)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: Sparse, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-4, pairs: tuple[Sparse, Sparse] | None = None, tie: float = 0.0, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on the full sample; y may hold probabilities.

    ``pairs`` are rows and their counterfactuals: ``tie`` times the mean squared difference of their logits is added.
    """
    weight = np.ones(x.n) if weight is None else weight
    total = max(1e-12, weight.sum())
    w, b = np.zeros(x.width), 0.0
    m, v = np.zeros(x.width + 1), np.zeros(x.width + 1)
    for t in range(1, steps + 1):
        g = weight * (sigmoid(x.dot(w) + b) - y) / total
        grad = np.append(x.back(g) + l2 * w, g.sum())
        if pairs is not None and pairs[0].n and tie:
            d = (pairs[0].dot(w) - pairs[1].dot(w)) * 2 * tie / pairs[0].n
            grad[:-1] += pairs[0].back(d) - pairs[1].back(d)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)
