"""Logistic regression over sparse binary features, fitted on the driver from a small table."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np


def fit(rows: Sequence[Sequence[int]], labels: Sequence[int], size: int, l2: float = 0.01, rounds: int = 400, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """(weights, bias) by full-batch gradient descent with momentum; deterministic."""
    size_of = np.array([len(r) for r in rows], np.int64)
    at = np.fromiter((f for r in rows for f in r), np.int64, int(size_of.sum()))
    row = np.repeat(np.arange(len(rows)), size_of)
    y, w, b = np.asarray(labels, float), np.zeros(size), 0.0
    vw, vb = np.zeros(size), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[at], len(rows)) + b)))
        g = (p - y) / len(y)
        vw = 0.9 * vw - rate * (np.bincount(at, g[row], size) + l2 * w / len(y))
        vb = 0.9 * vb - rate * g.sum()
        w, b = w + vw, b + vb
    return w, float(b)


def probability(z: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))
