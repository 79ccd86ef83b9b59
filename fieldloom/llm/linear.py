"""A logistic model over hashed binary or counted features, fitted on a bounded sample with NumPy."""

from __future__ import annotations

import zlib

import numpy as np


def slot(feature: str, bits: int) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


def sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, n_features: int, l2: float = 1e-4, steps: int = 300, rate: float = 0.1, penalty=None, bias: float | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the whole sample. y: 0 to 1. penalty: takes the weights, returns the gradient of a further loss. bias: held at this, if given."""
    n = max(1, len(y))
    w, b = np.zeros(n_features), bias or 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, values * w[cols], minlength=len(y)) + b if len(y) else np.zeros(0)
        d = (sigmoid(z) - y) / n
        g = np.append(np.bincount(cols, values * d[rows], minlength=n_features) + l2 * w, d.sum())
        if penalty is not None:
            g[:-1] += penalty(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1] * (bias is None)
    return w, float(b)
