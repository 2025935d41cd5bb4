"""Weighted ridge logistic regression for the calibration of scores."""

from __future__ import annotations

import numpy as np


def fit(features: np.ndarray, labels: np.ndarray, share: float, ridge: float = 0.5) -> np.ndarray:
    """Weights, constant first, for standardised features; ``share`` is the share of label 1 in all rows.

    The result is expressed for the raw features. Without examples of both labels only the constant is fitted.
    """
    n = features.shape[1] if features.ndim == 2 else 0
    share = min(max(share, 1e-3), 1 - 1e-3)
    if not len(labels) or labels.min() == labels.max():
        return np.concatenate([[np.log(share / (1 - share))], np.zeros(n)])
    mean, scale = features.mean(0), features.std(0)
    scale[scale == 0] = 1.0
    x = np.hstack([np.ones((len(labels), 1)), (features - mean) / scale])
    weight = np.where(labels == 1, share / (labels == 1).mean(), (1 - share) / (labels == 0).mean())
    penalty = ridge * np.diag([0.0] + [1.0] * n) + 1e-9 * np.eye(n + 1)
    w = np.zeros(n + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        curve = x.T @ (x * (weight * p * (1 - p))[:, None]) + penalty
        step = np.linalg.solve(curve, x.T @ (weight * (labels - p)) - penalty @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    out = w.copy()
    out[1:] /= scale
    out[0] -= out[1:] @ mean
    return out


def predict(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + features @ weights[1:], -35, 35)))
