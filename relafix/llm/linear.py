"""Small dense logistic models, fitted on a bounded sample on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Logistic:
    """Weights over standardised features; ``z`` is the log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def z(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, rounds: int = 25) -> Logistic:
    """Newton's method with an L2 penalty; with one class only, its smoothed log-odds."""
    weight = np.ones(len(y)) if weight is None else weight
    if len(y) == 0:
        return Logistic(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1]), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    a = np.hstack([(x - mean) / scale, np.ones((len(y), 1))])
    target = (y * weight).sum() + 1.0
    beta = np.zeros(a.shape[1])
    beta[-1] = np.log(target / (weight.sum() + 2.0 - target))
    if y.min() == y.max():
        return Logistic(mean, scale, beta[:-1], float(beta[-1]))
    penalty = np.full(a.shape[1], l2)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(a @ beta)
        gradient = a.T @ (weight * (y - p)) - penalty * beta
        curve = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, beta[:-1], float(beta[-1]))
