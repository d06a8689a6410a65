"""Logistic regression with a quadratic penalty: the loss, and a minimiser that needs values and slopes only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def log_loss(z: np.ndarray, y: np.ndarray, positive: float = 1.0) -> tuple[float, np.ndarray]:
    """Sum of the log losses of log odds z, and its slope for each z; rows of class 1 count `positive` times."""
    c = np.where(y == 1, positive, 1.0)
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return float((c * (np.logaddexp(0, z) - y * z)).sum()), c * (p - y)


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 40, tolerance: float = 1e-4, memory: int = 6) -> np.ndarray:
    """Minimum of a smooth convex f, which gives value and gradient, by limited-memory quasi-Newton steps. Ends once a step gains less than `tolerance` of the value."""
    w = start
    value, slope = f(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, shares = slope.copy(), []
        for s, t in reversed(moves):
            shares.append((s @ q) / (s @ t))
            q -= shares[-1] * t
        norm = np.linalg.norm(slope)
        if norm == 0:
            break
        q *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / norm
        for (s, t), share in zip(moves, reversed(shares)):
            q += (share - (t @ q) / (s @ t)) * s
        size, down = 1.0, slope @ q
        new, new_slope = f(w - q)
        while new > value - 1e-4 * size * down and size > 1e-4:
            size /= 2
            new, new_slope = f(w - size * q)
        if new >= value:
            break
        s, t = -size * q, new_slope - slope
        gain, w, value, slope = value - new, w + s, new, new_slope
        if s @ t > 1e-12:
            moves = [*moves[-memory + 1 :], (s, t)]
        if gain < tolerance * max(1.0, abs(value)):
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, positive: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the log loss of the rows of x plus penalty * |w|^2 / 2."""

    def f(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, slope = log_loss(x @ w[:-1] + w[-1], y, positive)
        return value + penalty * float(w[:-1] @ w[:-1]) / 2, np.append(x.T @ slope + penalty * w[:-1], slope.sum())

    start = np.zeros(x.shape[1] + 1)
    start[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    w = minimise(f, start, steps=500, tolerance=1e-10)
    return w[:-1], float(w[-1])
