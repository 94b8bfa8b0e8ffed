"""A linear support vector machine fitted by dual coordinate descent."""

from __future__ import annotations

import numpy as np


def fit_hinge(indices: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, width: int, cost: float = 1.0, passes: int = 20, seed: int = 1) -> np.ndarray:
    """Weights (the last one is the bias) of min |w|^2 / 2 + cost * sum of hinge losses.

    Row i is sparse: `values[i]` at `indices[i]`. One dual variable per row moves to its best value in turn, in an
    order drawn from `seed`; each class gets the same total cost, so a rare class is not drowned.
    """
    weights, bias = np.zeros(width), 0.0
    alpha = np.zeros(len(signs))
    norms = np.array([float(v @ v) + 1.0 for v in values])
    share = {s: len(signs) / (2 * max(1, (signs == s).sum())) for s in (-1, 1)}
    upper = np.array([cost * share[int(s)] for s in signs])
    draw = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in draw.permutation(len(signs)):
            where, x = indices[i], values[i]
            gradient = signs[i] * (weights[where] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * signs[i]
                weights[where] += step * x
                bias += step
                moved = max(moved, abs(new - alpha[i]) / upper[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return np.append(weights, bias)


def fit_sigmoid(margins: np.ndarray, truth: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) of sigmoid(a * margin + b) by Newton's method on softened targets; `truth` is 0 or 1."""
    high, low = (truth.sum() + 1) / (truth.sum() + 2), 1 / ((1 - truth).sum() + 2)
    target = np.where(truth == 1, high, low)
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * margins + b)
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margins).sum(), (p - target).sum()]) + 1e-6 * np.array([a, b])
        h = np.array([[(w * margins * margins).sum(), (w * margins).sum()], [(w * margins).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        scale = min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-6)), float(b)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
