"""Isotonic calibration from binned counts."""

from __future__ import annotations

import numpy as np


def isotonic(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, y) of a non-decreasing fit to bin means by pooling adjacent violators.

    Each pool is smoothed by ``prior`` rows of the overall mean; between knots, read by linear interpolation.
    No bins give the constant 0.5.
    """
    if not len(x):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(x, kind="stable")
    total = float((weight * mean).sum() / weight.sum())
    pools: list[list[float]] = []  # sum of x, of weights, of labels
    for v, w, m in zip(x[order], weight[order], mean[order], strict=True):
        pools.append([v * w, w, m * w])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    y = np.maximum.accumulate((p[:, 2] + prior * total) / (p[:, 1] + prior))
    return p[:, 0] / p[:, 1], np.clip(y, 0.0, 1.0)
