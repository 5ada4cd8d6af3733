"""Ordered logit whose intercept walks with the minute, fitted on counted cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchloom.session import few_rows

#: different (minute, features, outcome) rows at most; features are rounded, so a corpus of any size has few
MOST_CELLS = 500_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(minute: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, walk: float = 0.1, steps: int = 1500, rate: float = 0.03) -> dict[str, np.ndarray]:
    """Maximum a posteriori of P(y <= k) = sigmoid(c_k - alpha[minute] - x @ beta) for y in 0, 1, 2,
    with alpha a random walk of deviation ``walk`` and standard normal betas, by Adam."""
    minutes, features = int(minute.max()) + 1, x.shape[1]
    # cut points as a middle and a log gap, so that they stay in order
    theta = np.concatenate([[0.0, 0.0], np.zeros(features), np.zeros(minutes)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    total = n.sum()
    for step in range(1, steps + 1):
        middle, gap, beta, alpha = theta[0], np.exp(theta[1]), theta[2 : 2 + features], theta[2 + features :]
        eta = alpha[minute] + x @ beta
        low, high = _sigmoid(middle - gap / 2 - eta), _sigmoid(middle + gap / 2 - eta)
        p = np.maximum(np.where(y == 0, low, np.where(y == 1, high - low, 1 - high)), 1e-12)
        dlow, dhigh = low * (1 - low), high * (1 - high)
        up = np.where(y == 0, 0.0, np.where(y == 1, dhigh, -dhigh)) / p * n  # by the upper cut point
        down = np.where(y == 0, dlow, np.where(y == 1, -dlow, 0.0)) / p * n
        slope = -(up + down)  # by eta
        jumps = np.diff(alpha) / walk**2
        g_alpha = np.bincount(minute, slope, minutes)
        g_alpha[1:] -= jumps
        g_alpha[:-1] += jumps
        g_alpha[0] -= alpha[0]
        grad = np.concatenate([[(up + down).sum(), ((up - down) * gap / 2).sum() - theta[1]], x.T @ slope - beta, g_alpha]) / total
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta + rate * min(1.0, 3 * (1 - step / (steps + 1))) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    middle, gap = theta[0], np.exp(theta[1])
    return {"cut": np.array([middle - gap / 2, middle + gap / 2]), "beta": theta[2 : 2 + features], "alpha": theta[2 + features :]}


def ordered_logit(df: DataFrame, minute: str, features: list[str], label: str, walk: float = 0.1) -> DataFrame:
    """(part, position, value): cut points, a slope per feature and an intercept per minute.
    All rows are counted into cells in one aggregation; only the cells reach the driver."""
    rows = df.select(F.col(minute).cast("int").alias("m"), *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("int").alias("y")).dropna()
    cells = few_rows(rows.groupBy("m", *features, "y").agg(F.count(F.lit(1)).alias("n")), MOST_CELLS, "cells; round the features")
    ddl = "part string, position int, value double"
    if not cells:
        return df.sparkSession.createDataFrame([], ddl)
    table = np.array([tuple(c) for c in cells], float)
    got = fit(table[:, 0].astype(int), table[:, 1 : 1 + len(features)], table[:, -2].astype(int), table[:, -1], walk)
    return df.sparkSession.createDataFrame([(part, k, float(v)) for part, values in got.items() for k, v in enumerate(values)], ddl)
