"""Bounded labelled samples and small models that are fitted on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(key: str, parts: int):
    """crc32 of the key as text modulo ``parts``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def label_sample(labels: DataFrame, column: str, parts: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, y) of about ``most`` labelled rows, none of them held out.

    Every label outside the held-out fold is counted; a hash of the id then decides which
    take part, so the sample is spread over all of them and is the same in every run.
    Rows that repeat an id count once, by the larger label; null ids and labels do not count.
    """
    y = (
        labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", parts) != held_out))
        .groupBy("doc_id")
        .agg(F.max(column).cast("int").alias("y"))
    )
    n = y.count()
    if n <= most:
        return y
    share = int(most / n * (1 << 30))
    return y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights, the intercept last, of a ridge logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        hessian = (x.T * (p * (1 - p))) @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
