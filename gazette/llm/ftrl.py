"""Logistic regression with follow-the-regularised-leader updates, and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.language_id import fold
from gazette.shared import materialize


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], size: int, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> np.ndarray:
    """Weights after FTRL-proximal steps over (distinct columns, values, target in 0..1), in the order given.

    Column 0 is the constant and isn't regularised; rows don't name it.
    """
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for columns, values, target in rows:
            c, x = np.concatenate([[0], columns]), np.concatenate([[1.0], values])
            zc, nc = z[c], n[c]
            shrink = np.full(len(c), l1)
            shrink[0] = 0
            wc = np.where(np.abs(zc) <= shrink, 0.0, (np.sign(zc) * shrink - zc) / ((beta + np.sqrt(nc)) / alpha + l2))
            gradient = (sigmoid(wc @ x) - target) * x
            step = (np.sqrt(nc + gradient**2) - np.sqrt(nc)) / alpha
            z[c] = zc + gradient - step * wc
            n[c] = nc + gradient**2
    shrink = np.full(size, l1)
    shrink[0] = 0
    np.copyto(w, np.where(np.abs(z) <= shrink, 0.0, (np.sign(z) * shrink - z) / ((beta + np.sqrt(n)) / alpha + l2)))
    return w


def held_out(doc_id):
    """Rows whose labels training never sees; a null id is among them."""
    return F.coalesce(fold(doc_id, 3) == 1, F.lit(True))


def hash_of(doc_id: int) -> int:
    """An order of ids that has nothing to do with theirs."""
    return (doc_id * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 64) ^ (doc_id >> 7)


def sample_ids(labels: DataFrame, label: str, size: int) -> DataFrame:
    """(doc_id, label): of each class the 2 * ``size`` rows (all, if fewer) whose ids come first by a hash; an exact bound."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(~held_out(F.col("doc_id"))).distinct()
    taken = [rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * size) for k in (0, 1)]
    return materialize(taken[0].unionByName(taken[1]), "sample")
