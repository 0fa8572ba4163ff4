"""Bounded labelled samples and the calibration of scores, shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Rows to learn from at most, and their longest text in characters.
SAMPLE = 6_000
SAMPLE_CHARS = 20_000
SEED = 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE) -> tuple[list[str], np.ndarray, float]:
    """Texts, 0/1 labels, and the share of label 1 among all that may be learned from, of at most ``rows`` documents that aren't held out, up to half of them with label 1.

    Which ones is decided by a hash of the id. Null labels and null or longer texts are left out, also
    labels and texts without an id; of several labels of one id the largest counts, and of several texts
    the first in order, so repeated rows change nothing. Texts of over ``SAMPLE_CHARS`` characters are
    scored whole but never learned from.
    """
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in known.groupBy(F.col(label) > 0).count().collect()}
    u = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    share = F.when(F.col(label) > 0, F.lit(min(1.0, rows / 2 / max(1, counts.get(True, 1))))).otherwise(
        F.lit(min(1.0, rows / 2 / max(1, counts.get(False, 1))))
    )
    chosen = known.where(u < share).groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    short = docs.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", "text")
    met = short.join(F.broadcast(chosen), "doc_id")  # of `rows` ids at most
    got = met.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).toArrow().to_pylist()
    got.sort(key=lambda r: r["doc_id"])
    weight = [counts.get(bool(y), 0) for y in (0, 1)]
    texts, y = [r["text"] for r in got], np.array([int(r["y"] > 0) for r in got], dtype=int)
    return texts, y, (weight[1] + 1) / (sum(weight) + 2)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients (the last is the intercept) of a ridge logistic regression, by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(a.shape[1])
    for _ in range(steps):
        p = sigmoid(a @ b)
        penalty = ridge * np.eye(len(b))
        g = a.T @ (weight * (p - y)) + penalty @ b
        h = (a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + penalty
        step = np.linalg.solve(h, g)
        b -= step * min(1.0, 10.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return b


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def prior_weights(y: np.ndarray, prior: float) -> np.ndarray:
    """Weights under which a sample of chosen shares stands for rows with ``prior`` of label 1."""
    ones = max(1, int(y.sum()))
    zeros = max(1, len(y) - int(y.sum()))
    return np.where(y == 1, prior * len(y) / ones, (1 - prior) * len(y) / zeros)
