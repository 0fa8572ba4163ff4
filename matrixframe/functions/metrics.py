"""Scores of clusterings, classifications and factorisations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import MatrixFrame
from ..operators.linalg import frobenius_norm
from ..plans import physical


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def nmi(df: DataFrame, a: str, b: str) -> DataFrame:
    """``nmi``, one row: mutual information over the mean of the entropies; 1 where both are constant."""
    cells = contingency(df, a, b)
    left, right = cells.groupBy(a).agg(F.sum("n").alias("na")), cells.groupBy(b).agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n").alias("t"))
    plogp = lambda c: F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))
    one = F.lit(1).alias("one")
    joint = cells.join(left, a).join(right, b).select("*", one).join(total.select("t", one), "one")
    mutual = joint.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    ha = left.select("na", one).join(total.select("t", one), "one").agg((-plogp("na")).alias("ha"))
    hb = right.select("nb", one).join(total.select("t", one), "one").agg((-plogp("nb")).alias("hb"))
    scores = mutual.select("mi", one).join(ha.select("ha", one), "one").join(hb.select("hb", one), "one")
    mean = (F.col("ha") + F.col("hb")) / 2
    return scores.select(F.when(mean > 0, F.col("mi") / F.when(mean > 0, mean)).otherwise(1.0).alias("nmi"))


def misclassification(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """``error_rate``, one row: the share of rows whose ``predicted`` isn't their ``label``, joined by row id."""
    wrong = (F.col("predicted") != F.col("label")).cast("double")
    return predicted.join(true, "row_id").agg(F.avg(wrong).alias("error_rate"))


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))


def residual(a: MatrixFrame, x: np.ndarray, b: MatrixFrame) -> float:
    """‖B − AX‖² of the solved X."""
    p = a.n_cols
    both = physical.side_by_side(a, b)
    return float(both.sum_local(lambda ids, z: np.array([[((z[:, p:] - z[:, :p] @ x) ** 2).sum()]]), (1, 1))[0, 0])


def rank_k_error(a: MatrixFrame, v: np.ndarray) -> tuple[float, float]:
    """‖A − AVVᵀ‖² and its share of ‖A‖²."""
    error = float(a.sum_local(lambda ids, x: np.array([[((x - (x @ v) @ v.T) ** 2).sum()]]), (1, 1))[0, 0])
    whole = frobenius_norm(a) ** 2
    return error, error / whole if whole else 0.0
