"""Element-wise, column-wise and whole-matrix operations. Most are Spark expressions over the row form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import MatrixFrame
from ..plans import physical
from ..plans.expr import as_expr
from ..plans.registry import operator

#: Columns of less variance than this are left unscaled.
LEAST_VARIANCE = 1e-5


def matmul(a: MatrixFrame, b: MatrixFrame, strategy: str | None = None) -> MatrixFrame:
    """A·B; ``strategy`` is chosen from the sizes unless given."""
    return (as_expr(a) @ b).frame(strategy)


@operator("transpose")
def transpose(a: MatrixFrame) -> MatrixFrame:
    return as_expr(a).T.frame()


@operator("gram")
def gram(a: MatrixFrame) -> MatrixFrame:
    """AᵀA, as one scan of summed partial products."""
    return physical.gram(a)


def _local_column(values, n: int, what: str) -> np.ndarray:
    v = np.asarray(values, dtype=float).ravel()
    if len(v) != n:
        raise ValueError(f"{what} has {len(v)} values; {n} are needed")
    return v


@operator("matvec")
def matvec(a: MatrixFrame, x) -> MatrixFrame:
    """A·x for a local vector, as an n x 1 matrix."""
    return physical.times_local(a, _local_column(x, a.n_cols, "the vector")[:, None])


def atax(a: MatrixFrame, x) -> np.ndarray:
    """Aᵀ(A·x) for a local vector, in one pass and without AᵀA."""
    x = _local_column(x, a.n_cols, "the vector")
    return a.sum_local(lambda ids, b: (b.T @ (b @ x))[None], (1, a.n_cols))[0]


def dot(values):
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def squared_norm(a: MatrixFrame) -> DataFrame:
    """``squared_norm``, one row: the sum of all squares."""
    squares = dot(F.transform("features", lambda v: v * v))
    return a.df.select(squares.alias("s")).agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("squared_norm"))


def frobenius_norm(a: MatrixFrame) -> float:
    return float(np.sqrt(squared_norm(a).first()[0]))


@operator("replicate_columns")
def replicate_columns(a: MatrixFrame, times: int) -> MatrixFrame:
    """Column j of the result is column j modulo the width of A; ``times`` as wide."""
    if times < 1:
        raise ValueError("columns are repeated once at least")
    return a.map_rows(F.flatten(F.array_repeat("features", times)), a.n_cols * times)


@operator("scale_columns")
def scale_columns(a: MatrixFrame, factors) -> MatrixFrame:
    """A·diag(factors)."""
    f = F.lit(_local_column(factors, a.n_cols, "the diagonal"))  # one literal, however many columns
    return a.map_rows(F.zip_with("features", f, lambda x, y: x * y), a.n_cols)


def scale_rows(a: MatrixFrame, factors: MatrixFrame) -> MatrixFrame:
    """diag(factors)·A for an n x 1 matrix."""
    f = factors.df.select("row_id", F.element_at("features", 1).alias("factor"))
    df = a.df.join(f, "row_id").select("row_id", F.transform("features", lambda x: x * F.col("factor")).alias("features"))
    return MatrixFrame(df, *a.dims())


def _zipped(a: MatrixFrame, b: MatrixFrame, fn) -> MatrixFrame:
    if a.dims() != b.dims():
        raise ValueError(f"shapes {a.dims()} and {b.dims()} differ")
    right = b.df.select("row_id", F.col("features").alias("right"))
    return MatrixFrame(a.df.join(right, "row_id").select("row_id", F.zip_with("features", "right", fn).alias("features")), *a.dims())


def hadamard(a: MatrixFrame, b: MatrixFrame) -> MatrixFrame:
    return _zipped(a, b, lambda x, y: x * y)


def axpy(alpha: float, x: MatrixFrame, y: MatrixFrame) -> MatrixFrame:
    """alpha·X + Y."""
    return _zipped(x, y, lambda u, v: F.lit(float(alpha)) * u + v)


def rank_one_update(a: MatrixFrame, alpha: float, u: MatrixFrame, v) -> MatrixFrame:
    """A + alpha·u·vᵀ for an n x 1 matrix u and a local vector v."""
    row = a.spark.sparkContext.broadcast(alpha * _local_column(v, a.n_cols, "the row vector"))
    f = MatrixFrame(u.df.select("row_id", F.slice("features", 1, 1).alias("features")), u.n_rows, 1)
    return a.beside(f).map_blocks(lambda ids, x: x[:, :-1] + x[:, -1:] * row.value, a.n_cols)


def column_stats(a: MatrixFrame) -> DataFrame:
    """``col_id, mean, variance`` (of the population), ``max_abs, norm`` a column."""
    v = F.col("value")
    return a.to_coo().groupBy("col_id").agg(
        F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.max(F.abs(v)).alias("max_abs"), F.sqrt(F.sum(v * v)).alias("norm")
    )


def column_dots(a: MatrixFrame, b: MatrixFrame) -> DataFrame:
    """``col_id, value``: the dot product of every column of A with that of B."""
    return hadamard(a, b).to_coo().groupBy("col_id").agg(F.sum("value").alias("value"))


def column_norms(a: MatrixFrame) -> DataFrame:
    return column_stats(a).select("col_id", F.col("norm").alias("value"))


def moments(a: MatrixFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and population variances of all columns, in two passes, so that large means don't cancel the spread."""

    n = a.n_rows
    if not n:
        return np.zeros(a.n_cols), np.zeros(a.n_cols)
    mean = a.sum_local(lambda ids, x: x.sum(axis=0)[None], (1, a.n_cols))[0] / n
    spread = a.sum_local(lambda ids, x: ((x - mean) ** 2).sum(axis=0)[None], (1, a.n_cols))[0] / n
    return mean, spread


@operator("normalize_columns")
def normalize_columns(a: MatrixFrame, least_variance: float = LEAST_VARIANCE) -> MatrixFrame:
    """Columns of mean 0 and population deviation 1; those of less variance are only centred."""
    mean, variance = moments(a)
    scale = np.where(variance < least_variance, 1.0, 1 / np.sqrt(np.maximum(variance, 1e-300)))
    shared = a.spark.sparkContext.broadcast((mean, scale))
    return a.map_blocks(lambda ids, x: (x - shared.value[0]) * shared.value[1], a.n_cols)
