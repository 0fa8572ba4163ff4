"""Random feature maps: rows whose inner products approach a kernel."""

from __future__ import annotations

import enum
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import LOCAL_BYTES, MatrixFrame
from ..plans.registry import operator
from .rng import Lcg48, halton, normal_quantile

SEED = 12345


class Kernel(enum.IntEnum):
    LINEAR = 0
    GAUSSIAN = 1
    POLYNOMIAL = 2
    LAPLACIAN = 3
    EXPSEMIGROUP = 4
    MATERN = 5


def _shared(a: MatrixFrame, *arrays: np.ndarray):
    if sum(x.nbytes for x in arrays) > 8 * LOCAL_BYTES:
        raise ValueError("the feature map has too many weights to broadcast")
    return a.spark.sparkContext.broadcast(arrays)


def cosine_map(a: MatrixFrame, w: np.ndarray, phase: np.ndarray) -> MatrixFrame:
    """√(2/D)·cos(x·wᵀ + phase) for D rows of ``w``."""
    shared = _shared(a, np.ascontiguousarray(w.T), phase)
    scale = math.sqrt(2 / len(w))
    return a.map_blocks(lambda ids, x: scale * np.cos(x @ shared.value[0] + shared.value[1]), len(w))


def seeded_gaussian_weights(d_in: int, d_out: int, sigma: float, seed: int = 1234, phase_seed: int = 4321) -> tuple[np.ndarray, np.ndarray]:
    """Weights and phases of the local feature map. Weights fill a d_out x d_in matrix column by column."""
    draws = Lcg48(seed)
    w = (draws.gaussians(d_in * d_out) / sigma).reshape(d_in, d_out).T
    return w, 2 * math.pi * Lcg48(phase_seed).doubles(d_out)


@operator("rbf_features")
def rbf_features(a: MatrixFrame, d_out: int, sigma: float, seed: int = 1234, phase_seed: int = 4321) -> MatrixFrame:
    """Features of the Gaussian kernel exp(−‖x−y‖²/2σ²), from the seeds of the local map."""
    return cosine_map(a, *seeded_gaussian_weights(a.n_cols, d_out, sigma, seed, phase_seed))


def random_fourier_features(a: MatrixFrame, d_out: int, sigma: float, seed: int = SEED) -> MatrixFrame:
    """As ``rbf_features``, both draws from one seed."""
    return rbf_features(a, d_out, sigma, seed, seed + 1)


@operator("gaussian_features")
def gaussian_features(a: MatrixFrame, d_out: int, sigma: float, seed: int = SEED, quasi: bool = True) -> MatrixFrame:
    """Gaussian-kernel features; ``quasi`` takes frequencies from a leaped Halton sequence."""
    rng = np.random.default_rng(seed)
    d = a.n_cols
    w = normal_quantile(halton(d_out, d, start=1 + seed % 97)) if quasi else rng.normal(size=(d_out, d))
    return cosine_map(a, w / sigma, rng.uniform(0, 2 * math.pi, d_out))


@operator("laplacian_features")
def laplacian_features(a: MatrixFrame, d_out: int, sigma: float, seed: int = SEED) -> MatrixFrame:
    """exp(−‖x−y‖₁/σ): Cauchy frequencies."""
    rng = np.random.default_rng(seed)
    return cosine_map(a, rng.standard_cauchy((d_out, a.n_cols)) / sigma, rng.uniform(0, 2 * math.pi, d_out))


@operator("matern_features")
def matern_features(a: MatrixFrame, d_out: int, nu: float, length: float, seed: int = SEED) -> MatrixFrame:
    """Matérn kernel of smoothness ν: Student-t frequencies of 2ν degrees of freedom."""
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(d_out, a.n_cols)) / np.sqrt(rng.chisquare(2 * nu, (d_out, 1)) / (2 * nu))
    return cosine_map(a, z / length, rng.uniform(0, 2 * math.pi, d_out))


@operator("semigroup_features")
def semigroup_features(a: MatrixFrame, d_out: int, beta: float, seed: int = SEED) -> MatrixFrame:
    """exp(−β Σ√(xᵢ+yᵢ)) of non-negative rows: random Laplace features exp(−w·x)/√D, w Lévy-distributed."""
    rng = np.random.default_rng(seed)
    w = (beta**2 / 2) / np.maximum(rng.normal(size=(d_out, a.n_cols)) ** 2, 1e-300)
    shared = _shared(a, np.ascontiguousarray(w.T))
    return a.map_blocks(lambda ids, x: np.exp(-(x @ shared.value[0])) / math.sqrt(d_out), d_out)


def count_sketch_table(d_in: int, d_out: int, seed: int = 1234) -> tuple[np.ndarray, np.ndarray]:
    """A bucket and a sign for each input column."""
    draws = Lcg48(seed)
    bucket = np.array([draws.integer(d_out) for _ in range(d_in)], dtype=np.int64)
    sign = np.array([2.0 * draws.integer(2) - 1 for _ in range(d_in)])
    return bucket, sign


def sketched(x: np.ndarray, bucket: np.ndarray, sign: np.ndarray, d_out: int) -> np.ndarray:
    """Columns added with their signs to their buckets, by sorted runs of buckets."""
    order = np.argsort(bucket, kind="stable")
    some, start = np.unique(bucket[order], return_index=True)
    out = np.zeros((len(x), d_out))
    if len(some):
        out[:, some] = np.add.reduceat(x[:, order] * sign[order], start, axis=1)
    return out


@operator("count_sketch")
def count_sketch(a: MatrixFrame, d_out: int, seed: int = 1234, table: tuple[np.ndarray, np.ndarray] | None = None) -> MatrixFrame:
    """Feature hashing: each column is added with its sign to its bucket."""
    bucket, sign = table or count_sketch_table(a.n_cols, d_out, seed)
    shared = _shared(a, np.asarray(bucket), np.asarray(sign))
    return a.map_blocks(lambda ids, x: sketched(x, *shared.value, d_out), d_out)


def count_sketch_coo(cells: DataFrame, table: DataFrame) -> DataFrame:
    """Feature hashing of cells by a table ``col_id, bucket, sign`` with a row an input column."""
    joined = cells.join(table, "col_id").groupBy("row_id", "bucket").agg(F.sum(F.col("sign") * F.col("value")).alias("value"))
    return joined.select("row_id", F.col("bucket").alias("col_id"), "value")


@operator("polynomial_features")
def polynomial_features(a: MatrixFrame, d_out: int, degree: int = 2, gamma: float = 1.0, c: float = 0.0, seed: int = SEED) -> MatrixFrame:
    """(γ x·y + c)^degree by TensorSketch: the product of the transforms of ``degree`` count sketches."""
    rng = np.random.default_rng(seed)
    d = a.n_cols + (c != 0)
    tables = [(rng.integers(0, d_out, d), rng.choice([-1.0, 1.0], d)) for _ in range(int(degree))]
    shared = _shared(a, *(x for t in tables for x in t))

    def sketch(ids, x):
        x = math.sqrt(gamma) * x
        if c:
            x = np.column_stack([x, np.full(len(x), math.sqrt(c))])
        product = 1
        for bucket, sign in zip(shared.value[::2], shared.value[1::2], strict=True):
            product = product * np.fft.rfft(sketched(x, bucket, sign, d_out), axis=1)
        return np.fft.irfft(product, d_out, axis=1)

    return a.map_blocks(sketch, d_out)


def feature_map(a: MatrixFrame, kernel: Kernel, d_out: int, kp: float = 1.0, kp2: float = 1.0, kp3: float = 0.0, seed: int = SEED) -> MatrixFrame:
    """The map of a kernel; the linear kernel without features is the identity."""
    kernel = Kernel(kernel)
    if kernel == Kernel.LINEAR:
        return count_sketch(a, d_out, seed) if d_out else a
    if not d_out:
        raise ValueError(f"the {kernel.name} kernel needs a number of random features")
    if kernel == Kernel.GAUSSIAN:
        return gaussian_features(a, d_out, kp, seed)
    if kernel == Kernel.POLYNOMIAL:
        return polynomial_features(a, d_out, int(kp), kp2, kp3, seed)
    if kernel == Kernel.LAPLACIAN:
        return laplacian_features(a, d_out, kp, seed)
    if kernel == Kernel.EXPSEMIGROUP:
        return semigroup_features(a, d_out, kp, seed)
    return matern_features(a, d_out, kp, kp2, seed)


def estimate_sigma(a: MatrixFrame, rows: int | None = None) -> float:
    """√ of the mean squared distance over all ordered pairs of rows, each with itself as well; of the first
    ``rows`` only, if given.

    By moments: the mean over pairs of ‖x−y‖² is twice the sum of the columns' population variances."""
    some = a if rows is None else MatrixFrame(a.df.where(F.col("row_id") < rows))
    spread = some.to_coo().groupBy("col_id").agg(F.var_pop("value").alias("v")).agg(F.sum("v")).first()[0]
    return math.sqrt(2 * (spread or 0.0))
