"""Generated matrices. Every value depends on the seed and its row, never on the partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..frame import MatrixFrame
from ..operators import kmeans
from ..plans import physical


def _generated(spark: SparkSession, n: int, m: int, fn, partitions: int | None) -> MatrixFrame:
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    seeds = MatrixFrame(ids.select(F.col("id").alias("row_id"), F.array(F.lit(0.0)).alias("features")), n, 1)
    return seeds.map_blocks(fn, m)


def uniform(spark: SparkSession, n: int, m: int, seed: int = 0, low: float = 0.0, high: float = 1.0, partitions: int | None = None) -> MatrixFrame:
    def rows(ids, x):
        u = np.stack([kmeans.uniform(ids, seed, j) for j in range(m)], axis=1)
        return low + (high - low) * u

    return _generated(spark, n, m, rows, partitions)


def normal(spark: SparkSession, n: int, m: int, seed: int = 0, partitions: int | None = None) -> MatrixFrame:
    def rows(ids, x):
        u = np.stack([kmeans.uniform(ids, seed, 2 * j) for j in range(m)], axis=1)
        v = np.stack([kmeans.uniform(ids, seed, 2 * j + 1) for j in range(m)], axis=1)
        return np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * np.pi * v)

    return _generated(spark, n, m, rows, partitions)


def diagonal(spark: SparkSession, n: int, m: int, scale: float = 1.0, partitions: int | None = None) -> MatrixFrame:
    """``scale``·(i + 1) at (i, i), else 0."""

    def rows(ids, x):
        out = np.zeros((len(ids), m))
        at = np.flatnonzero(ids < m)
        out[at, ids[at]] = scale * (ids[at] + 1)
        return out

    return _generated(spark, n, m, rows, partitions)


def ramp(spark: SparkSession, n: int, m: int, partitions: int | None = None) -> MatrixFrame:
    """Row i is the constant i + 1."""
    return _generated(spark, n, m, lambda ids, x: np.repeat((ids + 1.0)[:, None], m, axis=1), partitions)


def planted_clusters(spark: SparkSession, n: int, d: int, k: int, noise: float, seed: int = 0, partitions: int | None = None) -> MatrixFrame:
    """Row i is ``d`` along axis c(i) and uniform noise in (−noise, noise); the last column is c(i)."""
    if d < k:
        raise ValueError("there must be as many dimensions as clusters")

    def rows(ids, x):
        c = (kmeans.uniform(ids, seed, 0) * k).astype(int)
        out = np.stack([noise * (2 * kmeans.uniform(ids, seed, j + 1) - 1) for j in range(d)], axis=1)
        out[np.arange(len(ids)), c] += d
        return np.column_stack([out, c])

    return _generated(spark, n, d + 1, rows, partitions)


def least_squares_pair(spark: SparkSession, n: int, p: int, m: int, noise: float = 0.0, seed: int = 0) -> tuple[MatrixFrame, np.ndarray, MatrixFrame]:
    """Uniform A and X, and B = AX with normal noise."""
    a = uniform(spark, n, p, seed)
    x = np.random.default_rng(seed).uniform(size=(p, m))
    b = physical.times_local(a, x)
    if noise:
        def noisy(ids, z):
            u = np.stack([kmeans.uniform(ids, seed + 1, 2 * j) for j in range(m)], axis=1)
            v = np.stack([kmeans.uniform(ids, seed + 1, 2 * j + 1) for j in range(m)], axis=1)
            return z + noise * np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * np.pi * v)

        b = b.map_blocks(noisy, m)
    return a, x, b
