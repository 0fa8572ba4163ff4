"""k-means with k-means||, random or first-rows initialisation."""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from ..frame import MatrixFrame
from ..plans.registry import operator

SEED = 7

log = logging.getLogger(__name__)


def uniform(ids: np.ndarray, seed: int, salt: int = 0) -> np.ndarray:
    """Numbers in [0, 1) that depend on the seed and the row alone."""
    x = ids.astype(np.uint64) + np.uint64((seed * 1_000_003 + salt * 7_919 + 1) & (1 << 64) - 1)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / (1 << 53)


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """By differences, a centre at a time, so that near points keep their digits."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every row, the lowest number on ties, and its squared distance.

    A product ranks the centres; rows whose best two are closer than rounding could tell are ranked again by
    differences, and so are all distances that are given back."""
    xx, cc = (x * x).sum(axis=1), (centers * centers).sum(axis=1)
    rank = cc - 2 * (x @ centers.T)
    c = rank.argmin(axis=1)
    if len(centers) > 1:
        two = np.partition(rank, 1, axis=1)[:, :2]
        near = two[:, 1] - two[:, 0] <= 16 * x.shape[1] * np.finfo(float).eps * (xx + cc.max())
        if near.any():
            c[near] = squared_distances(x[near], centers).argmin(axis=1)
    return c, ((x - centers[c]) ** 2).sum(axis=1)


@dataclass
class KMeansResult:
    centers: np.ndarray
    assignments: MatrixFrame
    iterations: int
    objective: float


@operator("nearest_center")
def assign(a: MatrixFrame, centers: np.ndarray) -> MatrixFrame:
    """The nearest centre of every row, an n x 1 matrix; the lowest number wins ties."""
    shared = a.spark.sparkContext.broadcast(np.asarray(centers, dtype=float))
    return a.map_blocks(lambda ids, x: nearest(x, shared.value)[0][:, None], 1)


def cluster_ids(assignments: MatrixFrame):
    """``row_id, cluster`` with integer clusters."""
    return assignments.df.select("row_id", F.element_at("features", 1).cast("int").alias("cluster"))


def step(a: MatrixFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums of rows and counts of each cluster, and the sum of squared distances, in one pass."""
    k, d = centers.shape
    shared = a.spark.sparkContext.broadcast(centers)

    def block(ids, x):
        c, d2 = nearest(x, shared.value)
        out = np.zeros((k, d + 2))
        order = np.argsort(c, kind="stable")
        some, start = np.unique(c[order], return_index=True)
        out[some, :d] = np.add.reduceat(x[order], start, axis=0)
        out[:, d] = np.bincount(c, minlength=k)
        out[:, d + 1] = np.bincount(c, d2, minlength=k)
        return out

    total = a.sum_local(block, (k, d + 2))
    shared.unpersist()
    return total[:, :d], total[:, d], float(total[:, d + 1].sum())


def _rows(a: MatrixFrame, ids) -> np.ndarray:
    got = {r[0]: r[1] for r in a.df.where(F.col("row_id").isin([int(i) for i in ids])).collect()}
    return np.array([got[int(i)] for i in ids])


def initial_centers(a: MatrixFrame, k: int, init: str = "k-means||", init_steps: int = 2, seed: int = SEED) -> np.ndarray:
    n = a.n_rows
    rng = np.random.default_rng(seed)
    if init == "first_k":
        return _rows(a, range(min(k, n)))
    if init == "random":
        return _rows(a, sorted(rng.choice(n, min(k, n), replace=False)))
    if init != "k-means||":
        raise ValueError(f"no initialisation is called {init!r}")
    candidates = _rows(a, [rng.integers(n)])
    for s in range(init_steps):
        total = step(a, candidates)[2]
        if total <= 0:
            break
        shared = a.spark.sparkContext.broadcast((candidates, total))

        def drawn(ids, x, s=s, shared=shared):
            c, z = shared.value
            d2 = nearest(x, c)[1]
            chosen = uniform(ids, seed, s + 1) < 2 * k * d2 / z
            return np.column_stack([chosen, x])

        flagged = a.map_blocks(drawn, a.n_cols + 1).df.where(F.element_at("features", 1) > 0)  # 2k rows expected
        new = [r[1][1:] for r in flagged.orderBy("row_id").collect()]
        if new:
            candidates = np.vstack([candidates, np.array(new)])
    weights = step(a, candidates)[1]
    return weighted_kmeans_pp(candidates, weights, k, rng)


def weighted_kmeans_pp(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """k of a few weighted points by D² sampling, then Lloyd rounds, on the driver."""
    points, first = np.unique(points, axis=0, return_index=True)
    weights = np.maximum(weights[first], 1e-12)
    if len(points) <= k:
        return points
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    while len(chosen) < k:
        d2 = squared_distances(points, points[chosen]).min(axis=1) * weights
        if d2.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(points), p=d2 / d2.sum())))
    centers = points[chosen]
    for _ in range(rounds):
        c = squared_distances(points, centers).argmin(axis=1)
        w = np.bincount(c, weights, len(centers))
        new = np.stack([np.bincount(c, weights * points[:, j], len(centers)) for j in range(points.shape[1])], axis=1)
        new = np.where(w[:, None] > 0, new / np.maximum(w, 1e-300)[:, None], centers)
        if np.allclose(new, centers, rtol=0, atol=1e-12):
            break
        centers = new
    return centers


def kmeans(
    a: MatrixFrame, k: int, max_iters: int = 100, epsilon: float = 1e-4, init: str = "k-means||", init_steps: int = 2,
    seed: int = SEED, stop_rule: str = "all", centers: np.ndarray | None = None,
) -> KMeansResult:
    """Lloyd's algorithm. It ends when every centre (with ``stop_rule="any"``, when any) moves by ``epsilon``
    at most, or after ``max_iters`` rounds. An empty cluster gets a seeded uniform row as its centre, and
    one more round. With fewer distinct rows than k there are as many clusters as initial centres."""
    if not 0 <= epsilon <= 1:
        raise ValueError("epsilon must be between 0 and 1")
    if k < 1 or not a.n_rows:
        raise ValueError("k-means needs a row and a cluster at least")
    if stop_rule not in ("all", "any"):
        raise ValueError("stop_rule is 'all' or 'any'")
    kept = a.df.storageLevel.useMemory or a.df.storageLevel.useDisk  # the caller's own, and left as it is
    if not kept:
        a.df.persist()
    try:
        c = initial_centers(a, k, init, init_steps, seed) if centers is None else np.array(centers, dtype=float)
        rng = np.random.default_rng(seed + 1)
        done = 0
        while done < max_iters:
            sums, counts, _ = step(a, c)
            empty = np.flatnonzero(counts == 0)
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
            if len(empty) and a.n_rows > len(c):
                new[empty] = _rows(a, rng.integers(a.n_rows, size=len(empty)))
            moved = np.sqrt(((new - c) ** 2).sum(axis=1))
            c = new
            done += 1
            log.debug("k-means round %d: centres moved by %.3e at most, %d empty", done, moved.max(), len(empty))
            if not (len(empty) and a.n_rows > len(c)) and (moved.max() if stop_rule == "all" else moved.min()) <= epsilon:
                break
        objective = step(a, c)[2]
        log.info("k-means: %d rounds, objective %.6g", done, objective)
    finally:
        if not kept:
            a.df.unpersist()
    return KMeansResult(c, assign(a, c), done, objective)
