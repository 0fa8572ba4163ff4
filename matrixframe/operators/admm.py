"""Block-splitting ADMM for linear and kernel models with several losses and regularisers."""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from ..frame import LOCAL_BYTES, MatrixFrame
from ..functions.kernels import Kernel, feature_map
from ..functions.losses import Loss, Regularizer, loss_value, prox_loss, prox_regularizer, regularizer_value

log = logging.getLogger(__name__)

#: Rounds between two checkpoints of the rows' state.
REPLAY = 10
#: Classes at most, a column of targets each; more are refused.
MOST_CLASSES = 10_000


@dataclass
class AdmmResult:
    coefficients: np.ndarray
    rounds: int
    primal: float
    dual: float
    objective: float


def targets(y: MatrixFrame, regression: bool) -> MatrixFrame:
    """Targets as the losses want them: for classification 0/1 or class numbers become −1 and 1, a column a
    class against all others. More than ``MOST_CLASSES`` raise an error."""
    if regression:
        return y
    if y.n_cols > 1:
        return y.map_rows(F.transform("features", lambda v: F.when(v > 0, 1.0).otherwise(-1.0)), y.n_cols)
    classes = [r[0] for r in y.df.select(F.element_at("features", 1)).distinct().orderBy(F.element_at("features", 1)).limit(MOST_CLASSES + 1).collect()]
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    if len(classes) <= 2:
        top = classes[-1] if classes else 1.0
        return y.map_rows(F.transform("features", lambda v: F.when(v == top, 1.0).otherwise(-1.0)), 1)
    each = F.array(*[F.lit(c) for c in classes])
    first = F.element_at("features", 1)
    return y.map_rows(F.transform(each, lambda c: F.when(c == first, 1.0).otherwise(-1.0)), len(classes))


class SummedOutputs:
    """Outputs o of all rows and their duals d under the squared loss, by ZᵀZ and ZᵀY. The proximal point is linear in o, d and
    the target, so Zᵀo and Zᵀd follow from W alone and no round reads rows."""

    def __init__(self, ztz: np.ndarray, zty: np.ndarray, rho: float):
        self.ztz, self.zty, self.rho = ztz, zty, rho
        self.o, self.dual = np.zeros_like(zty), np.zeros_like(zty)

    def _half(self) -> np.ndarray:
        return prox_loss(Loss.SQUARED, self.o - self.dual, self.zty, self.rho)

    def summed(self) -> np.ndarray:
        """Zᵀ(o' + d), o' the proximal points."""
        return self._half() + self.dual

    def advance(self, w: np.ndarray) -> None:
        """o becomes ZW, and d grows by o' − o."""
        half = self._half()
        self.o = self.ztz @ w
        self.dual = self.dual + half - self.o


class RowOutputs:
    """The same for any loss, where o and d stay with the rows. They follow from the row and all rounds' W, so tasks
    recompute them from the W since the last checkpoint and nothing that a lost executor holds is needed; they are
    checkpointed every ``REPLAY`` rounds."""

    def __init__(self, both: MatrixFrame, split, loss: Loss, rho: float, scale: float, shape: tuple[int, int]):
        width, m = both.n_cols, shape[1]

        def replayed(ids: np.ndarray, x: np.ndarray, history: list[np.ndarray]):
            zi, t = split(ids, x[:, :width])
            zi, o, dual = zi / scale, x[:, width : width + m], x[:, width + m :]
            for wk in history:
                half = prox_loss(loss, o - dual, t, rho)
                o = zi @ wk
                dual = dual + half - o
            return zi, t, o, dual

        self.loss, self.rho, self.shape, self.width, self.replayed = loss, rho, shape, width, replayed
        # rows carry what z is computed from, the target, and the state at the last checkpoint: o and the dual of o
        self.state = both.map_blocks(lambda ids, x: np.column_stack([x, np.zeros((len(x), 2 * m))]), width + 2 * m)
        self.since: list[np.ndarray] = []

    def _settle(self) -> None:
        width, replayed, shared = self.width, self.replayed, self.state.spark.sparkContext.broadcast(self.since)
        moved = self.state.map_blocks(lambda ids, x: np.column_stack([x[:, :width], *replayed(ids, x, shared.value)[2:]]), self.state.n_cols)
        self.state = moved.checkpoint()
        self.since = []

    def summed(self) -> np.ndarray:
        if len(self.since) == REPLAY:
            self._settle()
        loss, rho, replayed, shared = self.loss, self.rho, self.replayed, self.state.spark.sparkContext.broadcast(list(self.since))

        def block(ids, x):
            zi, t, o, dual = replayed(ids, x, shared.value)
            return zi.T @ (prox_loss(loss, o - dual, t, rho) + dual)

        total = self.state.sum_local(block, self.shape)
        shared.unpersist()
        return total

    def advance(self, w: np.ndarray) -> None:
        self.since.append(w)


def admm(
    f: MatrixFrame, y: MatrixFrame, regression: bool = True, loss: Loss = Loss.SQUARED, regularizer: Regularizer = Regularizer.L2,
    kernel: Kernel = Kernel.LINEAR, kp: float = 1.0, kp2: float = 1.0, kp3: float = 0.0, lam: float = 0.0, max_iters: int = 20,
    tol: float = 1e-3, rho: float = 1.0, seed: int = 12345, random_features: int = 0, feature_partitions: int = 1,
) -> AdmmResult:
    """Coefficients W that minimise Σ loss(zᵢW, yᵢ) + λ·r(W), Z the feature map of F, by graph-form ADMM.

    One pass sums ZᵀZ; the factor of I + ZᵀZ stays on the driver. A round needs Zᵀ(o' + d) over the rows: o' is the proximal
    point and d the dual of a row's outputs. Under the squared loss o' is linear, so sums of the first pass stand for the rows
    and rounds read none (``SummedOutputs``); else a round is one pass (``RowOutputs``). Targets are joined to
    the rows that Z is computed from, and each pass computes Z again, so nothing as wide as Z is shuffled or kept. The
    feature map is in ``feature_partitions`` blocks of columns for the factorisation only.

    Ends when primal and dual residuals are under ``tol`` relative to their vectors, or after ``max_iters``.
    """
    loss, regularizer = Loss(loss), Regularizer(regularizer)
    z = feature_map(f, kernel, random_features, kp, kp2, kp3, seed)
    d = z.n_cols
    if 8 * d * d > 8 * LOCAL_BYTES:
        raise ValueError(f"{d} features are too many for a factor on the driver")
    wanted = targets(y, regression)
    m = wanted.n_cols
    both, split = z.paired(wanted)
    squared = loss == Loss.SQUARED
    if not squared:  # each round reads the rows: they are joined once
        both = both.checkpoint()
    together = squared and 8 * d * (d + m) <= 8 * LOCAL_BYTES

    def gram(ids, x):
        zi, t = split(ids, x)
        return zi.T @ (np.column_stack([zi, t]) if together else zi)

    def with_targets(ids, x):
        zi, t = split(ids, x)
        return zi.T @ t

    ztz = both.sum_local(gram, (d, d + m if together else d))
    if squared:
        ztz, zty = ztz[:, :d], ztz[:, d:] if together else both.sum_local(with_targets, (d, m))
    # features are scaled to a mean square sum of 1, or the steps of w and of o would differ by orders
    scale = float(np.sqrt(np.trace(ztz) / d)) or 1.0
    ztz = ztz / scale**2
    penalty = lam / scale**2 if regularizer == Regularizer.L2 else lam / scale
    factor = np.linalg.inv(np.eye(d) + ztz) if feature_partitions <= 1 else _blockwise_inverse(np.eye(d) + ztz, feature_partitions)
    outputs = SummedOutputs(ztz, zty / scale, rho) if squared else RowOutputs(both, split, loss, rho, scale, (d, m))
    w, w_dual = np.zeros((d, m)), np.zeros((d, m))
    primal = dual_residual = np.inf
    w_half = w
    rounds = 0
    while rounds < max_iters:
        w_half = prox_regularizer(regularizer, w - w_dual, penalty, rho)
        summed = outputs.summed()
        old = w
        w = factor @ (w_half + w_dual + summed)
        w_dual = w_dual + w_half - w
        outputs.advance(w)
        rounds += 1
        primal = float(np.linalg.norm(w_half - w) / max(np.linalg.norm(w), np.linalg.norm(w_half), 1e-12))
        dual_residual = float(np.linalg.norm(w - old) / max(np.linalg.norm(w), 1e-12))
        log.debug("admm round %d: primal %.3e, dual %.3e", rounds, primal, dual_residual)
        if primal <= tol and dual_residual <= tol:
            break
    w_half = w_half / scale
    final = f.spark.sparkContext.broadcast(w_half)

    def fit_of(ids, x):
        zi, t = split(ids, x)
        return np.array([[loss_value(loss, zi @ final.value, t)]])

    fit = both.sum_local(fit_of, (1, 1))[0, 0]
    log.info("admm: %d rounds, primal %.3e, dual %.3e", rounds, primal, dual_residual)
    return AdmmResult(w_half, rounds, primal, dual_residual, float(fit) + regularizer_value(regularizer, lam, w_half))


def _blockwise_inverse(a: np.ndarray, parts: int) -> np.ndarray:
    """The inverse by elimination of column blocks one at a time (Schur complements)."""
    if parts <= 1 or len(a) < 2:
        return np.linalg.inv(a)
    k = max(1, len(a) // parts)
    p, q, s = a[:k, :k], a[:k, k:], a[k:, k:]
    pi = np.linalg.inv(p)
    si = _blockwise_inverse(s - q.T @ pi @ q, parts - 1)
    x = pi @ q @ si
    return np.block([[pi + x @ q.T @ pi, -x], [-x.T, si]])
