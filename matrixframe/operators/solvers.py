"""Least squares: LSQR, and ridge or kernel ridge regression by conjugate gradients."""

from __future__ import annotations

import logging

import numpy as np

from ..frame import LOCAL_BYTES, MatrixFrame, checkpointed
from ..plans import physical

CG_TOLERANCE = 1e-10
#: LSQR steps between two checkpoints of its left vectors.
REPLAY = 10

log = logging.getLogger(__name__)


class LocalSides:
    """Left vectors of Golub-Kahan bidiagonalisation, a column a right-hand side, for a matrix on the driver."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.u = a, np.array(b, dtype=float)

    def _normed(self) -> tuple[np.ndarray, np.ndarray]:
        beta = np.linalg.norm(self.u, axis=0)
        self.u = self.u / np.where(beta > 0, beta, 1.0)
        return self.a.T @ self.u, beta

    def begin(self) -> tuple[np.ndarray, np.ndarray]:
        return self._normed()

    def advance(self, v: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """u becomes A·v − α·u, normed: gives Aᵀu and the norm."""
        self.u = self.a @ v - alpha * self.u
        return self._normed()


class RowSides:
    """The same where only vectors of A's width fit on the driver. A step is one pass over [A | u], which sums
    Aᵀu and ‖u‖² before u is normed. A row's u follows from the row and the steps since the last checkpoint, so tasks
    work it out again, and it is written every ``REPLAY`` steps."""

    def __init__(self, a: MatrixFrame, b: MatrixFrame):
        self.p, self.m = a.n_cols, b.n_cols
        self.rows = a.beside(b)
        self.steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _pass(self, v: np.ndarray | None, alpha: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        p, shared = self.p, self.rows.spark.sparkContext.broadcast((list(self.steps), v, alpha))

        def block(ids, x):
            left, u = x[:, :p], replayed(x[:, :p], x[:, p:], shared.value[0])
            if shared.value[1] is not None:
                u = left @ shared.value[1] - shared.value[2] * u
            return np.vstack([left.T @ u, (u * u).sum(axis=0)])

        total = self.rows.sum_local(block, (p + 1, self.m))
        shared.unpersist()
        beta = np.sqrt(total[p])
        safe = np.where(beta > 0, beta, 1.0)
        self.steps.append((v, alpha, safe))
        if len(self.steps) == REPLAY:
            done, self.steps = self.rows.spark.sparkContext.broadcast(self.steps), []
            moved = self.rows.map_blocks(lambda ids, x: np.column_stack([x[:, :p], replayed(x[:, :p], x[:, p:], done.value)]))
            self.rows = MatrixFrame(checkpointed(moved.df), self.rows.n_rows, p + self.m)
        return total[:p] / safe, beta

    def begin(self) -> tuple[np.ndarray, np.ndarray]:
        return self._pass(None, None)

    def advance(self, v: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._pass(v, alpha)


def replayed(left: np.ndarray, u: np.ndarray, steps) -> np.ndarray:
    for v, alpha, beta in steps:
        u = (u if v is None else left @ v - alpha * u) / beta
    return u


def lsqr_steps(sides: LocalSides | RowSides, tol: float, max_iters: int) -> np.ndarray:
    """LSQR for all right-hand sides at once. A side ends when its gradient has fallen to ``tol`` of the first one's,
    or its residual to ``tol`` of A's and X's size; the others go on, to ``max_iters`` steps at most."""
    unit = lambda x, n: x / np.where(n > 0, n, 1.0)
    atu, beta = sides.begin()
    alpha = np.linalg.norm(atu, axis=0)
    v = unit(atu, alpha)
    x, w = np.zeros_like(v), v.copy()
    phi, rho, size, start = beta, alpha, np.zeros_like(beta), alpha * beta
    going = start > 0
    for k in range(max_iters):
        if not going.any():
            break
        atu, beta = sides.advance(v, alpha)
        size = np.hypot(size, np.hypot(alpha, beta))
        v = atu - beta * v
        alpha = np.linalg.norm(v, axis=0)
        v = unit(v, alpha)
        r = np.hypot(rho, beta)
        c, s = unit(rho, r), unit(beta, r)
        theta, rho = s * alpha, -c * alpha
        x = np.where(going, x + unit(c * phi, r) * w, x)
        w = v - unit(theta, r) * w
        phi = s * phi
        gradient = np.abs(phi * alpha * c)
        going &= (gradient > tol * start) & (phi > tol * size * np.linalg.norm(x, axis=0)) & (r > 0)
        log.debug("lsqr step %d: gradient %.3e, %d sides left", k + 1, gradient.max(initial=0), going.sum())
    return x


def lsqr(a: MatrixFrame, b: MatrixFrame, tol: float = 1e-14, max_iters: int = 100, triangle_bytes: int = LOCAL_BYTES) -> np.ndarray:
    """X (p x m) that minimises ‖AX − B‖, a right-hand side a column of B.

    If a triangle of A's and B's columns fits, one pass reduces [A | B] to R, which has the same least
    squares, and LSQR runs on R's columns. Else each step of all sides is one pass over [A | u].
    """
    p, n = a.n_cols, a.n_cols + b.n_cols
    if 8 * n * n <= triangle_bytes and physical.triangle_fits(n):
        r = physical.tsqr(a.beside(b))
        return lsqr_steps(LocalSides(r[:, :p], r[:, p:]), tol, max_iters)
    return lsqr_steps(RowSides(a, b), tol, max_iters)


def cg(times, b: np.ndarray, max_iters: int, tol: float = CG_TOLERANCE, x0: np.ndarray | None = None) -> tuple[np.ndarray, int, bool]:
    """Conjugate gradients for all columns at once: X, the steps taken, and whether every column's residual
    fell under ``tol`` (32 machine epsilons at least) times its right-hand side's norm."""
    tol = max(tol, 32 * np.finfo(float).eps)
    x = np.zeros_like(b) if x0 is None else np.array(x0, dtype=float)
    r = b - (times(x) if x0 is not None else 0.0)
    p = r.copy()
    norm = np.linalg.norm(b, axis=0)
    rr = (r * r).sum(axis=0)
    steps = 0
    while steps < max_iters and not (np.sqrt(rr) <= tol * norm).all():
        q = times(p)
        curve = (p * q).sum(axis=0)
        alpha = np.divide(rr, curve, out=np.zeros_like(rr), where=curve > 0)
        x += alpha * p
        r -= alpha * q
        new = (r * r).sum(axis=0)
        p = r + np.divide(new, rr, out=np.zeros_like(rr), where=rr > 0) * p
        rr = new
        steps += 1
        log.debug("cg step %d: largest residual %.3e", steps, np.sqrt(rr).max(initial=0))
    done = bool((np.sqrt(rr) <= tol * norm).all())
    log.info("cg: %d steps, %s", steps, "converged" if done else "not converged")
    return x, steps, done


def ridge_cg(
    f: MatrixFrame, y: MatrixFrame, lam: float, max_iters: int = 500, tol: float = CG_TOLERANCE,
    gram_bytes: int = LOCAL_BYTES, x0: np.ndarray | None = None,
) -> np.ndarray:
    """X of (AᵀA + λnI)X = AᵀY, which minimises ‖AX − Y‖²/2n + λ‖X‖²/2, by conjugate gradients.

    Targets are joined to the rows that A's features are computed from, so a feature map's output is never
    shuffled. If AᵀA fits, one pass sums it with AᵀY and the steps run on the driver. Else those rows are
    kept, and each step is a pass that computes the features again and sums Aᵀ(AP), with P sent to all tasks.
    """
    n, p, m = f.n_rows, f.n_cols, y.n_cols
    both, split = f.paired(y)

    def sums(fn, shape):
        return both.sum_local(lambda ids, x: fn(*split(ids, x)), shape)

    if 8 * p * (p + m) <= gram_bytes:
        found = sums(lambda a, b: a.T @ np.column_stack([a, b]), (p, p + m))
        ata, aty = found[:, :p], found[:, p:]
        return cg(lambda v: ata @ v + lam * n * v, aty, max_iters, tol, x0)[0]
    both.persist()
    try:
        aty = sums(lambda a, b: a.T @ b, (p, m))

        def times(v):
            shared = both.spark.sparkContext.broadcast(v)
            out = sums(lambda a, b: a.T @ (a @ shared.value), (p, m)) + lam * n * v
            shared.unpersist()
            return out

        return cg(times, aty, max_iters, tol, x0)[0]
    finally:
        both.unpersist()
