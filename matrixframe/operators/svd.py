"""Singular value decompositions of tall matrices."""

from __future__ import annotations

import logging

import numpy as np

from ..frame import LOCAL_BYTES, MatrixFrame
from ..plans import physical
from .linalg import atax

log = logging.getLogger(__name__)

#: Components under this share of the largest singular value are dropped.
RCOND = 1e-9


def fixed_signs(v: np.ndarray) -> np.ndarray:
    """Columns with their entry of largest magnitude made positive."""
    top = v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] if v.size else np.ones(v.shape[1])
    return v * np.where(top < 0, -1.0, 1.0)


def _left(a: MatrixFrame, s: np.ndarray, v: np.ndarray) -> MatrixFrame:
    return physical.times_local(a, v / np.where(s > 0, s, 1.0))


def thin_svd(a: MatrixFrame) -> tuple[MatrixFrame, np.ndarray, np.ndarray]:
    """U (n x k), singular values in descending order, and V (m x k), with k = min(n, m).

    R of A = QR comes from one pass; the driver decomposes R, and U = A·V/σ is a second, lazy pass. A wide
    matrix is turned first. Directions without a singular value above the cut-off get zero columns of U.
    """
    n, m = a.dims()
    if n < m:
        u, s, v = thin_svd(physical.transposed(a))
        return MatrixFrame.from_numpy(a.spark, v), s, u.local()
    _, s, vt = np.linalg.svd(physical.tsqr(a), full_matrices=False)
    v = fixed_signs(vt.T)
    kept = np.where(s > RCOND * s.max(initial=0), s, np.inf)
    return physical.times_local(a, v / kept), s, v


def truncated_svd(
    a: MatrixFrame, k: int, method: int | None = None, order: str = "asc", seed: int = 0, gram_bytes: int = LOCAL_BYTES
) -> tuple[MatrixFrame, np.ndarray, np.ndarray]:
    """The ``k`` largest singular values, ascending unless ``order`` is "desc", with U and V.

    Method 1 sums AᵀA in one pass and decomposes it on the driver; 0 and 2 run a Lanczos iteration, one
    pass of Aᵀ(Ax) a step. By default AᵀA is used if it fits in ``gram_bytes``. There are min(k, rank)
    components: those under the cut-off are dropped.
    """
    if k < 1:
        raise ValueError("at least one component is needed")
    if order not in ("asc", "desc"):
        raise ValueError("order is 'asc' or 'desc'")
    m = a.n_cols
    method = (1 if 8 * m * m <= gram_bytes else 0) if method is None else method
    if method == 1:
        values, vectors = np.linalg.eigh(physical.gram(a).local(max(gram_bytes, LOCAL_BYTES)))
        values, vectors = values[::-1], vectors[:, ::-1]
    elif method in (0, 2):
        values, vectors = lanczos(lambda x: atax(a, x), m, k, seed)
    else:
        raise ValueError("method is 0, 1 or 2")
    s = np.sqrt(np.maximum(values[:k], 0))
    # eigenvalues of AᵀA are known to a few machine epsilons of the largest, singular values to their root
    keep = s > max(RCOND, np.sqrt(10 * m * np.finfo(float).eps)) * s.max(initial=0)
    s, v = s[keep], fixed_signs(vectors[:, :k][:, keep])
    if order == "asc":
        s, v = s[::-1].copy(), v[:, ::-1].copy()
    return _left(a, s, v), s, v


def lanczos(times, n: int, k: int, seed: int = 0, tol: float = 1e-12, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenpairs of a symmetric operator, fully reorthogonalised. A Krylov space has one
    direction of each repeated eigenvalue, so after convergence a new direction is drawn and followed for
    as many steps, until that no longer changes what is found. Ends with an error if that takes more than ``most`` steps."""
    most = min(n, most or 10 * k + 500)
    rng = np.random.default_rng(seed)
    q = np.zeros((n, 0))
    t = np.zeros((most, most))
    x = rng.normal(size=n)
    values, vectors, before = np.zeros(0), np.zeros((n, 0)), None
    until = 0
    for j in range(most):
        for _ in range(2):
            x -= q @ (q.T @ x)
        norm = np.linalg.norm(x)
        if norm < 1e-10:
            x = rng.normal(size=n)
            for _ in range(2):
                x -= q @ (q.T @ x)
            norm = np.linalg.norm(x)
        q = np.column_stack([q, x / norm])
        x = times(q[:, j])
        t[: j + 1, j] = t[j, : j + 1] = q.T @ x
        if j + 1 >= min(n, k):
            w, z = np.linalg.eigh(t[: j + 1, : j + 1])
            order = np.argsort(-w)[:k]
            rest = x - q @ (q.T @ x)
            error = np.linalg.norm(rest) * np.abs(z[j, order])
            log.debug("lanczos step %d: error %.3e", j + 1, error.max(initial=0))
            values, vectors = w[order], q @ z[:, order]
            if j >= until and (error <= tol * max(abs(w).max(), 1e-300)).all():
                if before is not None and np.allclose(values, before, rtol=1e-9, atol=1e-9 * abs(w).max()):
                    return values, vectors
                before, x, until = values, rng.normal(size=n), 2 * (j + 1)
    if most < n:
        raise RuntimeError(f"{k} eigenpairs didn't converge in {most} Lanczos steps")
    return values, vectors
