"""Lazy matrix expressions.

``A @ B``, ``.T`` and ``gram`` build a small tree of products of leaves. Before anything runs,
transposes are pushed to the leaves and cancelled, chains are ordered by the cost of their shapes, and a
transposed leaf beside a leaf over the same rows becomes one pass of summed outer products, so that a
tall matrix is never turned.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..frame import MatrixFrame
from . import physical


class Expr:
    def __matmul__(self, other):
        other = as_expr(other)
        if self.shape[1] != other.shape[0]:
            raise ValueError(f"shapes {self.shape} and {other.shape} can't be multiplied")
        return Product((*self.factors(), *other.factors()))

    @property
    def T(self):  # noqa: N802
        raise NotImplementedError

    def factors(self) -> tuple:
        return (self,)

    def frame(self, strategy: str | None = None) -> MatrixFrame:
        """The result, still lazy, in row form."""
        return lower(self, strategy)

    def to_df(self):
        return self.frame().df

    def to_coo(self):
        return self.frame().to_coo()

    def to_numpy(self):
        return self.frame().to_numpy()


@dataclass(eq=False)
class Leaf(Expr):
    matrix: MatrixFrame
    turned: bool = False

    @property
    def shape(self):
        n, m = self.matrix.dims()
        return (m, n) if self.turned else (n, m)

    @property
    def T(self):  # noqa: N802
        return Leaf(self.matrix, not self.turned)


@dataclass(eq=False)
class Product(Expr):
    parts: tuple

    @property
    def shape(self):
        return self.parts[0].shape[0], self.parts[-1].shape[1]

    @property
    def T(self):  # noqa: N802
        return Product(tuple(p.T for p in reversed(self.parts)))

    def factors(self):
        return self.parts


def as_expr(x) -> Expr:
    return x if isinstance(x, Expr) else Leaf(x)


def chain_order(shapes: list[tuple[int, int]]):
    """The cheapest way to bracket a chain, as nested pairs of positions, by dynamic programming."""
    n = len(shapes)
    d = [shapes[0][0], *(s[1] for s in shapes)]
    cost = [[0] * n for _ in range(n)]
    cut = [[0] * n for _ in range(n)]
    for span in range(1, n):
        for i in range(n - span):
            j = i + span
            cost[i][j], cut[i][j] = min((cost[i][k] + cost[k + 1][j] + d[i] * d[k + 1] * d[j + 1], k) for k in range(i, j))

    def nest(i, j):
        return i if i == j else (nest(i, cut[i][j]), nest(cut[i][j] + 1, j))

    return nest(0, n - 1)


def lower(expr: Expr, strategy: str | None = None) -> MatrixFrame:
    parts = expr.factors()
    if len(parts) == 1:
        leaf = parts[0]
        return physical.transposed(leaf.matrix) if leaf.turned else leaf.matrix

    def build(order) -> Leaf:
        if isinstance(order, int):
            return parts[order]
        a, b = build(order[0]), build(order[1])
        return Leaf(multiply(a, b, strategy))

    return build(chain_order([p.shape for p in parts])).matrix


def multiply(a: Leaf, b: Leaf, strategy: str | None = None) -> MatrixFrame:
    if a.turned and not b.turned:
        if a.matrix is b.matrix:
            return physical.gram(a.matrix)
        return physical.cross_product(a.matrix, b.matrix)
    left = physical.transposed(a.matrix) if a.turned else a.matrix
    right = physical.transposed(b.matrix) if b.turned else b.matrix
    return physical.matmul(left, right, strategy)
