"""How products, transposes and reductions run.

=============  =====================================================  ==============================
strategy       when                                                   what moves
=============  =====================================================  ==============================
broadcast      the right operand has at most ``LOCAL_BYTES``          the right operand, to all tasks
cross          a transposed left operand over the same rows           one row range's join, small sums
panels         asked for: the right operand is a few times as large   its column panels, then the product
blocks         both operands are large                                blocks, on the inner index
coo            asked for: sparse cells, or a result to compare        cells, on the inner index
=============  =====================================================  ==============================
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import FAN, LOCAL_BYTES, LONGEST_ROW, MatrixFrame, batch_of, block_of, partitions_of

BLOCK = 1024
BLOCK_SCHEMA = "bi int, bj int, nr int, nc int, data array<double>"
INNER_SCHEMA = f"{BLOCK_SCHEMA}, bk int"


def matmul(a: MatrixFrame, b: MatrixFrame, strategy: str | None = None, local_bytes: int = LOCAL_BYTES) -> MatrixFrame:
    (n, k), (k2, m) = a.dims(), b.dims()
    if k != k2:
        raise ValueError(f"shapes {(n, k)} and {(k2, m)} can't be multiplied")
    strategy = strategy or ("broadcast" if b.n_bytes() <= local_bytes else "blocks")
    if strategy == "broadcast":
        return times_local(a, b.local(local_bytes))
    if strategy == "panels":
        return _panel_product(a, b, local_bytes)
    if strategy == "blocks":
        return _block_product(a, b)
    if strategy == "coo":
        return MatrixFrame.from_coo(coo_product(a.to_coo(), b.to_coo()), n, m)
    raise ValueError(f"no strategy is called {strategy!r}")


def times_local(a: MatrixFrame, b: np.ndarray) -> MatrixFrame:
    """Each row times a matrix that every task gets; no shuffle."""
    if a.n_cols != len(b):
        raise ValueError(f"shapes {a.dims()} and {b.shape} can't be multiplied")
    if b.nbytes > 4 * LOCAL_BYTES:
        raise ValueError(f"a local matrix of {b.nbytes} bytes is too large to broadcast")
    shared = a.spark.sparkContext.broadcast(np.ascontiguousarray(b))
    return a.map_blocks(lambda ids, x: x @ shared.value, b.shape[1])


def _panel_product(a: MatrixFrame, b: MatrixFrame, local_bytes: int) -> MatrixFrame:
    """Column panels of B that may be broadcast, one after the other; rows of the product are put together once."""
    k, m = b.dims()
    width = max(1, local_bytes // max(1, 8 * k))
    parts = []
    for s in range(0, m, width):
        w = min(width, m - s)
        panel = MatrixFrame(b.df.select("row_id", F.slice("features", s + 1, w).alias("features")), k, w)
        parts.append(times_local(a, panel.local(max(local_bytes, 8 * k))).df.withColumn("panel", F.lit(s)))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    rows = every.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("panel", "features"))).alias("parts"))
    return MatrixFrame(rows.select("row_id", F.flatten(F.col("parts.features")).alias("features")), a.n_rows, m)


def coo_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of cells, in Catalyst's operators alone."""
    left = a.select("row_id", F.col("col_id").alias("inner"), F.col("value").alias("x"))
    right = b.select(F.col("row_id").alias("inner"), "col_id", F.col("value").alias("y"))
    return left.join(right, "inner").groupBy("row_id", "col_id").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def gram(a: MatrixFrame) -> MatrixFrame:
    """AᵀA by summed partial products: one scan, and a shuffle of one n x n sum a task; past ``LOCAL_BYTES``, a panel at a time."""
    n = a.n_cols
    wide = max(1, LOCAL_BYTES // max(1, 8 * n))
    if wide >= n:
        return a.sum_blocks(lambda ids, x: x.T @ x, (n, n))
    # a task holds one panel of the sum's rows; each panel is a scan
    rows = None
    for s in range(0, n, wide):
        e = min(n, s + wide)
        panel = a.sum_blocks(lambda ids, x, s=s, e=e: x[:, s:e].T @ x, (e - s, n)).df
        panel = panel.select((F.col("row_id") + s).alias("row_id"), "features")
        rows = panel if rows is None else rows.unionByName(panel)
    return MatrixFrame(rows, n, n)


def gram_coo(cells: DataFrame) -> DataFrame:
    """AᵀA of cells as a self-join on the row."""
    left = cells.select("row_id", F.col("col_id").alias("i"), F.col("value").alias("x"))
    right = cells.select("row_id", F.col("col_id").alias("j"), F.col("value").alias("y"))
    pairs = left.join(right, "row_id").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))
    return pairs.select(F.col("i").alias("row_id"), F.col("j").alias("col_id"), "value")


def side_by_side(a: MatrixFrame, b: MatrixFrame) -> MatrixFrame:
    """[A | B] by a join on the row id, of the rows that A's blocks are computed from if those are narrower."""
    return a.beside(b)


def cross_product(a: MatrixFrame, b: MatrixFrame) -> MatrixFrame:
    """AᵀB: rows meet by id, and their outer products are summed where they meet."""
    k = a.n_cols
    return side_by_side(a, b).sum_blocks(lambda ids, x: x[:, :k].T @ x[:, k:], (k, b.n_cols))


def transposed(a: MatrixFrame) -> MatrixFrame:
    """Aᵀ in row form, by a shuffle of all cells; refused where rows would be too long to hold."""
    n, m = a.dims()
    if n > LONGEST_ROW:
        raise ValueError(f"the transpose of a {n} x {m} matrix has rows of {n} values; use its cells (coo) instead")
    cells = a.to_coo().groupBy("col_id").agg(F.array_sort(F.collect_list(F.struct("row_id", "value"))).alias("cells"))
    return MatrixFrame(cells.select(F.col("col_id").alias("row_id"), F.col("cells.value").alias("features")), m, n)


def transposed_coo(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "value")


def to_blocks(a: MatrixFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of ``size`` by ``size`` cells, row by row: strips of each batch, then one block a key."""
    n, m = a.dims()

    def strips(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = block_of(b)
            rows = []
            for bi in np.unique(ids // size):
                own = ids // size == bi
                for bj in range(-(-m // size)):
                    part = x[own, bj * size : (bj + 1) * size]
                    rows.append((int(bi), bj, ids[own], part.ravel()))
            yield pa.record_batch(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.float64()))],
                ["bi", "bj", "ids", "data"],
            )

    def whole(table: pa.Table) -> pa.Table:
        bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        nr, nc = min(size, n - bi * size), min(size, m - bj * size)
        block = np.zeros((nr, nc))
        for ids, data in zip(table.column("ids"), table.column("data"), strict=True):
            at = ids.values.to_numpy() - bi * size
            block[at] = data.values.to_numpy().reshape(len(at), nc)
        return _block_table(bi, bj, block)

    parts = a.df.mapInArrow(strips, "bi int, bj int, ids array<long>, data array<double>")
    return parts.groupBy("bi", "bj").applyInArrow(whole, BLOCK_SCHEMA)


def _inner_table(bi: int, bj: int, bk: int, block: np.ndarray) -> pa.Table:
    return _block_table(bi, bj, block).append_column("bk", pa.array([bk], pa.int32()))


def _block_table(bi: int, bj: int, block: np.ndarray) -> pa.Table:
    ints = [pa.array([v], pa.int32()) for v in (bi, bj, *block.shape)]
    return pa.table([*ints, pa.array([block.ravel()], pa.list_(pa.float64()))], names=["bi", "bj", "nr", "nc", "data"])


def from_blocks(blocks: DataFrame, n_rows: int, n_cols: int, size: int = BLOCK) -> MatrixFrame:
    """Row form of blocks: strips of each block row join by id."""

    def rows(table: pa.Table) -> pa.Table:
        bi = table.column("bi")[0].as_py()
        out = np.zeros((min(size, n_rows - bi * size), n_cols))
        for bj, nr, nc, data in zip(*(table.column(c) for c in ("bj", "nr", "nc", "data")), strict=True):
            s = bj.as_py() * size
            out[:, s : s + nc.as_py()] = data.values.to_numpy().reshape(nr.as_py(), nc.as_py())
        return pa.Table.from_batches([batch_of(np.arange(len(out)) + bi * size, out)])

    return MatrixFrame(blocks.groupBy("bi").applyInArrow(rows, "row_id long, features array<double>"), n_rows, n_cols)


def _block_product(a: MatrixFrame, b: MatrixFrame, size: int | None = None) -> MatrixFrame:
    size = size or BLOCK
    left = to_blocks(a, size).select("bi", F.col("bj").alias("bk"), F.col("nr"), F.col("nc").alias("inner"), F.col("data").alias("x"))
    right = to_blocks(b, size).select(F.col("bi").alias("bk"), "bj", "nc", F.col("data").alias("y"))
    pairs = left.join(right, "bk").select("bi", "bj", "bk", "nr", "inner", "nc", "x", "y")

    def multiply(batches):
        for batch in batches:
            for s in range(batch.num_rows):
                bi, bj, bk, nr, inner, nc = (batch.column(c)[s].as_py() for c in range(6))
                x, y = (batch.column(c)[s].values.to_numpy() for c in (6, 7))
                yield _inner_table(bi, bj, bk, x.reshape(nr, inner) @ y.reshape(inner, nc)).to_batches()[0]

    def add(table: pa.Table) -> pa.Table:
        nr, nc = table.column("nr")[0].as_py(), table.column("nc")[0].as_py()
        total = np.zeros(nr * nc)
        for data in table.column("data"):
            total += data.values.to_numpy()
        bi, bj, bk = (table.column(c)[0].as_py() for c in ("bi", "bj", "bk"))
        return _inner_table(bi, bj, bk // FAN, total.reshape(nr, nc))

    products = pairs.mapInArrow(multiply, INNER_SCHEMA)
    inner = -(-a.n_cols // size)
    while True:  # at most FAN partial products of a block meet in one task
        products = products.groupBy("bi", "bj", (F.col("bk") / FAN).cast("int")).applyInArrow(add, INNER_SCHEMA)
        inner = -(-inner // FAN)
        if inner <= 1:
            break
    return from_blocks(products.drop("bk"), a.n_rows, b.n_cols, size)


def triangle_fits(n: int, fan: int = 16) -> bool:
    """Whether ``fan`` triangles of n columns may meet in one task."""
    return 8 * n * n * fan <= 4 * LOCAL_BYTES


def tsqr(a: MatrixFrame, fan: int = 16) -> np.ndarray:
    """R of A = QR. Tasks reduce their rows to one triangle; triangles are merged ``fan`` at a time on the
    executors until few enough are left for the driver."""
    n = a.n_cols
    if not triangle_fits(n, fan):
        raise ValueError(f"{n} columns are too many for triangles of {n} x {n}")

    def triangle(batches):
        from pyspark import TaskContext

        r = np.zeros((0, n))
        for b in batches:
            if b.num_rows:
                r = np.linalg.qr(np.vstack([r, block_of(b)[1]]), mode="r")
        if len(r):
            yield batch_of(np.full(len(r), TaskContext.get().partitionId()), r)

    def merge(table: pa.Table) -> pa.Table:
        key = table.column(0)[0].as_py() // fan
        r = np.linalg.qr(np.vstack([block_of(b)[1] for b in table.to_batches() if b.num_rows]), mode="r")
        return pa.Table.from_batches([batch_of(np.full(len(r), key), r)])

    parts = partitions_of(a.df)
    df = a.df.mapInArrow(triangle, "row_id long, features array<double>")
    while parts > fan:
        df = df.groupBy((F.col("row_id") / fan).cast("long")).applyInArrow(merge, "row_id long, features array<double>")
        parts = -(-parts // fan)
    got = [block_of(b)[1] for b in df.toArrow().to_batches() if b.num_rows]
    return np.linalg.qr(np.vstack(got), mode="r") if got else np.zeros((0, n))
