"""``MatrixFrame``: a dense float64 matrix as a DataFrame of rows."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_SCHEMA = "row_id long, features array<double>"
COO_SCHEMA = "row_id long, col_id long, value double"

#: Bytes of a matrix that may be gathered on the driver or broadcast; larger ones take another way.
LOCAL_BYTES = 64 << 20
#: Longest row that a transpose into row form may make.
LONGEST_ROW = 1 << 21
#: Partial sums that are merged at a time, and the cells of a sum that travel as one piece.
FAN, PANEL_CELLS = 32, 1 << 17
PANEL_SCHEMA = "part long, panel long, data array<double>"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a temporary one on a local master and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage at the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def partitions_of(df: DataFrame) -> int:
    """Tasks that ``df`` will have: exact for plans without shuffles, else what the plan or the session says of them."""
    execution = df._jdf.queryExecution()
    plan = execution.executedPlan()
    if plan.nodeName().startswith("Adaptive"):
        usual = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
        return max(usual, plan.inputPlan().outputPartitioning().numPartitions())
    return execution.toRdd().getNumPartitions()


def block_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row ids and the 2-D array of a batch in row form."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    column = batch.column(1)
    if column.null_count:
        raise ValueError("a row of a matrix is null")
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = len(values) // len(ids) if len(ids) else 0
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(ids) and (lengths != width).any():
        raise ValueError("rows of a matrix differ in length")
    return ids, values.reshape(len(ids), width)


def batch_of(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """A batch in row form."""
    x = np.ascontiguousarray(x, dtype=np.float64)
    if x.size >= 1 << 31:
        raise ValueError(f"a batch of {x.shape} is too large for one Arrow list column")
    offsets = np.arange(0, x.size + 1, x.shape[1] or 1, dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))
    return pa.record_batch([pa.array(np.asarray(ids, dtype=np.int64)), lists], ["row_id", "features"])


def panel_of(part: int, panel: int, x: np.ndarray) -> pa.RecordBatch:
    data = pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))
    return pa.record_batch([pa.array([part], pa.int64()), pa.array([panel], pa.int64()), data], ["part", "panel", "data"])


def sum_of(table: pa.Table) -> np.ndarray:
    """The sum of a few panels, added in the order of their tasks."""
    order = np.argsort(table.column("part").to_numpy(), kind="stable")
    data = table.column("data")
    total = data[int(order[0])].values.to_numpy().copy()
    for i in order[1:]:
        total += data[int(i)].values.to_numpy()
    return total


def merged_panels(table: pa.Table) -> pa.Table:
    part, panel = table.column("part").to_numpy().min() // FAN, table.column("panel")[0].as_py()
    return pa.Table.from_batches([panel_of(int(part), panel, sum_of(table))])


class MatrixFrame:
    """A lazy n x m matrix in row form: ``row_id`` from 0 to n-1 and ``features``, m doubles.

    Dimensions are counted once and kept. Operators never change a frame; they give new ones.
    """

    def __init__(self, df: DataFrame, n_rows: int | None = None, n_cols: int | None = None):
        self.df = df.select(F.col("row_id").cast("long").alias("row_id"), F.col("features").cast("array<double>").alias("features"))
        self._dims = (n_rows, n_cols) if n_rows is not None and n_cols is not None else None
        self._tasks: int | None = None
        #: The frame that this one's blocks were computed from, and how, if it is such and isn't kept itself.
        self.source: tuple[MatrixFrame, Callable] | None = None
        #: The frame that this one's rows were computed from, and the expression, if it is such and isn't kept itself.
        self.origin: tuple[MatrixFrame, Column] | None = None

    # -- construction

    @classmethod
    def from_df(cls, df: DataFrame, row_id: str = "row_id", features: str | list[str] = "features", check: bool = True) -> MatrixFrame:
        """From an id column and an array, MLlib vector, or several numeric columns.

        With ``check``, ids must be 0..n-1, each once, and rows of one length without nulls.
        """
        if isinstance(features, list):
            f = F.array(*[F.col(c).cast("double") for c in features])
        elif isinstance(df.schema[features].dataType, T.ArrayType):
            f = F.col(features).cast("array<double>")
        else:
            from pyspark.ml.functions import vector_to_array

            f = vector_to_array(F.col(features))
        out = cls(df.select(F.col(row_id).cast("long").alias("row_id"), f.alias("features")))
        return out.validated() if check else out

    @classmethod
    def from_coo(cls, coo: DataFrame, n_rows: int, n_cols: int) -> MatrixFrame:
        """From cells ``row_id, col_id, value``; missing cells are 0, repeated ones are summed."""
        spark = coo.sparkSession
        cells = coo.groupBy("row_id", "col_id").agg(F.sum("value").alias("value"))
        rows = cells.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("col_id", "value"))).alias("cells"))
        ids = spark.range(n_rows).select(F.col("id").alias("row_id"))
        cell = lambda j: F.coalesce(F.element_at("cells", j), F.lit(0.0))
        dense = ids.join(rows, "row_id", "left").select("row_id", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n_cols - 1).cast("long")), cell).alias("features"))
        return cls(dense, n_rows, n_cols)

    @classmethod
    def from_numpy(cls, spark: SparkSession, x: np.ndarray, partitions: int | None = None) -> MatrixFrame:
        x = np.atleast_2d(np.asarray(x, dtype=np.float64))
        table = pa.Table.from_batches([batch_of(np.arange(len(x)), x)])
        df = spark.createDataFrame(table) if len(x) else spark.createDataFrame([], ROW_SCHEMA)
        return cls(df.repartition(partitions) if partitions else df, *x.shape)

    @classmethod
    def from_indexed_row_matrix(cls, matrix) -> MatrixFrame:
        rows = matrix.rows.map(lambda r: (int(r.index), [float(v) for v in r.vector.toArray()]))
        return cls(rows.toDF(ROW_SCHEMA))

    # -- what it is

    def dims(self) -> tuple[int, int]:
        if self._dims is None:
            n, m = self.df.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
            self._dims = (n, m or 0)
        return self._dims

    @property
    def n_rows(self) -> int:
        return self.dims()[0]

    @property
    def n_cols(self) -> int:
        return self.dims()[1]

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def n_bytes(self) -> int:
        return 8 * self.n_rows * self.n_cols

    def validated(self) -> MatrixFrame:
        size = F.size("features")
        r = self.df.agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("ids"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"),
            F.min(size).alias("short"), F.max(size).alias("long"), F.count(F.when(F.col("features").isNull() | F.exists("features", F.isnull), 1)).alias("nulls"),
        ).first()
        if r["n"] and (r["ids"] != r["n"] or r["lo"] != 0 or r["hi"] != r["n"] - 1):
            raise ValueError(f"row ids must be 0 to {r['n'] - 1}, each once; there are {r['ids']} from {r['lo']} to {r['hi']}")
        if r["nulls"] or r["short"] != r["long"]:
            raise ValueError(f"rows must have one length and no nulls; they have {r['short']} to {r['long']} values, {r['nulls']} with nulls")
        self._dims = (r["n"], r["long"] or 0)
        return self

    # -- forms

    def to_df(self) -> DataFrame:
        return self.df

    def to_coo(self) -> DataFrame:
        cells = self.df.select("row_id", F.posexplode("features").alias("col_id", "value"))
        return cells.select("row_id", F.col("col_id").cast("long").alias("col_id"), "value")

    def to_numpy(self) -> np.ndarray:
        """The whole matrix in the order of its rows, sorted on the driver; meant for small ones and tests."""
        got = [block_of(b) for b in self.df.toArrow().to_batches() if b.num_rows]
        if not got:
            return np.zeros((0, self.n_cols))
        ids, x = (np.concatenate(c) for c in zip(*got, strict=True))
        return x[np.argsort(ids, kind="stable")]

    def local(self, limit: int = LOCAL_BYTES) -> np.ndarray:
        """``to_numpy`` of a matrix of at most ``limit`` bytes."""
        if self.n_bytes() > limit:
            raise ValueError(f"a {self.n_rows} x {self.n_cols} matrix has {self.n_bytes()} bytes; at most {limit} may be gathered")
        return self.to_numpy()

    def pretty(self, rows: int = 10, cols: int = 10, least: float = 1e-10) -> str:
        """The upper left corner as text, a line a row; values of ``least`` or under, negative ones too, show as 0."""
        corner = MatrixFrame(self.df.where(F.col("row_id") < rows).select("row_id", F.slice("features", 1, cols).alias("features")), None, None)
        lines = [" ".join(f"{v if v > least else 0.0:>12.6g}" for v in r) for r in corner.to_numpy()]
        more = [f"... {self.n_rows} x {self.n_cols}"] if self.n_rows > rows or self.n_cols > cols else []
        return "\n".join([*lines, *more])

    def to_indexed_row_matrix(self):
        from pyspark.mllib.linalg import Vectors
        from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

        return IndexedRowMatrix(self.df.rdd.map(lambda r: IndexedRow(r[0], Vectors.dense(r[1]))), self.n_rows, self.n_cols)

    def persist(self) -> MatrixFrame:
        self.df = self.df.persist()
        self.source = self.origin = None
        return self

    def unpersist(self) -> MatrixFrame:
        self.df.unpersist()
        return self

    def checkpoint(self) -> MatrixFrame:
        return MatrixFrame(checkpointed(self.df), *(self._dims or (None, None)))

    # -- the three ways to extend it

    def map_blocks(self, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], n_cols: int | None = None) -> MatrixFrame:
        """Rows as blocks through ``fn(ids, x)``, which gives as many rows, of any width."""

        def run(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                if b.num_rows:
                    ids, x = block_of(b)
                    yield batch_of(ids, fn(ids, x))

        dims = (self._dims[0], n_cols) if self._dims and n_cols is not None else (None, None)
        out = MatrixFrame(self.df.mapInArrow(run, ROW_SCHEMA), *dims)
        out.source = (self, fn)
        return out

    def paired(self, other: MatrixFrame) -> tuple[MatrixFrame, Callable]:
        """Rows of this frame joined with those of another by id, and a function that splits a block of them into
        both. Rows that blocks are computed from are joined before that where they are narrower, as a feature
        map's input is; so the wide side is never shuffled. Where expressions over the rows of one frame make both,
        they are computed side by side from these, without a join."""
        low, steps = self, []
        while low.source is not None and low._dims and low.source[0]._dims and low.source[0].n_cols <= low.n_cols:
            low, fn = low.source
            steps.insert(0, fn)
        joined = low._beside_by_rows(other)
        if joined is None:
            right = other.df.select("row_id", F.col("features").alias("right"))
            joined = low.df.join(right, "row_id").select("row_id", F.concat("features", "right").alias("features"))
        k = low.n_cols

        def split(ids, x):
            left = x[:, :k]
            for fn in steps:
                left = fn(ids, left)
            return left, x[:, k:]

        return MatrixFrame(joined, self.n_rows, k + other.n_cols), split

    def _origins(self) -> list[tuple[MatrixFrame, list[Column]]]:
        """This frame and those that its rows were computed from, each with the expressions from there."""
        found, at, steps = [(self, [])], self, []
        while at.origin is not None:
            at, column = at.origin
            steps = [column, *steps]
            found.append((at, steps))
        return found

    def _beside_by_rows(self, other: MatrixFrame) -> DataFrame | None:
        """Rows of this frame with those of another behind them, if expressions over one frame make both."""
        theirs = other._origins()
        for base, left in self._origins():
            right = next((steps for b, steps in theirs if b is base), None)
            if right is None:
                continue
            df = base.df.withColumn("base", F.col("features"))
            for column in left:
                df = df.withColumn("features", column.cast("array<double>"))
            df = df.select("row_id", F.col("features").alias("left"), F.col("base").alias("features"))
            for column in right:
                df = df.withColumn("features", column.cast("array<double>"))
            return df.select("row_id", F.concat("left", "features").alias("features"))
        return None

    def beside(self, other: MatrixFrame) -> MatrixFrame:
        """``[self | other]`` by a join on the row id."""
        if self.n_rows != other.n_rows:
            raise ValueError(f"matrices of {self.n_rows} and {other.n_rows} rows can't stand side by side")
        both, split = self.paired(other)
        if both.n_cols == self.n_cols + other.n_cols and self.source is None:
            return both
        return both.map_blocks(lambda ids, x: np.column_stack(split(ids, x)))._sized(self.n_rows, self.n_cols + other.n_cols)

    def _sized(self, n_rows: int, n_cols: int) -> MatrixFrame:
        self._dims = (n_rows, n_cols)
        return self

    def map_rows(self, column, n_cols: int | None = None) -> MatrixFrame:
        """Rows through a Spark expression over ``features``."""
        dims = (self._dims[0], n_cols) if self._dims and n_cols is not None else (None, None)
        out = MatrixFrame(self.df.select("row_id", column.alias("features")), *dims)
        out.origin = (self, column)
        return out

    def _partial_sums(self, fn, shape: tuple[int, int]) -> tuple[DataFrame, int, int]:
        """Every task's sum of ``fn(ids, x)`` in panels of rows, merged ``FAN`` tasks at a time until at most
        that many a panel are left; how many they are, and the rows of a panel."""
        step = max(1, PANEL_CELLS // max(1, shape[1]))

        def run(batches: Iterator[pa.RecordBatch]):
            from pyspark import TaskContext

            total, any_rows = None, False
            for b in batches:
                if b.num_rows:
                    part = fn(*block_of(b))
                    total = np.array(part, dtype=np.float64) if total is None else np.add(total, part, out=total)
                    any_rows = True
            if any_rows:
                task = TaskContext.get().partitionId()
                for panel, s in enumerate(range(0, shape[0], step)):
                    yield panel_of(task, panel, total[s : s + step])

        parts = self.df.mapInArrow(run, PANEL_SCHEMA)
        if self._tasks is None:
            self._tasks = partitions_of(self.df)
        n = self._tasks
        while n > FAN:
            parts = parts.groupBy((F.col("part") / FAN).cast("long"), "panel").applyInArrow(merged_panels, PANEL_SCHEMA)
            n = -(-n // FAN)
        return parts, n, step

    def sum_blocks(self, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, int]) -> MatrixFrame:
        """The sum of ``fn(ids, x)``, of ``shape``, over all blocks: summed in each task, then a few tasks at a time."""
        parts, _, step = self._partial_sums(fn, shape)

        def rows(table: pa.Table) -> pa.Table:
            total, first = sum_of(table), table.column("panel")[0].as_py() * step
            total = total.reshape(-1, shape[1])
            return pa.Table.from_batches([batch_of(np.arange(first, first + len(total)), total)])

        return MatrixFrame(parts.groupBy("panel").applyInArrow(rows, ROW_SCHEMA), *shape)

    def sum_local(self, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """``sum_blocks`` on the driver, 0 without rows. Where few tasks' sums fit there, they come without a shuffle."""
        parts, n, step = self._partial_sums(fn, shape)
        if 8 * shape[0] * shape[1] * n > LOCAL_BYTES:
            parts = parts.groupBy("panel").applyInArrow(merged_panels, PANEL_SCHEMA)
        total = np.zeros(shape)
        got = parts.toArrow()
        order = np.argsort(got.column("part").to_numpy(), kind="stable")  # so that reruns add up in one order
        panels, data = got.column("panel").to_numpy(), got.column("data")
        for i in order:
            s = panels[i] * step
            part = data[int(i)].values.to_numpy().reshape(-1, shape[1])
            total[s : s + len(part)] += part
        return total

    # -- algebra; the expression layer chooses how

    def __matmul__(self, other):
        from .plans.expr import Leaf

        return Leaf(self) @ other

    @property
    def T(self):  # noqa: N802
        from .plans.expr import Leaf

        return Leaf(self).T

    def __repr__(self) -> str:
        return f"MatrixFrame({self._dims[0]} x {self._dims[1]})" if self._dims else "MatrixFrame(dimensions not counted)"
