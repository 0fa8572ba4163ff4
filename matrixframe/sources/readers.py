"""libsvm, CSV, Parquet, HDF5 and .npy sources, and the Parquet and text sinks."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..frame import MatrixFrame, batch_of

#: Bytes that a task reads of an array file at most.
TASK_BYTES = 128 << 20


def read_libsvm(spark: SparkSession, path: str, n_features: int | None = None) -> DataFrame:
    """``label INT, features ARRAY<DOUBLE>``; the width is found by a scan unless given."""
    reader = spark.read.format("libsvm")
    if n_features:
        reader = reader.option("numFeatures", n_features)
    return reader.load(path).select(F.col("label").cast("int").alias("label"), vector_to_array("features").alias("features"))


def parse_libsvm_line(line: Column, n_features: int) -> Column:
    """``(label, features)`` of a line of label and index:value pairs, whose indices count from 0."""
    parts = F.split(F.trim(line), r"\s+")
    pairs = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p != "")
    cells = F.map_from_entries(
        F.transform(pairs, lambda p: F.struct(F.split(p, ":")[0].cast("int").alias("k"), F.split(p, ":")[1].cast("double").alias("v")))
    )
    dense = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda j: F.coalesce(F.element_at(cells, j), F.lit(0.0)))
    return F.struct(parts[0].cast("double").cast("int").alias("label"), dense.alias("features"))


def read_csv(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """Headerless CSV of a label that counts from 1, then features: ``label`` from 0, ``features``."""
    schema = ", ".join(["label double", *(f"f{i} double" for i in range(n_features))])
    df = spark.read.csv(path, schema=schema, mode="FAILFAST")
    return df.select((F.col("label").cast("int") - 1).alias("label"), F.array(*[f"f{i}" for i in range(n_features)]).alias("features"))


def read_parquet(spark: SparkSession, path: str, row_id: str = "index", features: str = "vector", check: bool = True) -> MatrixFrame:
    """Rows of an id and an array or MLlib vector."""
    return MatrixFrame.from_df(spark.read.parquet(path), row_id, features, check)


def write_parquet(a: MatrixFrame, path: str, row_id: str = "index", features: str = "vector", mode: str = "error") -> None:
    a.df.select(F.col("row_id").alias(row_id), F.col("features").alias(features)).write.mode(mode).parquet(path)


def write_label_pairs(df: DataFrame, path: str, true: str = "label", predicted: str = "cluster", mode: str = "error") -> None:
    """A text file of "true predicted" a row."""
    df.select(F.concat_ws(" ", F.col(true).cast("string"), F.col(predicted).cast("string")).alias("value")).write.mode(mode).text(path)


def repartitioned(df: DataFrame, n: int, shuffle: bool = True) -> DataFrame:
    return df.repartition(n) if shuffle else df.coalesce(n)


class _Rows(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class _ArrayReader(DataSourceReader):
    """Row ranges of a rank-2 array of doubles, in file order, a range a task."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))

    def shape(self) -> tuple[int, int]:
        raise NotImplementedError

    def rows(self, start: int, end: int) -> np.ndarray:
        raise NotImplementedError

    def partitions(self):
        n, m = self.shape()
        step = max(1, self.task_bytes // max(1, 8 * m))
        return [_Rows(s, min(n, s + step)) for s in range(0, n, step)] or [_Rows(0, 0)]

    def read(self, partition):
        m = self.shape()[1]
        step = max(1, (16 << 20) // max(1, 8 * m))
        for s in range(partition.start, partition.end, step):
            e = min(partition.end, s + step)
            yield batch_of(np.arange(s, e), self.rows(s, e))


class _NpyReader(_ArrayReader):
    def shape(self):
        a = np.load(self.path, mmap_mode="r")
        if a.ndim != 2:
            raise ValueError(f"{self.path} has rank {a.ndim}; a matrix is needed")
        return a.shape

    def rows(self, start, end):
        return np.load(self.path, mmap_mode="r")[start:end]


class _Hdf5Reader(_ArrayReader):
    def __init__(self, options):
        super().__init__(options)
        self.dataset = options.get("dataset", "rows")

    def _open(self):
        try:
            import h5py
        except ImportError as e:
            raise RuntimeError("reading HDF5 needs the package h5py on the driver and the executors") from e
        return h5py.File(self.path, "r")

    def shape(self):
        with self._open() as f:
            if len(f[self.dataset].shape) != 2:
                raise ValueError(f"{self.dataset} has rank {len(f[self.dataset].shape)}; a matrix is needed")
            return f[self.dataset].shape

    def rows(self, start, end):
        with self._open() as f:
            return f[self.dataset][start:end]


class NpyDataSource(DataSource):
    """``format("npy")``: a .npy file that all executors can open."""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return "row_id long, features array<double>"

    def reader(self, schema):
        return _NpyReader(self.options)


class Hdf5DataSource(NpyDataSource):
    """``format("hdf5")``: option ``dataset`` names a rank-2 dataset of a file that all executors can open."""

    @classmethod
    def name(cls):
        return "hdf5"

    def reader(self, schema):
        return _Hdf5Reader(self.options)


def read_npy(spark: SparkSession, path: str, column_replicas: int = 1, **options) -> MatrixFrame:
    return _read_array(spark, NpyDataSource, path, column_replicas, options)


def read_hdf5(spark: SparkSession, path: str, dataset: str, column_replicas: int = 1, **options) -> MatrixFrame:
    """A rank-2 dataset, its columns repeated ``column_replicas`` times."""
    return _read_array(spark, Hdf5DataSource, path, column_replicas, options | {"dataset": dataset})


def _read_array(spark, source, path, replicas, options) -> MatrixFrame:
    from ..operators.linalg import replicate_columns

    spark.dataSource.register(source)
    a = MatrixFrame(spark.read.format(source.name()).options(**options).load(path))
    return replicate_columns(a, replicas) if replicas > 1 else a
