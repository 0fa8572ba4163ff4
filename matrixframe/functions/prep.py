"""Getting data into matrices: row numbers, targets, scaling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import checkpointed


def index_rows(df: DataFrame, order: list, row_id: str = "row_id") -> DataFrame:
    """``df`` with numbers from 0 in the given order.

    Rows are cut into ranges of the order, counted, and numbered within their range from where it starts,
    so no task sees all rows. Rows that the order doesn't tell apart come in any order.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = checkpointed(ranged.withColumn("_own", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row a range
    return ranged.join(F.broadcast(starts), "_part").withColumn(row_id, F.col("_start") + F.col("_own")).drop("_part", "_own", "_n", "_start")


def permute_rows(df: DataFrame, seed: int, row_id: str = "row_id", by: list | None = None) -> DataFrame:
    """Random row numbers from 0: the order of a seeded hash of the columns ``by`` (all, unless given)."""
    by = by or df.columns
    return index_rows(df, [F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in by]), *by], row_id)


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda j: F.when(j == label, 1.0).otherwise(0.0))


def signed_targets(label: Column, classes: int) -> Column:
    """One-against-all targets, 1 for the class and −1 for the others."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda j: F.when(j == label, 1.0).otherwise(-1.0))


def argmax(features: Column) -> Column:
    """Position of the largest value, from 0; the first wins."""
    return (F.array_position(features, F.array_max(features)) - 1).cast("long")


def max_abs(df: DataFrame, features: str = "features") -> DataFrame:
    """``col_id, max_abs`` a column."""
    cells = df.select(F.posexplode(features).alias("col_id", "value"))
    return cells.groupBy("col_id").agg(F.max(F.abs("value")).alias("max_abs")).select(F.col("col_id").cast("long").alias("col_id"), "max_abs")


def max_abs_normalize(df: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """The label less its mean, and each feature over its column's largest magnitude (0 where that is 0)."""
    scales = [r[1] for r in sorted(max_abs(df, features).collect())]  # a row a column
    mean = df.agg(F.avg(label)).first()[0]
    scale = F.lit(np.array(scales, dtype=float))  # one literal, however many columns
    scaled = F.zip_with(features, scale, lambda x, s: F.coalesce(F.try_divide(x, s), F.lit(0.0)))
    return df.withColumns({label: F.col(label) - F.lit(mean), features: scaled})


def split_labelled(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``row_id, label, features`` as features and targets by row."""
    return df.select("row_id", "features"), df.select("row_id", "label")
