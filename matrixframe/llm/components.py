"""Connected components of a distributed graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


#: Nodes with more than this share of all edge ends take another way; there are at most as many as its inverse.
HUB_SHARE = 1 / 1000
LEAST_HUB = 64


def _beside_least(edges: DataFrame, ends: int) -> DataFrame:
    """``a, b`` and ``m``, the least b of each a. Hubs, of which there is a bounded number, are broadcast."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree"))
    limit = max(LEAST_HUB, int(ends * HUB_SHARE))
    hubs = least.where(F.col("degree") > limit).select("a", F.col("m").alias("hub"))
    tagged = edges.join(F.broadcast(hubs), "a", "left")  # at most 1 / HUB_SHARE rows
    rest = least.where(F.col("degree") <= limit).select("a", "m")
    return tagged.where("hub is not null").select("a", "b", F.col("hub").alias("m")).unionByName(
        tagged.where("hub is null").join(rest, "a").select("a", "b", "m")
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``(a, b)`` of longs; the root is the least node reachable.

    A large star hangs the larger neighbours of each node under its least neighbour, a small star the
    others; stars alternate until nothing changes, a few rounds for any graph. Edges stay distributed,
    as many as at the start at most, and each step is written to the shared checkpoint folder. Loops are ignored.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        new = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state or not new[0]:
            out = e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
            out.written_to = e.written_to  # for ``removed``, once nothing reads it any more
            return out
        state = new
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _beside_least(both, 2 * new[0]).where("b > a")
        hung = written(large.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        small = _beside_least(hung, new[0])
        moved = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
        last, e = e, written(small.select(moved.alias("a"), F.col("m").alias("b")).distinct())
        removed(hung)
        removed(last)
