"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, count_words

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 17
#: Sources whose rows (some 200 bytes each) may be broadcast, and salts of a source beyond that.
BROADCAST_SOURCES = 50_000
SALTS = 32


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``r``, the rank of each source by code point, null last, from 0.

    Sources are sorted by ranges and each range is numbered by itself; the driver only counts the ranges.
    """
    ranged = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ranged = checkpointed(ranged)
    counts = sorted(map(tuple, ranged.groupBy("range").count().collect()))
    before, at = {}, 0
    for part, n in counts:
        before[part], at = at, at + n
    if not before:
        return ranged.drop("range").withColumn("r", F.lit(0).cast("long"))
    first = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]), F.col("range").cast("long"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.withColumn("r", own + first).drop("range")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Water-filled targets of sources ``(source, source_size)`` that share the sum of all sizes.

    Sources rank by code point, null last, and take the weights in turn. A source never gets more than
    ``max_epochs`` times its size. The level is what a unit of weight gets: sources that would get more
    than their cap are clamped to it, and the rest is shared anew by the others, until none is above. A
    round is one sum over the sources, which stay distributed, and as levels only rise, a source once
    clamped stays so. Empty sources have target 0; with a zero or no total so has every source.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("r") % len(weights) + 1).cast("int")).cast("long")
    ranked = checkpointed(
        ranked_sources(sizes).select("source", "source_size", weight.alias("w"), (F.col("source_size") * max_epochs).alias("cap"))
    )
    ratio = F.col("cap") / F.col("w")
    level, clamped = 0.0, -1
    while True:
        above = ratio < F.lit(level)
        found = ranked.agg(
            F.sum("source_size").alias("total"), F.count(F.when(above, 1)).alias("clamped"),
            F.sum(F.when(above, F.col("cap"))).alias("given"), F.sum(F.when(~above, F.col("w"))).alias("open"),
        ).first()
        if not found["open"] or found["clamped"] == clamped:
            break
        clamped, level = found["clamped"], float(found["total"] - (found["given"] or 0)) / found["open"]
    return ranked.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """How many words of each document a mix takes: ``doc_id, size, source_size, target, taken, times``.

    A source is repeated ``floor(target / size)`` times whole; of the fraction that is left, documents
    are taken in the order of a seeded hash until the next would overshoot by more than half of itself.
    So a source's taken words differ from its target by at most half of one document, no document is
    taken more than ``max_epochs`` times, and reruns agree.

    The order is cut into 4,096 hash buckets a source. A running sum needs only one bucket in one
    task, and the sums of buckets stand for all before it, so a hot source is spread over all tasks. Rows
    equal in id, source and text are one entry of the order with a count, whose copies are taken one
    after the other, so a hot group of them is no hot bucket.

    Null text has size 0; null sources form one source, ranked last; rows without an id are ordered by
    their text alone; repeated rows count once each; very long texts count whole; an empty table gives no
    rows. Other columns are ignored.
    """
    placed = _placed(docs, weights, max_epochs, seed)
    each = placed.repartition("key", "part").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    times = F.col("whole") + (F.col("copy") <= F.col("more")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def _key(seed: int):
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text))


def _placed(docs: DataFrame, weights, max_epochs: int, seed: int) -> DataFrame:
    """Entries of the seeded order, one for the equal rows of a ``part`` of the input: how many ``copies`` there
    are, their source's plan, and how many of them are taken once ``more`` than the source's ``whole`` repeats."""
    thin = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), _key(seed).alias("key"), F.spark_partition_id().alias("part"))
    thin = thin.groupBy("source", "key", "doc_id", "size", "part").agg(F.count(F.lit(1)).alias("copies"))
    thin = checkpointed(thin.withColumn("bucket", F.substring("key", 1, 3)))
    buckets = checkpointed(thin.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("bucket_size")))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("start"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")))).otherwise(0)
    t, s = targets.alias("t"), starts.alias("s")
    plan = s.join(t, F.expr("t.source <=> s.source")).select(
        F.col("s.source").alias("p_source"), F.col("s.bucket").alias("p_bucket"), "start", "source_size", "target", whole.cast("long").alias("whole")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = thin.select("*", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)).alias("inside"))
    joined = placed.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket")))
    left = F.col("target") - F.col("whole") * F.col("source_size") - F.col("start") - F.col("inside")
    # the copy after k others is taken if the words before it and half of its own are within what is left
    fits = F.when(F.col("size") > 0, F.floor(left / F.nullif("size", F.lit(0)) + 0.5)).otherwise(F.when(left >= 0, F.col("copies")).otherwise(0))
    more = F.when(F.col("whole") < max_epochs, F.least(F.col("copies"), F.greatest(F.lit(0).cast("long"), fits.cast("long")))).otherwise(0)
    return joined.withColumn("more", more.cast("long"))


def sample(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as many times as ``mix`` takes it.

    Within a source the documents that are taken once more are the first in its seeded order, so a row a
    source decides: the last entry of them, and how many of that entry's equal rows are taken. Up to
    ``BROADCAST_SOURCES`` such rows go to all tasks and texts aren't shuffled; more are joined over 32
    salts a source, with the same result. Of the rows at the cut itself, which are equal in id, source and
    text, those that are equal in all columns are counted, and the counts ordered by the columns' hash.
    Columns stay as they are; nulls, repeated rows and empty tables are as for ``mix``.
    """
    entries = _placed(docs, weights, max_epochs, seed).groupBy("source", "key", "doc_id", "size").agg(
        F.first("whole").alias("whole"), F.sum("more").alias("more"), F.sum("copies").alias("copies")
    )
    last = F.max(F.when(F.col("more") > 0, F.struct(F.struct("key", "doc_id", "size").alias("at"), "more", "copies")))
    ends = checkpointed(entries.groupBy("source").agg(F.first("whole").alias("whole"), last.alias("last")).withColumnRenamed("source", "of"))
    at = F.struct(_key(seed).alias("key"), F.col("doc_id").alias("doc_id"), count_words(F.col("text")).alias("size"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col("source").alias("from"), at.alias("at"), F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(SALTS)).alias("own"))
    same = F.col("from").eqNullSafe(F.col("of"))
    if ends.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(ends), same)
    else:
        salted = ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(salted, same & (F.col("own") == F.col("salt")))
    joined = joined.withColumn("tied", F.coalesce((F.col("at") == F.col("last.at")) & (F.col("last.more") < F.col("last.copies")), F.lit(False)))
    once = F.coalesce((F.col("at") <= F.col("last.at")).cast("long"), F.lit(0))
    clear = joined.where("not tied").select("row", (F.col("whole") + once).alias("n"))
    tied = joined.where("tied").select("*", F.spark_partition_id().alias("part")).groupBy("from", "row", "part").agg(
        F.count(F.lit(1)).alias("m"), F.first("whole").alias("whole"), F.first("last.more").alias("more")
    )
    before = Window.partitionBy("from").orderBy(F.xxhash64("row"), "row", "part").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0).cast("long"), F.col("more") - F.coalesce(F.sum("m").over(before), F.lit(0)))
    shared = tied.select("row", (F.col("whole") * F.col("m") + F.least("m", left)).alias("n"), "part").repartition("part").select("row", "n")
    every = clear.unionByName(shared).where("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    return every.select("row.*")


def _sql(weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    case = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return rf"""
WITH thin AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM thin GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM sizes),
weighed AS (SELECT *, CASE r % {len(weights)} {case} END AS w, source_size * {max_epochs} AS cap FROM ranked),
leveled AS (
  SELECT *, CAST(cap AS DOUBLE) / w AS ratio,
    row_number() OVER o AS k,
    CAST((sum(source_size) OVER ()) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM weighed WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, r)),
targets AS (
  SELECT source, source_size,
    least(CAST(cap AS DOUBLE), w * (SELECT level FROM leveled WHERE level <= ratio ORDER BY k LIMIT 1)) AS target
  FROM leveled),
split AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM thin)
SELECT doc_id, size, source_size, target, CAST(size * times AS BIGINT) AS taken, times FROM (
  SELECT p.doc_id, p.size, s.source_size, s.target, CAST(s.whole + CASE WHEN s.whole < {max_epochs}
    AND p.before + p.size / 2.0 <= s.target - s.whole * s.source_size THEN 1 ELSE 0 END AS BIGINT) AS times
  FROM placed p JOIN split s ON p.source IS NOT DISTINCT FROM s.source)
"""


SQL = _sql()
