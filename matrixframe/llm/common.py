"""What several corpus operators share: checkpoints, word splitting, salted keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters that are none of ASCII's white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows with this remainder are never learned from.
HELD_OUT = 2

#: Bytes of a batch that goes to Python; beyond them a batch ends with the row that passes them.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``. Where the session names none, a temporary one on a local
    master, as in tests, and an error on a cluster, whose machines would each write to their own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """Have the session cut what goes to Python by bytes too, at ``BATCH_BYTES`` or its own lower limit. By rows alone
    a batch is 10,000 texts, of which the executor and its Python worker hold copies in each task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    kept = spark.conf.get(name, None)
    if not (kept and kept.isdigit() and 0 < int(kept) <= BATCH_BYTES):
        spark.conf.set(name, BATCH_BYTES)


def written(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, as a table. For loops: a checkpoint keeps the size that the optimizer guessed,
    which joins square each round; a table has the size of its files."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def removed(df: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing reads it any more."""
    delete(df.sparkSession, df.written_to)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text: Column) -> Column:
    """Words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def remainder(doc_id: Column) -> Column:
    """crc32 of the id's decimal text modulo 4, which tells held-out rows; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id) == HELD_OUT


def without(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without columns of these names in any case."""
    return docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in names])


def extended(docs: DataFrame, **kinds: T.DataType) -> T.StructType:
    """The schema of ``docs`` and further columns behind it."""
    return T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in kinds.items())])
