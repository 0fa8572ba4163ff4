"""A training corpus from ``documents``: language ID, near-duplicates, secrets, source mixing, packing.

Stages take nulls in any column, empty and very long texts, equal ids, repeated rows, empty tables and further
columns, which none of them reads; each says what becomes of such rows. All but the last give ``COLUMNS``.
Those that run Python leave the session with ``small_batches``; results don't depend on it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixframe.llm import jaccard, langid, mixing, packing, secrets
from matrixframe.llm.common import delete, shared_folder, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells; those that it rejects go.

    Null texts, empty ones and those without a letter have no language and go. A null ``lang`` only means that
    the model learns nothing from the row. Repeated rows and rows without an id are told one by one; very long
    texts are read whole. Without any labelled row no language is known and nothing is left.
    """
    small_batches(spark)
    return langid.identify(docs.select(*COLUMNS), langid.train(docs)).where("accepted").select(*COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document: that with the least id, or if none has an id, one by hash.

    Documents without words are in no group and stay. Of rows equal in id and text one stays.
    """
    small_batches(spark)
    return jaccard.distinct_documents(docs.select(*COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each secret in its text replaced by the name of its kind, and ``n_chars`` counted anew.

    Null texts stay null and texts without secrets as they are, their ``n_chars`` too, also a null one.
    Repeated rows stay repeated.
    """
    small_batches(spark)
    found = secrets.find_secrets(docs.select(*COLUMNS), secrets.train(docs))
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col("secrets")))
    return clean.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, three times at most, each a row of its own.

    Null sources are one source. Texts without words count nothing and are repeated as their source is.
    """
    return mixing.sample(docs.select(*COLUMNS))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2,048 tokens. Repeats are packed each by itself;
    a null or empty text is the lone separator; only texts of over 2,047 tokens are cut."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", distinct_documents),
    ("secret scans", without_secrets),
    ("mixing sources", mixed_sources),
    ("best-fit packing", packed_sequences),
]

#: Models and searches that SQL can't express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's result is written to the shared checkpoint folder, from where
    the next reads it, and deleted when that one's is written; only what the last stage reads stays.

    An empty table gives no rows.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                delete(spark, f"{folder}/{k - 1}")
    return docs
