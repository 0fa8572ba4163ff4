"""The registered queries of the corpus operators, over their whole tables, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, hostrules, jaccard, langid, mixing, ordermin, packing, quality, secrets, toxicity
from .common import held_out, table


def op1_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op2_chat_format(spark, sf_dir):
    control = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(control).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_chats(turns)
    read, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    done = done.select("conv_id", "formatted", read.alias("turns"), loss.alias("loss"))
    as_lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(as_lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_host_rules(spark, sf_dir):
    found = hostrules.judge(table(spark, sf_dir, "documents")).drop("source")
    return found.withColumns({c: F.round(c, 9) for c in ("host_rate", "host_low")})


def op7_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs.select("doc_id", "text"), secrets.train(docs)).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(number, ("assign", "access", "hex")),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


def op8_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op9_order_minhash(spark, sf_dir):
    return ordermin.compare_with_next(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    found = quality.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {
    "op1_langid": op1_langid,
    "op2_chat_format": op2_chat_format,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_host_rules": op6_host_rules,
    "op7_secrets": op7_secrets,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_order_minhash": op9_order_minhash,
    "op10_quality": op10_quality,
}
ORACLES = {"op2_chat_format": chat.SQL, "op3_mixing": mixing.SQL, "op6_host_rules": hostrules.SQL, "op8_jaccard_join": jaccard.SQL}
