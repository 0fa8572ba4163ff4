"""Quality rules judged by host: failures a host, shrunk to the corpus, decide on its documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, checkpointed, let, split_words

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
MAX_SYMBOLS_PERCENT = 10
MAX_DUP_LINES = 20
WINDOW_WORDS = 8
#: A host is refused when its shrunk failure rate, less so many posterior deviations, is still so far above the corpus's.
DOUBT, MARGIN = 2.0, 0.2
SALTS = 32


def repeated_words(words: Column, width: int = WINDOW_WORDS) -> Column:
    """Words in windows of ``width`` words (a power of two) that the text has twice or more.

    Windows go by 64-bit hashes of their words, made by doubling: of 1, 2, 4, then 8 words. Texts whose
    windows all differ are done then. Else windows are sorted by hash, and each start that has an equal
    beside it covers the words up to the next such start, at most ``width``.
    """

    def doubled(h: Column, by: int) -> Column:
        if by == width:
            return F.slice(h, 1, F.size(h) - (width - 1))
        return let(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + by))), lambda d: doubled(d, by * 2))

    def covered(h: Column) -> Column:
        return let(
            F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            lambda s: let(
                F.array_sort(
                    F.transform(
                        F.filter(
                            s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])
                        ),
                        lambda x: x["i"],
                    )
                ),
                lambda at: F.aggregate(
                    F.transform(at, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - x, F.lit(width)))),
                    F.lit(0),
                    lambda a, x: a + x,
                ),
            ),
        )

    return F.when(F.size(words) <= width, F.lit(0)).otherwise(
        let(
            F.transform(words, lambda w: F.xxhash64(w)),
            lambda h1: let(
                doubled(h1, 1),
                lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)),
            ),
        )
    ).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    found = docs.select(
        "doc_id",
        "source",
        let(
            split_words(F.col("text")),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_words(w).alias("n_repeat_words"),
            ),
        ).alias("m"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return found.select("doc_id", "source", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words")


def judge(docs: DataFrame, margin: float = MARGIN, doubt: float = DOUBT) -> DataFrame:
    """Measures of every document with ``base_failed``, its host's ``host_rate`` and ``host_low``, and ``kept``.

    Base rules fail a document by itself. For its host (``source``) it also counts as failed when
    symbols are over 10% of its word characters or more than 20 lines repeat earlier ones. A host with
    f failures in n documents has the rate (f + a) / (n + a + b), where the beta prior (a, b) has the
    mean and variance of hosts' rates over the whole corpus, by moments weighted by documents. With no
    spread beyond what chance gives the prior is as strong as the corpus; a corpus in which all or none
    fail gets a prior of two documents at that rate. ``host_low`` is this rate less ``doubt`` deviations of its
    posterior; a host is refused whole, its documents that pass by themselves too, if even that is more than
    ``margin`` above the corpus's rate. So a small host, of which little is known, is not refused for a few failures.

    Null and empty texts have no words and fail; null sources are one host; equal ids, null ids and repeated
    rows are judged and counted a row each; very long texts are measured whole, in one task; an empty table gives no rows. Other
    columns are ignored. Hosts' counts are summed before the shuffle, and the verdicts are joined back over 32 salts a host.
    """
    m = checkpointed(measure(docs))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    unruly = (100 * F.col("n_symbols") > MAX_SYMBOLS_PERCENT * F.col("word_chars")) | (F.col("n_dup_lines") > MAX_DUP_LINES)
    m = m.select("*", failed.alias("base_failed"), (failed | unruly).cast("long").alias("bad"))
    hosts = checkpointed(m.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("f")))
    p = F.col("f") / F.col("n")
    sums = hosts.agg(
        F.sum("n").alias("docs"), F.sum("f").alias("fails"), F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("n") * p * p).alias("squares"),
    )
    mean = F.col("fails") / F.col("docs")
    chance = mean * (1 - mean) * F.col("hosts") / F.col("docs")
    spread = F.greatest(F.col("squares") / F.col("docs") - mean * mean - chance, mean * (1 - mean) / (F.col("docs") + 1))
    strength = F.when(mean * (1 - mean) > 0, F.greatest(mean * (1 - mean) / spread - 1, F.lit(1e-6))).otherwise(2.0)
    prior = sums.where("docs > 0").select(F.lit(1).alias("one"), (mean * strength).alias("a"), strength.alias("ab"))
    rate = (F.col("f") + F.col("a")) / (F.col("n") + F.col("ab"))
    salted = (
        hosts.withColumn("one", F.lit(1)).join(F.broadcast(prior), "one")  # one row
        .select(F.col("source").alias("host"), rate.alias("host_rate"), (F.col("a") / F.col("ab")).alias("corpus_rate"), "n", "ab")
    )
    deviation = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("n") + F.col("ab") + 1))
    salted = salted.withColumn("host_low", F.col("host_rate") - doubt * deviation)
    salted = salted.withColumn("refused", F.col("host_low") > F.col("corpus_rate") + margin)
    salted = salted.select("host", "host_rate", "host_low", "refused", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own_salt = F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(SALTS)).cast("int")
    joined = m.withColumn("own_salt", own_salt).join(
        salted, F.col("source").eqNullSafe(F.col("host")) & (F.col("own_salt") == F.col("salt"))
    )
    return joined.select(
        "doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "host_rate", "host_low", (~F.col("base_failed") & ~F.col("refused")).alias("kept"),
    )


SQL = r"""
WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS w
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM split WHERE len(words) > 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM windows) WHERE c > 1),
reps AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS r
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
m AS (
  SELECT s.doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN reps USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
b AS (SELECT *, CAST(base_failed OR 100 * n_symbols > 10 * word_chars OR n_dup_lines > 20 AS BIGINT) AS bad FROM f),
hosts AS (SELECT source, count(*) AS n, sum(bad) AS f FROM b GROUP BY source),
sums AS (SELECT sum(n) AS docs, sum(f) / sum(n) AS mean, count(*) AS hosts, sum(n * (f / n) * (f / n)) AS squares FROM hosts),
prior AS (SELECT mean, CASE WHEN mean * (1 - mean) > 0 THEN greatest(mean * (1 - mean)
    / greatest(squares / docs - mean * mean - mean * (1 - mean) * hosts / docs, mean * (1 - mean) / (docs + 1)) - 1, 1e-6)
  ELSE 2 END AS s FROM sums),
rates AS (SELECT source, n, s, mean, (f + mean * s) / (n + s) AS rate FROM hosts, prior),
verdicts AS (SELECT source, mean, rate, rate - 2.0 * sqrt(rate * (1 - rate) / (n + s + 1)) AS low FROM rates)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND low <= mean + 0.2 AS kept, round(rate, 9) AS host_rate, round(low, 9) AS host_low
FROM b JOIN verdicts v ON b.source IS NOT DISTINCT FROM v.source
"""
