"""Scores of whole tables against plain Python that goes word by word, without caches, arrays of texts or batches."""

import hashlib
import math
import os
import re
import zlib

import pytest

from matrixframe.llm import langid, learning, quality, queries, secrets, toxicity
from tests.oracle import DATA, views

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="the shared tables aren't here")
held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
    return read("documents"), read("labels")


@pytest.fixture(scope="module")
def texts(tables):
    return {r["doc_id"]: r["text"] for r in tables[0].collect()}


def subwords(word):
    """Buckets of the 2- to 4-grams of one word between its marks."""
    b = b"<" + word.encode() + b">"
    for n in langid.ORDERS:
        for i in range(len(b) - n + 1):
            h = n * 0x9E3779B1 & 0xFFFFFFFF
            for c in b[i : i + n]:
                h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
                h ^= h >> 15
            yield h % langid.BUCKETS


def test_languages_equal_a_plain_mean_of_subwords(spark, tables, texts):
    model = langid.train(tables[0])
    rows = model.log_odds.tolist()
    got = {r["doc_id"]: r for r in queries.op1_langid(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    memo = {}
    for i, text in texts.items():
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        n, total = 0, [0.0] * len(model.languages)
        for w in words:
            if w not in memo:
                at = list(subwords(w))
                memo[w] = len(at), [sum(rows[k][c] for k in at) for c in range(len(total))]
            n += memo[w][0]
            total = [a + b for a, b in zip(total, memo[w][1], strict=True)]
        assert got[i]["held_out"] == held(i)
        if not words:
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["accepted"]) == ("und", 0.0, False)
            continue
        z = [(t / n + b) * model.scale for t, b in zip(total, model.bias.tolist(), strict=True)]
        p = [math.exp(v - max(z)) for v in z]
        score = max(p) / sum(p)
        assert got[i]["lang_pred"] == model.languages[z.index(max(z))]
        assert got[i]["score"] == pytest.approx(score, abs=1e-9)


def single(chunk):
    core = chunk.strip(toxicity._EDGE)
    return len(core) == 1 and (core.isalpha() or core in toxicity.LEET)


def test_toxicity_equals_evidence_word_by_word(spark, tables, texts):
    model = toxicity.train(*tables)
    a, b, c = model.coefficients
    memo = {}

    def most(words):
        found = [model.evidence.get(f, 0.0) for w in words if len(w) > 2 for f in (w + "$", *(w[:n] for n in toxicity.PREFIXES if len(w) >= n))]
        return max(found, default=0.0)

    got = {r["doc_id"]: r for r in queries.op5_toxicity(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        values, run = [], []
        for chunk in [*(text or "").split(), ""]:
            if chunk and chunk not in memo:
                memo[chunk] = most(toxicity.restore(chunk, model.lm))
            if chunk:
                values.append(memo[chunk])
            if chunk and single(chunk):
                run.append(chunk.strip(toxicity._EDGE).lower())
                continue
            if len(run) > 2 and len(set(run)) > 1:
                values.append(most(toxicity.spaced_words("".join(run), model.lm)))
            run = []
        top = sorted((v for v in values if v > 0), reverse=True)[:3]
        want = 1 / (1 + math.exp(-(a * (top[0] if top else 0.0) + b * sum(top) + c)))
        assert got[i]["score"] == pytest.approx(want, abs=1e-9)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3) and got[i]["held_out"] == held(i)


def plain_indicators(text):
    b = text.encode()
    seen = {b[i] << 8 | b[i + 1] for i in range(len(b) - 1)}
    words = text.split()
    codes = []
    for i, w in enumerate(words):
        again = w in words[max(0, i - 2) : i]
        codes.append(quality.shape(w) * 2 + again + 1)
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            h = n
            for s in codes[i : i + n]:
                h = (h * 0x2545F491 + s) & 0x7FFFFFFF
                h ^= h >> 13
            seen.add(quality.BYTES + h % quality.SHAPES)
    return seen


def test_quality_equals_a_plain_sum_of_weights(spark, tables, texts):
    model = quality.train(*tables)
    weights = model.weights.tolist()
    got = {r["doc_id"]: r for r in queries.op10_quality(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        seen = plain_indicators(text or "")
        margin = sum(weights[k] for k in seen) / math.sqrt(max(1, len(seen))) + model.bias
        want = learning.sigmoid(margin * model.slope + model.offset)
        assert got[i]["score"] == pytest.approx(want, abs=1e-9)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.7) and got[i]["held_out"] == held(i)


def test_exact_columns_of_fingerprints_equal_sql(spark):
    want = views().sql("""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS other FROM d)
        SELECT doc_id, length(text), sha256(left(text, length(text) - length(text) // 2) || left(other, length(text) // 2)) FROM n ORDER BY doc_id
    """).fetchall()
    got = queries.op9_order_minhash(spark, DATA).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got] == want


def test_counts_of_base_secrets_equal_sql(spark):
    """The patterns as RE2 has them, counted and without places."""
    count = lambda p, n: f"len(list_filter(regexp_extract_all(t, '{p}'), lambda x: length(x) >= {n}))"
    value = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    want = views().sql(f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, len(list_filter(regexp_extract_all(t, '{value}', 1), lambda x: length(x) >= 12)), {count("AKIA[A-Z0-9]+", 18)}, {count("[0-9a-f]+", 16)}
        FROM d ORDER BY doc_id
    """).fetchall()
    got = queries.op7_secrets(spark, DATA).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"]) for r in got] == want
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got if not sum((r["n_assign"], r["n_access"], r["n_hex"])))
    assert secrets.digest([]) == ""
