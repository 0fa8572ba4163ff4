"""Chat formatting, source mixing and host rules: against DuckDB on the shared tables and by brute force."""

import hashlib
import os
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matrixframe.llm import chat, hostrules, mixing, queries
from tests.llm.conftest import as_set
from tests.oracle import DATA, assert_same

here = pytest.mark.skipif(not os.path.exists(DATA), reason="the shared tables aren't here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@here
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLES[name])


# -- chat


def formatted(spark, turns):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    done = chat.format_chats(df.repartition(3))
    return done.select("conv_id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()


pieces = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "a", "\n", "é", "\U0001f600", "<\\s>"]), max_size=6).map("".join)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(turns=st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "[INST]"]), pieces), min_size=1, max_size=6))
def test_chats_read_back(spark, turns):
    (r,) = formatted(spark, [(1, i, *t) for i, t in enumerate(turns)])
    assert [(t["role"], t["text"]) for t in r["turns"]] == turns
    own = [t for role, t in turns if role == "assistant"]
    assert r["loss"] == "".join(own) and len(r["loss_spans"]) == len(own)


def test_adjacent_turns_merge_and_blanks_count_as_empty(spark):
    (r,) = formatted(spark, [(1, 2, "user", None), (1, 1, "user", "a"), (1, 3, None, "b"), (1, None, "assistant", "first")])
    assert r["formatted"] == "[INST]assistant[/INST]first</s>[INST]user[/INST]a<s></s>[INST][/INST]b</s>"
    assert [(t["role"], t["text"]) for t in r["turns"]] == [("assistant", "first"), ("user", "a"), ("user", ""), ("", "b")]


def test_chats_with_ties_repeats_long_texts_and_none(spark):
    long = "w " * 200_000
    got = {r["conv_id"]: r for r in formatted(spark, [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "assistant", long)])}
    assert [t["text"] for t in got[1]["turns"]] == ["a", "a", "b"]
    assert got[None]["loss"] == long
    assert formatted(spark, []) == []


def test_chat_ignores_other_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", "y", 3)], "conv_id long, turn long, role string, text string, formatted string, turns int")
    assert chat.format_chats(df).columns == ["conv_id", "formatted", "loss_spans"]


def test_native_plans_hold_no_python(spark, docs):
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    for df in (chat.format_chats(turns), hostrules.judge(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# -- mixing


def water_filled(sizes, weights=(1, 2, 3), most=3):
    """The rule as it is told: clamp, reshare what is left by weight, again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in above}


def test_targets_are_those_of_repeated_clamping(spark, docs, rows):
    got = mixing.mix(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = water_filled(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) or r["doc_id"] == 15  # an id of two sources
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["times"] * r["size"]


def test_mix_keeps_rows_and_comes_near_targets(spark):
    texts = ["w " * (1 + i % 17) for i in range(600)]
    df = spark.createDataFrame([(i, t, None, "abc"[i % 10 // 4], 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    a, b = as_set(mixing.mix(df)), as_set(mixing.mix(df.repartition(7)))
    assert a == b and len(a) == 600
    own = df.select("doc_id", "source")
    for r in mixing.mix(df).join(own, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 17 / 2
    drawn = mixing.sample(df)
    many = pytest.MonkeyPatch()
    many.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert as_set(mixing.sample(df)) == as_set(drawn)
    many.undo()
    assert drawn.columns == df.columns
    counts = {r["doc_id"]: r["count"] for r in drawn.groupBy("doc_id").count().collect()}
    assert {r[0]: r[5] for r in a if r[5]} == counts


@pytest.mark.parametrize("most", [1, 50_000])
def test_sample_equals_mix_on_repeated_and_missing_ids(spark, monkeypatch, most):
    """Copies at the cut, with and without an id, and copies that differ in another column."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
    rows = [(None, "a b c", "en", "x", i % 2) for i in range(200)] + [(7, "d e", "fr", "x", i % 3) for i in range(90)]
    rows += [(None, f"w{i} " * (1 + i % 5), "en", "x", 0) for i in range(150)] + [(i, "many words here " * 30, "en", "y", 0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    mixed = mixing.mix(df).collect()
    drawn = mixing.sample(df).collect()
    assert len(mixed) == len(rows)
    taken = sum(r["taken"] for r in mixed)
    assert sum(len(r["text"].split()) for r in drawn) == taken
    by_text = Counter(r["text"] for r in drawn)
    assert max(n / sum(t == r[1] for r in rows) for t, n in by_text.items()) <= 3
    for s in "xy":
        target = next(r["target"] for r in mixed if r["source_size"] == sum(len(t.split()) for _, t, _, o, _ in rows if o == s))
        assert abs(sum(len(r["text"].split()) for r in drawn if r["source"] == s) - target) <= 45
    assert Counter(map(tuple, drawn)) == Counter(map(tuple, mixing.sample(df.repartition(2)).collect()))


def test_ranks_of_many_sources(spark):
    names = [None, *sorted((f"s{i}" for i in range(300)), key=str.encode), "\U0001f600", "\uffff"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "source string, source_size long").repartition(4)
    got = {r["source"]: r["r"] for r in mixing.ranked_sources(df).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names, key=lambda n: (n is None, (n or "").encode())))}
    sizes = {n: (i * 37) % 101 for i, n in enumerate(names)}
    levels = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    want = water_filled(sizes)
    assert {r["source"]: r["target"] for r in levels.collect()} == pytest.approx(want)


def test_mix_handles_odd_tables(docs, rows, empty, clashing):
    assert mixing.mix(empty).count() == 0 and mixing.sample(empty).count() == 0
    assert mixing.mix(docs).count() == len(rows)
    assert as_set(mixing.mix(clashing)) == as_set(mixing.mix(docs))
    assert mixing.sample(clashing).columns == clashing.columns


def test_mix_of_empty_texts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert {(r["target"], r["taken"]) for r in mixing.mix(df).collect()} == {(0.0, 0)}


# -- host rules


def base(text):
    words = WORD.findall(text or "")
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def test_base_measures(spark):
    texts = ["a b c d e f g h i " * 3, "x " * 9, "x " * 8, "p\np\n \np #*$", None, "", "a b c d e f g h z a b c d e f g h", "q " * 5000]
    texts.append(" ".join(map(str, range(50))) + "\n" + " ".join(map(str, range(20, 40))))
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, source string, n int")
    for r in hostrules.judge(df).collect():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base(texts[r["doc_id"]])


def test_bad_hosts_go_whole_and_small_ones_are_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good, "good") for i in range(200)] + [(1000 + i, "short", "bad") for i in range(195)] + [(1195 + i, good, "bad") for i in range(5)]
    rows += [(2000, "short", "tiny"), (2001, good, "tiny"), (2002, good, None)]
    got = {r["doc_id"]: r for r in hostrules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i]["kept"] for i in range(200)) and got[2002]["kept"]
    assert not any(got[1000 + i]["kept"] for i in range(200))
    assert 0.4 < got[2001]["host_rate"] < 0.5 and not got[2000]["kept"]
    # half of the small host fails as well, but too little is known of it to refuse what passes there
    assert got[2001]["kept"] and got[2001]["host_low"] < got[1000]["host_low"] < got[1000]["host_rate"]


def test_hosts_of_the_corpus_rate_stay_at_any_size(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, "short" if i % 4 == 0 else good, f"h{i % 37 // 12}") for i in range(2000)]
    got = hostrules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r["doc_id"] for r in got.where("kept").collect()} == {i for i, t, _ in rows if t == good}


def test_host_rules_handle_odd_tables(docs, rows, empty, clashing):
    assert hostrules.judge(empty).count() == 0
    assert as_set(hostrules.judge(clashing)) == as_set(hostrules.judge(docs))
    for r in hostrules.judge(docs).collect():
        assert not (r["base_failed"] and r["kept"])
    assert hostrules.judge(docs).count() == len(rows)


def test_chat_query_adds_the_control_conversation(spark):
    if not os.path.exists(DATA):
        pytest.skip("the shared tables aren't here")
    r = queries.op2_chat_format(spark, DATA).where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["n_turns"] == 2
