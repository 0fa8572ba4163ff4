"""The Jaccard join, order MinHash and components, against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from matrixframe.llm import components as components_
from matrixframe.llm import hashing, jaccard, ordermin
from matrixframe.llm.components import components
from tests.llm.conftest import as_set, prose


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Least id reachable, and size, by id, from all pairs of texts."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, (_, s)), (b, (_, t)) in itertools.combinations(enumerate(sets), 2):
        both = len(s & t)
        if both and 100 * both >= 75 * (len(s) + len(t) - both):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        known = [x for x in (least.get(r), i) if x is not None]
        least[r] = min(known) if known else None
    return sorted(((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)), key=repr)


def near(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k : k + rng.randrange(0, 2)] = [f"new{rng.randrange(9999)}"]
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = prose(rng, rng.choice([6, 30, 150, 700]))
        rows += [near(rng, base, rng.randrange(0, 12)) for _ in range(rng.randrange(1, 16))]
    shared = prose(rng, 45)
    rows += [f"{prose(rng, 8)} {shared} {prose(rng, rng.randrange(0, 30))}" for _ in range(40)]
    rng.shuffle(rows)
    return [(i * 2 + 1, t) for i, t in enumerate(rows)]


def found(df):
    return as_set(jaccard.near_duplicates(df))


def test_components_equal_brute_force(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    want = brute(corpus)
    assert found(df.repartition(5)) == want
    assert len({c for _, _, c in want}) < len(want)


def test_blocks_and_long_lists_lose_nothing(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "SHORT", 2)
    assert found(spark.createDataFrame(corpus, "doc_id long, text string")) == brute(corpus)


def test_odd_tables(docs, rows, empty, clashing):
    want = brute([(r[0], r[1]) for r in rows])
    assert found(docs) == want
    assert found(clashing) == want
    assert found(empty) == []


def test_documents_without_ids(spark):
    text = " ".join(map(str, range(40)))
    got = found(spark.createDataFrame([(None, text), (None, text + " x"), (9, text), (None, "alone")], "doc_id long, text string"))
    assert got == sorted([(None, 36, 9), (None, 37, 9), (9, 36, 9), (None, 1, None)], key=repr)


def test_streams_and_salts_of_long_lists_lose_nothing(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "SHORT", 2)
    monkeypatch.setattr(jaccard, "PIECE", 5)
    monkeypatch.setattr(jaccard, "HOT_LEVEL", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        rows = [(r[0] if r[0] % 3 else None, r[1]) for r in corpus]
        assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lists_in_pieces_have_all_their_members(monkeypatch):
    monkeypatch.setattr(jaccard, "PIECE", 4)
    import pyarrow as pa

    rows = sorted({(t, c) for t, m in ((1, 3), (2, 40), (3, 1), (4, 9)) for c in range(m)})
    rows = [r for r in rows for _ in range(3)]  # named by three tasks
    batches = [
        pa.record_batch([pa.array([r[0] for r in b]), pa.array([0] * len(b)), pa.array([r[1] for r in b]), pa.array([5] * len(b))], ["token", "salt", "cls", "n"])
        for b in (rows[s : s + 7] for s in range(0, len(rows), 7))
    ]
    seen, pieces = set(), []
    for (token, _, cls, _), began, goes_on in jaccard._whole_lists(batches):
        seen |= set(zip(token.tolist(), cls.tolist(), strict=True))
        pieces.append((token.tolist(), began, goes_on))
    assert seen == set(rows)
    for (a, _, goes_on), (b, began, _) in itertools.pairwise(pieces):
        assert goes_on == began == (a[-1] == b[0])


def test_one_row_of_each_component_is_kept(spark, corpus, docs, rows, empty, clashing):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    kept = {r["doc_id"] for r in jaccard.distinct_documents(df).collect()}
    assert kept == {i for i, _, c in brute(corpus) if i == c}
    without = spark.createDataFrame([(None, t, i) for i, t in corpus], "doc_id long, text string, other long")
    assert jaccard.distinct_documents(without).count() == len(kept)
    assert jaccard.distinct_documents(empty).count() == 0
    assert jaccard.distinct_documents(clashing).columns == clashing.columns


def test_rows_without_ids_are_no_hot_key(spark):
    """800 near copies without ids: no stage makes more rows of them than of as many with ids."""
    rng = random.Random(1)
    base = prose(rng, 60)
    texts = [near(rng, base, 2) for _ in range(800)]
    rows = [(None, t) for t in texts]
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert len(got) == 800 and {c for _, _, c in got} == {None}
    named = found(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert jaccard.distinct_documents(df).count() == len({c for _, _, c in named})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=40), min_size=2, max_size=12))
def test_tree_never_misses_a_link(raw):
    rng = np.random.default_rng(0)
    names = rng.integers(0, 1 << 63, 61, dtype=np.uint64)
    sets = [np.sort(names[sorted(s)]) for s in raw]
    vectors = [jaccard.count_vector(s) for s in sets]
    tree = jaccard.CountTree(vectors, np.array([len(s) for s in sets]))
    for s, v in zip(sets, vectors, strict=True):
        hit = set(tree.search(v, len(s)).tolist())
        for k, t in enumerate(sets):
            both = len(np.intersect1d(s, t))
            assert jaccard.overlap_bound(v, vectors[k]) >= both
            if 100 * both >= 75 * (len(s) + len(t) - both):
                assert k in hit


def test_tree_finds_links_among_sizes_of_different_groups():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    sets = [base, base[:240], base[:230]] + [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in rng.integers(200, 400, 60)]
    tree = jaccard.CountTree([jaccard.count_vector(s) for s in sets], np.array([len(s) for s in sets]))
    got = set(tree.search(jaccard.count_vector(base), len(base)).tolist())
    assert {0, 1, 2} <= got and len(got) < 10


@pytest.mark.parametrize("short, long", [(256, 300), (500, 530), (255, 1100)])
def test_a_short_set_meets_a_block_of_longer_ones(short, long):
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 63, long, dtype=np.uint64))
    sets = [base[:short]] + [np.unique(np.concatenate([base, rng.integers(0, 1 << 63, 4, dtype=np.uint64)])) for _ in range(40)]
    sizes, sides = np.array([len(s) for s in sets]), np.array([0] + [1] * 40)
    vectors = [jaccard.count_vector(s) for s in sets]
    assert len(vectors[0]) < min(map(len, vectors[1:]))
    joined = jaccard.forest_of(sides, sizes, vectors, sets, True).joined
    assert sorted(joined) == [(0, k) for k in range(1, 41) if 100 * short >= 75 * sizes[k]]


def test_blocks_of_different_widths_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    monkeypatch.setattr(jaccard, "SHORT", 2)
    rng = random.Random(8)
    w = prose(rng, 320, [f"w{i}" for i in range(500)]).split()
    rows = [(k, " ".join(w[: 320 - 8 * k] + [f"tail{k}"])) for k in range(12)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 100])
def test_first_shingles_of_linked_sets_meet(n):
    """The smaller set's first shingles reach its first common one, wherever the others are."""
    for m in range(n, int(n / 0.75) + 1):
        least = int(jaccard.least_overlap(n + m))
        if least <= n and 100 * least >= 75 * (n + m - least):
            assert n - least < jaccard.index_length(n) and m - least < jaccard.prefix_length(m)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400))
def test_prefixes_of_linked_sets_meet(n):
    p = jaccard.prefix_length(n)
    assert 1 <= p <= n and n - p + 1 == -(-3 * n // 4)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é\t\n\x0b\x0c\r\x00\x1cß "), max_size=60))
def test_word_hashes_follow_words(text):
    raw = text.encode()
    h = hashing.TextHasher().words(raw)
    words = raw.split()
    assert len(h) == len(words)
    for (a, x), (b, y) in itertools.combinations(zip(words, h.tolist(), strict=True), 2):
        assert (a == b) == (x == y)


def test_regular_words_that_polynomials_confuse_are_told_apart():
    """Words of two letters in the order of bit counts, and with the letters exchanged, of 1,024 letters and more."""
    for n in (64, 1024, 4096):
        word = bytes(b"ab"[i.bit_count() % 2] for i in range(n))
        turned = bytes(b"ba"[i.bit_count() % 2] for i in range(n))
        a, b, c = hashing.TextHasher().words(word + b" " + turned + b" " + word)
        assert a == c != b


def test_long_texts_are_hashed_in_segments(monkeypatch):
    raw = b"alpha beta  gamma\n" * 50 + b"z" * 300 + b" end"
    whole = hashing.TextHasher().words(raw)
    monkeypatch.setattr(hashing.TextHasher, "SEGMENT", 40)
    assert (hashing.TextHasher().words(raw) == whole).all()


@pytest.mark.parametrize("hub", [64, 3])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(components_, "LEAST_HUB", hub)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    rng.shuffle(edges)
    got = dict(components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect())
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 160))
    assert got[200] == got[201] == 200 and 300 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- order MinHash


def naive_signature(h, text):
    """The same selection, an element at a time."""
    kmers = h.kmers(text)
    seen, numbered = {}, []
    for k in kmers.tolist():
        seen[k] = seen.get(k, -1) + 1
        numbered.append(int(hashing.mixed(np.array([k], dtype=np.uint64) + np.uint64(seen[k]) * hashing.ODD)[0]))
    out = []
    for a, b in zip(h.factor.tolist(), h.offset.tolist(), strict=True):
        least = sorted(range(len(numbered)), key=lambda i: ((numbered[i] * a + b) % (1 << 64), i))[: h.select]
        v = np.array([h.select], dtype=np.uint64)
        for i in sorted(least):
            v = hashing.mixed(v * hashing.ODD + kmers[i])
        out.append(int(v[0]) >> 32)
    return out


@pytest.mark.parametrize("text", ["", "one", "a b", "a b a b a b c", "the cat sat on the mat the cat sat", "x" * 100, "é ü \x00"])
def test_signature_equals_the_naive_one(text):
    h = ordermin.OrderMinHash()
    assert h.signature(text).tolist() == naive_signature(h, text)


def test_blocks_do_not_change_a_signature(monkeypatch):
    text = prose(random.Random(1), 400)
    want = ordermin.OrderMinHash().signature(text)
    monkeypatch.setattr(ordermin, "BLOCK", 13)
    assert (ordermin.OrderMinHash().signature(text) == want).all()


def test_order_counts():
    h = ordermin.OrderMinHash(permutations=256)
    w = prose(random.Random(4), 200, [f"v{i}" for i in range(500)]).split()
    text, turned = " ".join(w), " ".join(w[100:] + w[:100])
    few = " ".join(w[:50] + ["edit"] + w[50:])
    a = h.signature(text)
    assert h.likeness(a, a) == 1
    assert h.likeness(a, h.signature(few)) > 0.9 > h.likeness(a, h.signature(turned)) > 0.3
    assert h.likeness(a, h.signature(prose(random.Random(9), 200, [f"u{i}" for i in range(500)]))) < 0.1


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_comparison_with_the_next(spark, rows, docs, parts):
    check_compared(docs, parts)


def check_compared(docs, parts):
    from pyspark.sql import functions as F

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h")).collect()
    ordered = [(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[1]))]
    h = ordermin.OrderMinHash()
    want = []
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        e = text[: len(text) - half] + following[:half]
        a, b, c = h.signature(text), h.signature(e), h.signature(following)
        want.append((i, len(text), hashlib.sha256(e.encode()).hexdigest(), ordermin.as_text(a), ordermin.as_text(b), h.likeness(a, b), h.likeness(a, c)))
    assert as_set(ordermin.compare_with_next(docs, parts)) == sorted(want, key=repr)


@pytest.mark.parametrize("parts", [2, 9])
def test_hot_ids_are_cut_by_hash(spark, parts):
    """Half of the rows without an id, a quarter with one id, equal rows among them, in some partitions and over several."""
    rng = random.Random(9)
    rows = [(None, prose(rng, 6)) for _ in range(60)] + [(5, prose(rng, 6)) for _ in range(30)]
    rows += [(None, "copied text of a page")] * 25 + [(5, None)] * 3 + [(i, prose(rng, 6)) for i in range(20)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_compared(df, parts)
    ids = np.array([(1 << 63) - 1 if i is None else i for i, _ in rows])
    ranges = ordermin._Ranges(0, sorted(ids[:: max(1, len(ids) // 8)].tolist()))
    part = ranges.of(ids, np.random.default_rng(0).integers(-(1 << 63), (1 << 63) - 1, len(ids)))
    assert np.bincount(part).max() < 0.45 * len(ids)


def test_fingerprints_of_odd_tables(docs, empty, clashing, spark):
    assert ordermin.compare_with_next(empty).count() == 0
    assert as_set(ordermin.compare_with_next(clashing, 3)) == as_set(ordermin.compare_with_next(docs, 3))
    assert ordermin.fingerprint(clashing).columns == [*clashing.columns, "fingerprint"]
    lone = ordermin.compare_with_next(spark.createDataFrame([(1, "abc def")], "doc_id long, text string")).first()
    assert lone["near_next"] == 1.0
    none = ordermin.compare_with_next(spark.createDataFrame([(None, "x y"), (None, None)], "doc_id long, text string"))
    assert none.count() == 2
