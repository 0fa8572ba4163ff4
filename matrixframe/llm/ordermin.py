"""Document fingerprints by order MinHash, which equal counts and equal order of k-mers make alike."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extended, without
from .hashing import LARGEST, ODD, WordHashes, mixed, word_grams

#: k-mers of so many words; permutations; k-mers that each permutation selects.
K = 2
PERMUTATIONS = 64
SELECT = 2
#: Words longer than this, in bytes, count as several.
LONGEST_WORD = 24
BLOCK = 8192
SEED = 29

def tokens(text: str) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").split()
    if any(len(w) > LONGEST_WORD for w in words):
        words = [w[i : i + LONGEST_WORD] for w in words for i in range(0, len(w), LONGEST_WORD)]
    return words


class OrderMinHash:
    """Fingerprints of texts.

    A text is its sequence of words. The i-th occurrence of a k-mer differs from the others. Each of the
    permutations selects the least few of these numbered k-mers; they are put in the order of the text,
    and the tuple of k-mers is hashed. Two texts agree in a hash when they share the selected k-mers, as
    often and in the same order, so the share of equal hashes falls with their edit distance, not just
    with the overlap of their sets. Texts shorter than a k-mer have one, of all their words.
    """

    def __init__(self, k: int = K, permutations: int = PERMUTATIONS, select: int = SELECT, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.k, self.select = k, select
        self.factor = rng.integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.offset = rng.integers(0, 1 << 63, permutations, dtype=np.uint64)
        self.hashes = WordHashes()

    def kmers(self, text: str) -> np.ndarray:
        words = tokens(text)
        return word_grams(np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words)), self.k)

    def signature(self, text: str) -> np.ndarray:
        kmers = self.kmers(text)
        n = len(kmers)
        order = np.argsort(kmers, kind="stable")
        run = kmers[order]
        new = np.ones(n, dtype=bool)
        new[1:] = run[1:] != run[:-1]
        occurrence = np.zeros(n, dtype=np.uint64)
        if not new.all():
            at = np.arange(n)
            occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        numbered = mixed(kmers + occurrence * ODD)
        rows = np.arange(len(self.factor))[:, None]
        values = index = None
        for s in range(0, n, BLOCK):
            x = numbered[None, s : s + BLOCK] * self.factor[:, None] + self.offset[:, None]
            found, places = [], []
            for _ in range(min(self.select, x.shape[1])):
                i = x.argmin(axis=1)[:, None]
                found.append(x[rows, i])
                places.append(i + s)
                x[rows, i] = LARGEST
            v, p = np.concatenate(found, axis=1), np.concatenate(places, axis=1)
            if values is not None:
                v, p = np.concatenate([values, v], axis=1), np.concatenate([index, p], axis=1)
                least = np.argsort(v, axis=1, kind="stable")[:, : self.select]
                v, p = v[rows, least], p[rows, least]
            values, index = v, p
        ordered = kmers[np.sort(index, axis=1)]
        out = np.full(len(self.factor), self.select, dtype=np.uint64)
        for j in range(ordered.shape[1]):
            out = mixed(out * ODD + ordered[:, j])
        return (out >> np.uint64(32)).astype(np.uint32)

    def likeness(self, a: np.ndarray, b: np.ndarray) -> float:
        """From 0 to 1: the share of equal hashes, brought to the scale of single k-mers."""
        return float((a == b).mean() ** (1 / self.select))


def fingerprint(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``fingerprint``, the hashes in hexadecimal, behind its columns.

    A null text counts as the empty one, which has one k-mer of no words. Equal texts have equal
    fingerprints. A column ``fingerprint`` is replaced; rows and other columns stay as they are; an
    empty table gives no rows.
    """
    docs = without(docs, "fingerprint")
    keep = docs.columns
    at = keep.index("text")

    def run(batches):
        hasher = OrderMinHash(**options)
        for b in batches:
            made = [as_text(hasher.signature(t or "")) for t in b.column(at).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(made, pa.string())], [*keep, "fingerprint"])

    return docs.mapInArrow(run, extended(docs, fingerprint=T.StringType()))


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of the characters, rounded down, replaced by the first as many of the following text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


class _Ranges:
    """Ranges of rows in the order of ``(key, h)``, the id and a hash of the text.

    ``cuts`` are quantiles of the ids. An id that several of them name holds so many ranges' rows, and is itself cut
    into as many ranges by the hash. So neither rows without an id nor those of one id meet in one range."""

    def __init__(self, first: int, cuts: list[int]):
        self.keys, times = np.unique(np.array([first, *cuts], dtype=np.int64), return_counts=True)
        self.times = times
        self.start = np.concatenate([[0], np.cumsum(times)[:-1]])

    def of(self, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        u = np.searchsorted(self.keys, keys, side="right") - 1
        share = (h.astype(np.float64) + 2.0**63) / 2.0**64
        own = np.minimum((share * self.times[u]).astype(np.int64), self.times[u] - 1)
        return self.start[u] + np.where(keys == self.keys[u], own, self.times[u] - 1)


def compare_with_next(docs: DataFrame, parts: int | None = None, **options) -> DataFrame:
    """Fingerprints of every text, of it with its last half edited, and how like each is to the first.

    The next document is the next by ``doc_id`` (null ids last; of equal ids, the next by a hash of the text, then by
    text; of equal rows, another of them); the last one's is the first. Null text is empty. Very long texts are
    taken whole. An empty table gives no rows. Other columns are ignored.

    Ids are cut at approximate quantiles, and an id that has several ranges' rows, as null may, by the hash as well.
    One shuffle deals out the ranges; the first row of a range goes to the range before as well, where it
    only serves as next. So no task sees more than its range, and texts move once. Equal rows of a batch move as
    one with their number.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = (1 << 63) - 1
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    key = F.coalesce("doc_id", F.lit(last))
    steps = [(i + 1) / parts for i in range(parts - 1)] or [0.5]
    found = keyed.agg(F.min(key).alias("first"), F.percentile_approx(key, steps, 20 * parts).alias("cuts")).first()
    ranges = _Ranges(found["first"] or 0, (found["cuts"] or []) if parts > 1 else [])

    def keys_of(b) -> tuple[np.ndarray, np.ndarray]:
        return b.column(0).fill_null(last).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)

    def least(batches):
        for b in batches:
            if b.num_rows:
                k, h = keys_of(b)
                part = ranges.of(k, h)
                order = np.lexsort((h, k, part))
                at = order[np.unique(part[order], return_index=True)[1]]
                yield pa.record_batch([pa.array(x[at]) for x in (part, k, h)], ["part", "k", "h"])

    firsts = keyed.select("doc_id", "h").mapInArrow(least, "part long, k long, h long").groupBy("part").agg(F.min(F.struct("k", "h")).alias("at"))
    known = sorted((r["part"], r["at"]["k"], r["at"]["h"]) for r in firsts.collect())  # a row a range
    some, first_k, first_h = (np.array([r[i] for r in known], dtype=np.int64) for i in range(3))

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            k, h = keys_of(b)
            # equal ids and hashes beside each other; of equal rows the first stands for all
            order = np.lexsort((h, k))
            same = np.zeros(len(k), dtype=bool)
            same[1:] = (k[order][1:] == k[order][:-1]) & (h[order][1:] == h[order][:-1])
            if same.any():
                ids, texts = b.column(0), b.column(2)
                for i in np.flatnonzero(same):
                    x, y = int(order[i]), int(order[i - 1])
                    same[i] = ids[x].is_valid == ids[y].is_valid and texts[x] == texts[y]
            at = order[~same]
            copies = np.diff(np.concatenate([np.flatnonzero(~same), [len(k)]]))
            part = ranges.of(k[at], h[at])
            i = np.searchsorted(some, part)
            leads = np.flatnonzero((first_k[i] == k[at]) & (first_h[i] == h[at]))
            before = some[i[leads] - 1]  # the first range's first row serves in the last range
            rows = np.concatenate([at, at[leads]])
            serves = np.concatenate([np.zeros(len(at), bool), np.ones(len(leads), bool)])
            columns = [np.concatenate([part, before]).astype(np.int32), serves, np.concatenate([copies, np.ones(len(leads), np.int64)])]
            yield pa.record_batch([*map(pa.array, columns), *(c.take(pa.array(rows)) for c in b.columns)], ["part", "serves", "copies", "doc_id", "h", "text"])

    dealt = keyed.mapInArrow(deal, "part int, serves boolean, copies long, doc_id long, h long, text string")
    ranged = dealt.repartition("part").sortWithinPartitions("part", "serves", F.col("doc_id").asc_nulls_last(), "h", "text")

    def compare(batches):
        hasher = OrderMinHash(**options)
        held = None
        names = [c.split()[0] for c in RESULT.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

        def compared(own_id, own, own_sign, text, sign):
            other = edited(own, text)
            other_sign = own_sign if other == own else sign if other == text else hasher.signature(other)
            return (
                own_id, len(own), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own_sign),
                as_text(other_sign), hasher.likeness(own_sign, other_sign), hasher.likeness(own_sign, sign),
            )

        def table(out):
            return pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 7, kinds, strict=True)], names)

        for b in batches:
            out = []
            for part, serves, copies, doc_id, _, text in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                sign = None
                if held and held[0] == part:
                    sign = held[3] if text == held[2] else hasher.signature(text)
                    out.append(compared(*held[1:], text, sign))
                if serves:
                    held = None
                    continue
                held = (part, doc_id, text, hasher.signature(text) if sign is None else sign)
                if copies > 1:  # all but the last are followed by an equal row
                    again = compared(doc_id, text, held[3], text, held[3])
                    for s in range(0, copies - 1, 5000):
                        yield table([again] * min(5000, copies - 1 - s))
            yield table(out)

    return ranged.mapInArrow(compare, RESULT)
