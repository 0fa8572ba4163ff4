"""Best-fit packing of token sequences: length patterns fitted by non-negative least squares."""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

CAPACITY = 2048
SEPARATOR = 0
BIN = 16
MOST_DOCUMENTS = 4
BUCKETS = 256
TOKENIZER = "byte_bpe_50k"
#: From so many white-space characters in a row a text goes to the tokenizer's own library, as the fast one can't match them.
LONG_BLANK = 50_000
_LONG_BLANK = re.compile(rf"\s{{{LONG_BLANK}}}")


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(f"{TOKENIZER}.json"), public_tokenizers.path(f"{TOKENIZER}.tiktoken")


@functools.lru_cache(2)
def _encoder(json_file: str, rank_file: str):
    """Text to ids. The rank file holds the JSON file's vocabulary and gives the same ids four times as
    fast. Texts that name the special token, have a very long run of blanks, or that the fast library gives up
    on go through the JSON file itself. Tests hold both ways to equal ids."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    with open(json_file, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    whole = functools.cache(Tokenizer.from_file)  # few tasks meet a text that needs it

    def exact(text: str) -> list[int]:
        return whole(json_file).encode(text, add_special_tokens=False).ids

    def encode(text: str) -> list[int]:
        if any(s in text for s in special) or (len(text) >= LONG_BLANK and _LONG_BLANK.search(text)):
            return exact(text)
        try:
            return fast.encode_ordinary(text)
        except BaseException as e:
            if type(e).__name__ != "PanicException":  # of the native library, and no subclass of Exception
                raise
            return exact(text)

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, files: tuple[str, str] | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document's ids."""
    files = files or default_files()

    def run(batches):
        encode = _encoder(*files)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), SEPARATOR], dtype="<u4")
                out += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def patterns_of(bins: int, most: int) -> list[tuple[int, ...]]:
    """All ways to fill ``bins`` with up to ``most`` parts, largest part first, and the lone parts."""

    def fill(left: int, top: int, parts: int):
        if left <= top:
            yield (left,)
        if parts > 1:
            for p in range(min(top, left - 1), 0, -1):
                if p * parts >= left:
                    for rest in fill(left - p, p, parts - 1):
                        yield (p, *rest)

    return [*fill(bins, bins, most), *((b,) for b in range(1, bins))]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """argmin ||a x - b|| over x >= 0 by the active-set method of Lawson and Hanson."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    tol = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        j = int(w.argmax())
        if w[j] <= tol:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                break
            low = z <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            gone = at[low & (x[at] <= 1e-12)]
            if not len(gone):
                gone = at[[int(np.argmin(z))]]
            x[gone], active[gone] = 0, False
            if not active.any():
                break
        at = np.flatnonzero(active)
        x[:] = 0
        if len(at):
            x[at] = np.maximum(np.linalg.lstsq(a[:, at], b, rcond=None)[0], 0)
    return x


class _Stock:
    """Pieces left of each length; ``at_most`` finds the largest length that is left under a bound."""

    def __init__(self, counts: np.ndarray):
        self.left, self.below = counts.astype(np.int64).tolist(), list(range(len(counts)))

    def at_most(self, length: int) -> int:
        path = []
        while length > 0 and not self.left[length]:
            if self.below[length] == length:
                self.below[length] = length - 1
            path.append(length)
            length = self.below[length]
        for p in path:
            self.below[p] = length
        return max(length, 0)

    def take(self, length: int, most: int) -> int:
        n = min(self.left[length], most)
        self.left[length] -= n
        return n


def plan(counts: np.ndarray, capacity: int = CAPACITY, width: int = BIN, most: int = MOST_DOCUMENTS) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as ``(lengths, repeats)`` for ``counts[length]`` pieces of each length.

    Lengths fall into bins of ``width`` tokens. Patterns of up to ``most`` bins that fill a sequence are
    enumerated, their repeat counts fitted to the bins' histogram by non-negative least squares, and
    rounded down. A repeat takes exact lengths for all parts of its pattern but the last, which is the
    longest piece left that fits; so it is with what still fits behind it. What no pattern takes is
    packed alike, longest first. Runs of equal choices are handled at once, so the work and the size of
    the plan depend on the number of lengths, never on the number of pieces.
    """
    stock, out = _Stock(counts), []

    def close(head: tuple[int, ...], repeats: int) -> None:
        todo = [(head, repeats)]
        while todo:
            lengths, n = todo.pop()
            fit = stock.at_most(capacity - sum(lengths))
            if not fit:
                out.append((lengths, n))
                continue
            got = stock.take(fit, n)
            todo.append(((*lengths, fit), got))
            if got < n:
                todo.append((lengths, n - got))

    bins = -(-capacity // width)
    histogram = np.zeros(bins)
    np.add.at(histogram, -(-np.arange(1, capacity + 1) // width) - 1, counts[1 : capacity + 1])
    ways = patterns_of(bins, most)
    a = np.zeros((bins, len(ways)))
    for j, way in enumerate(ways):
        for b in way:
            a[b - 1, j] += 1
    fitted = np.floor(nnls(a, histogram) + 1e-6).astype(np.int64) if histogram.any() else np.zeros(len(ways), np.int64)
    for j in sorted(np.flatnonzero(fitted), key=lambda j: (len(ways[j]), tuple(-b for b in ways[j]))):
        runs = [((), int(fitted[j]))]
        for part, b in enumerate(ways[j][:-1] if len(ways[j]) > 1 else ways[j]):
            lengths = range(min(b * width, capacity), (b - 1) * width, -1)
            longer = []
            for head, n in runs if part % 2 else reversed(runs):
                for x in lengths if part % 2 == 0 else reversed(lengths):
                    if n and stock.left[x] and sum(head) + x <= capacity and (got := stock.take(x, n)):
                        longer.append(((*head, x), got))
                        n -= got
                if n and head:
                    longer.append((head, n))
            runs = longer
        for head, n in runs:
            close(head, n)
    for x in range(capacity, 0, -1):
        while stock.left[x]:
            close((x,), stock.take(x, stock.left[x]))
    merged: dict[tuple[int, ...], int] = {}
    for lengths, n in out:
        key = tuple(sorted(lengths, reverse=True))
        merged[key] = merged.get(key, 0) + n
    return sorted(merged.items(), reverse=True)


def slots(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows ``(length, first rank, first sequence, offset)``, sorted: the pieces of a length take its slots in the order of their ranks."""
    rows, used, sequence = [], {}, 0
    for lengths, n in planned:
        offset = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + n
            offset += x
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(docs: DataFrame, capacity: int = CAPACITY, files: tuple[str, str] | None = None) -> DataFrame:
    """Pack every document: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` a piece.

    The driver sees the histogram of lengths (at most ``capacity`` rows) and makes the plan. Pieces of
    one length are numbered without gaps over 256 hash buckets a length, so a length that a third of
    all pieces share is still spread, and each finds its slot by its number.

    Null text is empty and packs as the lone separator; equal ids and repeated rows are packed a row
    each; an empty table gives no rows. Other columns are ignored. ``doc_id`` is an integer or null. Very
    long texts are tokenized whole in one task and cut to pieces there. Buckets go by id,
    content and the partition of the written pieces, so rows without an id and repeated rows are spread as others are.
    """
    pieces = checkpointed(tokenized_pieces(docs, capacity, files))
    spread = F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id())
    pieces = pieces.withColumn("bucket", F.pmod(spread, F.lit(BUCKETS)).cast("int"))
    sizes = checkpointed(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in sizes.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    table = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("own", own).join(starts, ["length", "bucket"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("own")).alias("rank")
    )

    def place(batches):
        at = table.value
        keys = (at[:, 0] << 44) + at[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            columns = [*b.columns[:5], pa.array(at[k, 2] + rank - at[k, 1]), pa.array(at[k, 3])]
            yield pa.record_batch(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
