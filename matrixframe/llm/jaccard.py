"""Exact Jaccard join on word shingles: count vectors in an R-tree bound the overlap, survivors are verified."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, removed
from .components import HUB_SHARE, LEAST_HUB, components
from .hashing import TextHasher, word_grams

SHINGLE = 5
#: Two sets link when DEN * |intersection| >= NUM * |union|.
NUM, DEN = 75, 100
#: Least number of groups of a count vector, and the set size up to which it serves; it doubles with the size.
GROUPS, GROUP_SIZE = 64, 256
#: Shingles are counted in so many cells, to order rare ones first.
CELLS, CELL_CHUNK = 1 << 18, 1 << 12
#: Classes that share a shingle are paired up to this many, and indexed in an R-tree beyond.
SHORT = 8
#: Members of a block of a large group; a group goes by pairs of blocks.
BLOCK = 1024
#: Members of a long list that a task hands on at a time.
PIECE = 16_384
FANOUT = 16
#: Cells of at least this level (so many doublings above the mean) spread their shingles over salts.
HOT_LEVEL, SALTS = 4, 64


def least_overlap(total):
    """The least intersection of two sets that link, by the sum of their sizes."""
    return -(-NUM * total // (NUM + DEN))


def sizes_fit(a, b):
    return (DEN * a >= NUM * b) & (DEN * b >= NUM * a)


def prefix_length(n: int) -> int:
    """So many of a set's shingles, first in any common order, hold one that a linked set also has in its own."""
    return n - -(-NUM * n // DEN) + 1


def index_length(n: int) -> int:
    """So many of its first shingles does the smaller of two linked sets need to meet the larger one's prefix:
    of the n, the smaller has at least those in common that two sets of its size would need."""
    return n - int(least_overlap(2 * n)) + 1


class Shingles:
    """Sorted shingle sets of texts: of lower-cased words, five in a row, or all words of a shorter text."""

    def __init__(self, k: int = SHINGLE):
        self.k, self.hasher = k, TextHasher()

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.hasher.words((text or "").encode("utf-8", "surrogatepass").lower())
        return np.unique(word_grams(words, self.k)) if len(words) else np.zeros(0, dtype=np.uint64)


def set_class(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set; documents with equal sets are one class."""
    return int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "big", signed=True)


def groups_of(n: int) -> int:
    g, size = GROUPS, GROUP_SIZE
    while size < n:
        g, size = g * 2, size * 2
    return g


def count_vector(s: np.ndarray) -> np.ndarray:
    """How many shingles fall into each group, groups growing with the set."""
    g = groups_of(len(s))
    return np.bincount((s & np.uint64(g - 1)).astype(np.int64), minlength=g)


def cell_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(46)).astype(np.int64)


def packed(v: np.ndarray) -> bytes:
    return v.astype(np.uint8 if v.max(initial=0) < 256 else np.uint32).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8 if len(raw) == groups_of(n) else np.uint32).astype(np.int32)


def folded(v: np.ndarray, groups: int) -> np.ndarray:
    while len(v) > groups:
        half = len(v) // 2
        v = v[:half] + v[half:]
    return v


def overlap_bound(u: np.ndarray, v: np.ndarray) -> int:
    """No two sets with these count vectors share more: the sum of the coordinates' minima."""
    g = min(len(u), len(v))
    return int(np.minimum(folded(u, g), folded(v, g)).sum())


class CountTree:
    """An R-tree of count vectors. A node keeps the largest value of each coordinate and the range of sizes
    below it. ``search`` gives the points whose overlap with a query may be large enough for a link."""

    def __init__(self, vectors: list[np.ndarray], sizes: np.ndarray):
        self.vectors, self.sizes = vectors, np.asarray(sizes)
        self.groups = min(map(len, vectors))
        points = np.array([folded(v, self.groups) for v in vectors], dtype=np.int32)
        order = self._tiled(points)
        self.order = order
        self.levels = [(points[order], self.sizes[order], self.sizes[order])]
        while len(self.levels[-1][0]) > FANOUT:
            top, low, high = self.levels[-1]
            at = np.arange(0, len(top), FANOUT)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def _tiled(self, points: np.ndarray) -> np.ndarray:
        """Sort-tile-recursive order: slabs of near sizes, within them by the coordinates that vary most."""
        widest = np.argsort(-points.var(axis=0), kind="stable")[:2]
        slab = np.empty(len(points), dtype=np.int64)
        slab[np.argsort(self.sizes, kind="stable")] = np.arange(len(points)) // (FANOUT * FANOUT)
        return np.lexsort((*(points[:, c] for c in widest), slab))

    def search(self, vector: np.ndarray, size: int) -> np.ndarray:
        groups = min(self.groups, len(vector))
        q = folded(vector, groups)
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = (x[at] for x in self.levels[depth])
            if groups < self.groups:  # a query of fewer groups meets sums of the coordinates, which still bound
                top = top.reshape(len(top), self.groups // groups, groups).sum(axis=1)
            bound = np.minimum(np.minimum(top, q).sum(axis=1), np.minimum(high, size))
            fits = (bound >= least_overlap(size + low)) & (DEN * high >= NUM * size) & (DEN * size >= NUM * low)
            at = at[fits]
            if depth and len(at):
                below = len(self.levels[depth - 1][0])
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < below]
        found = self.order[at]
        if len(vector) > self.groups:  # a finer look where both vectors have more groups
            found = np.array([i for i in found if len(self.vectors[i]) == self.groups or overlap_bound(vector, self.vectors[i]) >= least_overlap(size + self.sizes[i])], dtype=np.int64)
        return found


class Forest:
    """Union-find over 0..n-1 that remembers the pairs which joined two trees."""

    def __init__(self, n: int):
        self.parent, self.joined = np.arange(n), []

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if (q == p).all():
                self.parent = p
                return p
            p = q

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, k: int) -> None:
        a, b = self.find(i), self.find(k)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.joined.append((i, k))


class Inverted:
    """Shingles of a block's sets in order, each with its set: overlaps of a query with every set at once."""

    def __init__(self, sets: list[np.ndarray]):
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.tokens, self.n = every[order], len(sets)
        self.owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]

    def overlaps(self, s: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.tokens, s, "left"), np.searchsorted(self.tokens, s, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=self.n)


def forest_of(
    sides: np.ndarray, sizes: np.ndarray, vectors: list[np.ndarray], sets: list[np.ndarray] | None, cross: bool, first: np.ndarray | None = None
) -> Forest:
    """Trees of the members of a block, or of two blocks, that link (with ``sets``) or may link (without).

    In ``cross`` mode only pairs from both sides count; the others belong to the blocks' own tasks. A query
    passes over members that are in its tree already, so a large group costs little more than its links.
    ``first`` marks members that are in their list by one of their first shingles: only pairs count whose smaller set is.
    """
    forest = Forest(len(sizes))
    queries = np.flatnonzero(sides == 0)
    data = np.flatnonzero(sides == 1) if cross else queries
    if not len(queries) or not len(data):
        return forest
    tree = CountTree([vectors[i] for i in data], sizes[data])
    index = Inverted([sets[i] for i in data]) if sets is not None else None
    for q in queries:
        found = data[tree.search(vectors[q], int(sizes[q]))]
        found = found[found != q] if cross else found[found < q]
        if not len(found):
            continue
        if first is not None:
            found = found[(first[found] & (sizes[found] <= sizes[q])) | (first[q] & (sizes[q] <= sizes[found]))]
        found = found[forest.roots()[found] != forest.find(q)]
        if index is not None and len(found):
            overlap = index.overlaps(sets[q])[np.searchsorted(data, found)]
            found = found[DEN * overlap >= NUM * (sizes[q] + sizes[found] - overlap)]
        for i in found:
            forest.join(int(q), int(i))
    return forest


def _count_pass(docs: DataFrame) -> DataFrame:
    """A row a document ``(doc_id, row, n, cls, vec)``, and a partition's counts of shingles by cell, in chunks."""

    def run(batches):
        shingles, cells = Shingles(), np.zeros(CELLS, dtype=np.uint32)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, out, sets = b.slice(at, 500), [], []
                for doc_id, row, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    s = shingles(text)
                    sets.append(s)
                    out.append((doc_id, row, len(s), set_class(s) if len(s) else None, packed(count_vector(s)) if len(s) else None))
                cells += np.bincount(cell_of(np.concatenate(sets)), minlength=CELLS).astype(np.uint32)
                yield _rows(out, [])
        used = [c for c in range(0, CELLS, CELL_CHUNK) if cells[c : c + CELL_CHUNK].any()]
        yield _rows([], [(c, zlib.compress(cells[c : c + CELL_CHUNK].tobytes(), 1)) for c in used])

    def _rows(documents, chunks):
        n = len(documents) + len(chunks)
        d = list(zip(*documents, strict=True)) or [[None] * n] * 5
        c = list(zip(*chunks, strict=True)) if chunks else [[None] * n] * 2
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
        return pa.record_batch([pa.array(x, t) for x, t in zip([*d, *c], kinds, strict=True)], ["doc_id", "row", "n", "cls", "vec", "chunk", "cells"])

    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, n long, cls long, vec binary, chunk int, cells binary")


def _levels(counted: DataFrame) -> np.ndarray:
    """A cell's level: 0 up to twice the mean count of a cell, then one more each doubling. 256 KB at any size."""
    per_chunk = counted.where("chunk is not null").select("chunk", "cells")

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CELL_CHUNK, dtype=np.uint64)
        for raw in table.column("cells"):
            total += np.frombuffer(zlib.decompress(raw.as_py()), dtype=np.uint32)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "total": pa.array([total.tobytes()])})

    total = np.zeros(CELLS)
    for r in per_chunk.groupBy("chunk").applyInArrow(add, "chunk int, total binary").collect():
        total[r["chunk"] : r["chunk"] + CELL_CHUNK] = np.frombuffer(r["total"], dtype=np.uint64)
    mean = max(total.mean(), 1.0)
    return np.maximum(0, np.floor(np.log2(np.maximum(total, 1) / mean))).astype(np.uint8)


def _entries(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """``token, salt, cls, n``: each class by the shingles of its prefix, rare cells first. A task names a class once.

    ``n`` is negative for the shingles behind the class's first ones (``index_length``). A shingle of a hot
    cell has its classes dealt over salts from 1; others have salt 0."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        shingles, seen = Shingles(), set()
        for b in batches:
            tokens, salts, classes, sizes = [], [], [], []
            for text in b.column(0):
                s = shingles(text.as_py())
                if not len(s) or (c := set_class(s)) in seen:
                    continue
                seen.add(c)
                level = shared.value[cell_of(s)]
                p = prefix_length(len(s))
                if level.any():
                    s = s[np.argsort(level, kind="stable")]  # within a level in the order of the hash
                tokens.append(s[:p])
                salts.append(np.where(shared.value[cell_of(s[:p])] >= HOT_LEVEL, 1 + c % SALTS, 0))
                classes.append(np.full(p, c))
                sizes.append(np.where(np.arange(p) < index_length(len(s)), len(s), -len(s)))
            if tokens:
                columns = [np.concatenate(tokens).view(np.int64), np.concatenate(salts).astype(np.int32), np.concatenate(classes), np.concatenate(sizes).astype(np.int32)]
                for at in range(0, len(columns[0]), 100_000):
                    yield pa.record_batch([pa.array(c[at : at + 100_000]) for c in columns], ["token", "salt", "cls", "n"])

    return docs.select("text").mapInArrow(run, "token long, salt int, cls long, n int")


def _whole_lists(batches):
    """Sorted rows ``token, salt, cls, n`` without repeats, cut where a new token begins, and whether the first and
    the last list are pieces of longer ones. A piece is only cut off where the rest alone makes the list long."""
    held, began = None, False
    for b in batches:
        if not b.num_rows:
            continue
        now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        token, cls = now[0], now[2]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])])
        now = [x[new] for x in now]
        last = int(np.searchsorted(now[0], now[0][-1]))  # tokens ascend, so the last list begins here
        piece = len(now[0]) - last > 2 * PIECE
        if piece:
            last = len(now[0]) - PIECE
        if last:
            yield [x[:last] for x in now], began, piece
            began = piece
        held = [x[last:] for x in now]
    if held is not None:
        yield held, began, False


def _lists(entries: DataFrame) -> DataFrame:
    """Classes that share a token: ``a, b`` pairs of short lists that fit in size, or ``token, a, first`` members
    of long ones. Pairs count whose smaller set has the token among its first.

    Rows come sorted and are read as a stream, so a task holds few batches however long a list is. Lists of
    a hot cell's tokens are dealt by salt and count as long."""

    def run(batches):
        for (token, salt, cls, n), began, goes_on in _whole_lists(batches):
            first, n = n > 0, np.abs(n.astype(np.int64))
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            length = np.diff(np.concatenate([start, [len(token)]]))
            long = (length > SHORT) | (salt[start] > 0)
            some = np.logical_or.reduceat(first, start)  # without a first member a list has no pairs
            long[0], some[0] = long[0] or began, some[0] or began
            long[-1], some[-1] = long[-1] or goes_on, some[-1] or goes_on
            pairs = []
            for d in range(1, SHORT):
                short = np.repeat((length > d) & ~long, length)
                last = np.repeat(start + length, length) - d
                at = np.flatnonzero(short & (np.arange(len(token)) < last))
                ok = (first[at] & (n[at] <= n[at + d])) | (first[at + d] & (n[at + d] <= n[at]))
                at = at[ok & sizes_fit(n[at], n[at + d])]
                pairs.append(np.column_stack([cls[at], cls[at + d]]))
            pairs = np.unique(np.concatenate(pairs), axis=0)
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.record_batch([none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.bool_())], ["token", "a", "b", "first"])
            at = np.flatnonzero(np.repeat(long & (some | (salt[start] > 0)), length))
            yield pa.record_batch([pa.array(token[at]), pa.array(cls[at]), pa.nulls(len(at), pa.int64()), pa.array(first[at])], ["token", "a", "b", "first"])

    dealt = entries.repartition("token", "salt").sortWithinPartitions("token", "cls")
    return dealt.mapInArrow(run, "token long, a long, b long, first boolean")


def _may_link(n_a: list, v_a: list, n_b: list, v_b: list) -> np.ndarray:
    """Whether the bound lets each pair link; pairs of vectors of one form are taken at once."""
    keep = np.zeros(len(n_a), dtype=bool)
    total = np.array(n_a) + np.array(n_b)
    forms: dict[tuple, list[int]] = {}
    for i, (x, u, y, v) in enumerate(zip(n_a, v_a, n_b, v_b, strict=True)):
        forms.setdefault((groups_of(x), len(u), groups_of(y), len(v)), []).append(i)
    for (gu, wide_u, gv, wide_v), at in forms.items():
        u, v = (
            np.frombuffer(b"".join([raw[i] for i in at]), np.uint8 if wide == g else np.uint32).reshape(-1, g).astype(np.int32)
            for raw, g, wide in ((v_a, gu, wide_u), (v_b, gv, wide_v))
        )
        g = min(gu, gv)
        bound = np.minimum(u.reshape(len(at), -1, g).sum(axis=1), v.reshape(len(at), -1, g).sum(axis=1)).sum(axis=1)
        keep[at] = bound >= least_overlap(total[at])
    return keep


def _bounded_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose count vectors allow a link."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("vec").alias(f"v_{x}"))
    joined = pairs.distinct().join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.select(["a", "b"]).filter(pa.array(_may_link(*(b.column(c).to_pylist() for c in ("n_a", "v_a", "n_b", "v_b")))))

    return joined.mapInArrow(run, "a long, b long")


def _in_blocks(members: DataFrame, group: str, size: str) -> DataFrame:
    """Members dealt to the tasks of their group: ``i, k`` is the pair of blocks, ``side`` the member's. A group
    of one block has the one task (0, 0)."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls", group), blocks).cast("int")
    placed = members.select("*", blocks.alias("blocks"), own.alias("own"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select(
        *members.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("k"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
    )


def _by_group(batches, keys: int):
    """Rows of an ordered partition, a list of tuples for each value of the first ``keys`` columns."""
    held, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[:keys] != held:
                if rows:
                    yield held, rows
                held, rows = r[:keys], []
            rows.append(r[keys:])
    if rows:
        yield held, rows


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _possible_links(long: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges that span, in each long list, what the R-tree's bound lets link."""
    sized = long.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.max("first").alias("any")).where("any and m > 1")
    members = long.join(sized, "token").select("token", F.col("a").alias("cls"), "m", "first")
    dealt = _in_blocks(members, "token", "m").join(classes.select("cls", "n", "vec"), "cls")
    columns = ("token", "i", "k", "side", "cls", "first", "n", "vec")
    sorted_ = dealt.select(*columns).repartition("token", "i", "k").sortWithinPartitions("token", "i", "k", "cls")

    def run(batches):
        for (_, i, k), rows in _by_group(batches, 3):
            side, cls, first, n, vec = zip(*rows, strict=True)
            vectors = [unpacked(v, x) for v, x in zip(vec, n, strict=True)]
            forest = forest_of(np.array(side), np.array(n), vectors, None, i != k, np.array(first))
            yield _edges([(cls[x], cls[y]) for x, y in forest.joined])

    return sorted_.mapInArrow(run, "a long, b long")


def _links(docs: DataFrame, clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges that span the true components within each cluster, verified on whole shingle sets."""
    sized = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    members = clusters.join(sized, "root").select(F.col("root").alias("cluster"), "m", F.col("node").alias("cls"))
    # one text a class: that of its representative row, of which there may be repeats
    needed = members.select("cls").join(classes.select("cls", "name"), "cls")
    texts = docs.select("name", "text").join(needed, "name").groupBy("cls").agg(F.first("text").alias("text"))
    dealt = _in_blocks(members, "cluster", "m")
    with_text = dealt.select("cluster", "i", "k", "side", "cls").join(texts, "cls")
    sorted_ = with_text.select("cluster", "i", "k", "side", "cls", "text").repartition("cluster", "i", "k").sortWithinPartitions("cluster", "i", "k", "cls")

    def run(batches):
        shingles = Shingles()
        for (_, i, k), rows in _by_group(_shingled(batches, shingles), 3):
            side, cls, sets = zip(*rows, strict=True)
            sizes = np.array([len(s) for s in sets])
            forest = forest_of(np.array(side), sizes, [count_vector(s) for s in sets], list(sets), i != k)
            yield _edges([(cls[x], cls[y]) for x, y in forest.joined])

    return sorted_.mapInArrow(run, "a long, b long")


class _Columns(list):
    columns = property(lambda self: self)


class _List(list):
    to_pylist = property(lambda self: lambda: self)


def _shingled(batches, shingles):
    """Batches with the text replaced by its set."""
    for b in batches:
        rows = [(*key, shingles(text)) for *key, text in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if rows:
            yield _Columns(_List(c) for c in zip(*rows, strict=True))


def named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, a hash of id and text, and ``name``, by which rows are told apart and ordered: by id,
    those without one last, then by the hash. Rows equal in id and text have one name."""
    with_row = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    return with_row.withColumn("name", _name())


def _name():
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))


def _components(docs: DataFrame) -> DataFrame:
    """``name, n_shingles, least`` of every row, ``least`` the first name in its component."""
    docs = named(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counted = checkpointed(_count_pass(docs))
    of_docs = counted.where("chunk is null").select(_name().alias("name"), "n", "cls", "vec")
    by_class = of_docs.where("cls is not null").groupBy("cls")
    of_class = (F.min("name").alias("name"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("vec").alias("vec"))
    classes = checkpointed(by_class.agg(*of_class))
    lists = checkpointed(_lists(_entries(docs, _levels(counted))))
    pairs, long = lists.where("token is null").select("a", "b"), lists.where("token is not null").select("token", "a", "first")
    possible = _bounded_pairs(pairs, classes).unionByName(_possible_links(long, classes))
    clusters = components(possible)
    linked = components(_links(docs, clusters, classes))
    roots = linked.join(classes.select(F.col("cls").alias("node"), "name"), "node")
    least = roots.groupBy("root").agg(F.min("name").alias("least"))
    component = roots.join(least, "root").select(F.col("node").alias("cls"), "least")
    own = classes.select("cls", "copies", F.col("name").alias("first")).join(component, "cls", "left")
    own = checkpointed(own.select("cls", "copies", F.coalesce("least", "first").alias("least")))
    removed(clusters)
    removed(linked)
    # classes with more than this share of all rows, of which there are at most as many as its inverse, go to all tasks
    limit = max(LEAST_HUB, int((classes.agg(F.sum("copies")).first()[0] or 0) * HUB_SHARE))
    hubs = own.where(F.col("copies") > limit).select(F.col("cls").alias("hub"), F.col("least").alias("of_hub"))
    alone = of_docs.where("cls is null").select("name", "n", F.col("name").alias("least"))
    tagged = of_docs.where("cls is not null").join(F.broadcast(hubs), F.col("cls") == F.col("hub"), "left")
    rest = tagged.where("hub is null").join(own.where(F.col("copies") <= limit).select("cls", "least"), "cls")
    found = tagged.where("hub is not null").select("name", "n", F.col("of_hub").alias("least")).unionByName(rest.select("name", "n", "least"))
    return found.unionByName(alone).select("name", F.col("n").alias("n_shingles"), "least")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``; only ``doc_id`` and ``text`` are read.

    Two documents link when their sets of distinct shingles have a Jaccard likeness of 0.75 or more; the
    component is the least ``doc_id`` that links lead to. No link is lost:

    1. Documents with equal sets become one class, named by a 64-bit hash of the set, so copies cost a row.
    2. Two sets that link share a shingle that is among the first quarter of the larger and the first seventh
       or so of the smaller, in any order common to all. Shingles are ordered by how frequent their cell
       is over the whole corpus, then by hash, so passages that many documents share rarely bring them together.
    3. Classes that share such a shingle are compared by count vectors. Short lists are paired; long ones
       are indexed in an R-tree whose nodes bound the overlap by summed coordinate minima, and only a
       forest of what may link goes on. Lists and clusters over 1,024 members go by pairs of blocks.
    4. What may link is closed to clusters. In each, R-tree search, then overlaps counted on whole shingle
       sets, give the true links, of which again only a forest is kept, and its components.

    A text without words, and a null one, has an empty set and stays alone. Equal ids and repeated rows
    get a row each; rows without an id link as others do, by a hash of the row, and a null id stays null, and
    so does its component where no other id is in it. Very long texts are taken whole. Other
    columns are ignored. An empty table gives no rows.
    """
    return _components(docs).select("name.doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """Of each component the row with the least id, or where no row has one, that with the least hash.

    Texts without words, null ones too, are alone and stay; so does one of rows equal in id and text, whatever their other columns
    say. Columns stay as they are; an empty table gives no rows.
    """
    kept = _components(docs).where("name = least").select("name").distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = named(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", whole.alias("whole")))
    return rows.groupBy("name").agg(F.min("whole").alias("whole")).join(kept, "name").select("whole.*")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
linked AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id
  WHERE 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
r AS (SELECT doc_id AS id, doc_id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a AND r.root < e.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM s JOIN r ON r.id = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
