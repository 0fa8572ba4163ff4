"""Toxicity of text behind a noisy channel: leetspeak, spacing and repetition are decoded first."""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extended, without
from .learning import labelled_sample, logistic, prior_weights, sigmoid

#: The language model's symbols: 0 for no letter, a to z, the letters ß to ÿ, and 60 for any other letter.
SYMBOLS = 61
OTHER = 60

#: Letters that leetspeak writes as these characters.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l",
}
SEPARATORS = ".-_*~'’·"
VOWELS = "aeiou"

#: Costs of the channel, as negative natural logarithms.
COST_LEET, COST_DROP, COST_BREAK, COST_STAR, COST_REPEAT, COST_LITERAL = 1.0, 0.2, 1.5, 3.0, 0.2, 6.0

THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
LEAST_DOCUMENTS = 3
LEAST_EVIDENCE = 0.7
CACHE = 300_000

_EDGE = ".,;:?!\"'()[]{}<>«»“”‘’…"
_LETTERS = re.compile(r"[^\W\d_]+")
_TRIPLE = re.compile(r"(.)\1\1")


def symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    if "\xdf" <= c <= "\xff" and c != "\xf7":
        return ord(c) - 0xDF + 27
    return OTHER if c.isalpha() else 0


_LATIN = np.array([symbol(chr(i)) for i in range(256)], dtype=np.int64)


def symbols(text: str) -> np.ndarray:
    """Symbols of a text in lower case, with no letter before and behind."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = _LATIN[np.minimum(points, 255)]
    for i in np.flatnonzero(points > 255):
        codes[i] = symbol(chr(points[i]))
    return codes


def trigram_counts(docs: DataFrame) -> DataFrame:
    """``code, n``: how often each symbol trigram occurs in all texts, summed a partition before the shuffle."""

    def count(batches):
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                texts = [t or "" for t in batch.column(0).slice(s, 200).to_pylist()]
                c = symbols(" ".join(texts))
                if len(c) > 2:
                    total += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["code", "n"])

    return docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs ``[a, b, c]`` of c behind a and b, from the trigrams of all documents, interpolated with
    bigrams and single symbols. The driver gets at most 61^3 counts."""
    t = np.zeros(SYMBOLS**3)
    got = trigram_counts(docs).toArrow()
    t[got.column("code").to_numpy()] = got.column("n").to_numpy()
    return costs(t.reshape(SYMBOLS, SYMBOLS, SYMBOLS))


def costs(t: np.ndarray) -> np.ndarray:
    two, one = t.sum(axis=0), t.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (t + 5 * p2[None]) / (t.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


def lattice(token: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """Choices ``(letters or a blank or nothing, cost)`` for each character of a token in lower case.

    A letter stands for itself; of a run of three or more, the second may go and the others do. A leet
    character stands for its letters; a separator goes or breaks the word; a star may hide a vowel;
    whatever else breaks the word. In ``spaced`` text any letter may also begin a word.
    """
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c = token[i]
        run = 1
        while i + run < len(token) and token[i + run] == c:
            run += 1
        if c.isalpha():
            own = [(c, 0.0), *([(" " + c, COST_BREAK)] if spaced and i else [])]
            out.append(own)
            if run == 2:
                out.append(own)
            elif run > 2:
                out.append([(c, COST_REPEAT), ("", COST_REPEAT)])
        elif c in LEET and c != "!" or c == "!" and i + run < len(token):
            choice = [(x, COST_LEET) for x in LEET[c]] + [(" ", COST_LITERAL)]
            out += [choice] * min(run, 2)
        elif c in SEPARATORS:
            out.append([("", COST_DROP), (" ", COST_BREAK), *([(v, COST_STAR) for v in VOWELS] if c == "*" else [])])
        else:
            out.append([(" ", 0.0)])
        i += run
    return out


def viterbi(choices: list[list[tuple[str, float]]], lm: np.ndarray) -> str:
    """The cheapest text through a lattice under the trigram model, between two blanks."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    codes: dict[str, int] = {}
    for options in choices:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in best.items():
            for letters, channel in options:
                x, y, total = a, b, cost + channel
                for c in letters:
                    if c not in codes:
                        codes[c] = symbol(c)
                    z = codes[c]
                    if z or y:  # further blanks cost and change nothing
                        total += lm[x, y, z]
                        x, y = y, z
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (letters, path))
        best = after
    path = min((cost + lm[a, b, 0], i, path) for i, ((a, b), (cost, path)) in enumerate(best.items()))[2]
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))


def restore(chunk: str, lm: np.ndarray) -> list[str]:
    """Words that a piece of text without blanks stands for: as written, and decoded where it looks disguised,
    with and without the marks behind it. Without letters it is decoded if a word of three could come of it."""
    core = chunk.lower().strip(_EDGE)
    if core.isalpha() and not _TRIPLE.search(core):
        return [core]
    plain = _LETTERS.findall(core)
    if not plain and (len(core) < 3 or LEET.keys().isdisjoint(core)):
        return []
    words = dict.fromkeys(plain)
    for reading in dict.fromkeys([core.rstrip("#%$&*|!") or core, core]):
        if not reading.isalpha() or _TRIPLE.search(reading):
            words |= dict.fromkeys(viterbi(lattice(reading), lm).split())
    return list(words)


def spaced_words(run: str, lm: np.ndarray) -> list[str]:
    """Words that single characters in a row spell: all in one, and as decoded."""
    return list(dict.fromkeys([run, *viterbi(lattice(run, spaced=True), lm).split()]))


def features(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in PREFIXES if len(word) >= n)] if len(word) > 2 else []


@dataclass
class Model:
    """``evidence`` of whole words and prefixes, and the coefficients of a document's summary."""

    lm: np.ndarray
    evidence: dict[str, float]
    coefficients: np.ndarray

    def scorer(self):
        rows: dict[str, int] = {}
        values: list[float] = []
        single: list[bool] = []

        def learn(chunk: str) -> int:
            words = restore(chunk, self.lm)
            rows[chunk] = len(values)
            values.append(self.most(words))
            core = chunk.strip(_EDGE)
            single.append(len(core) == 1 and core in chunk and (core.isalpha() or core in LEET))
            return rows[chunk]

        def score(texts: list[str | None]) -> list[float]:
            nonlocal rows, values, single
            if len(rows) > CACHE:
                rows, values, single = {}, [], []
            split = [(t or "").split() for t in texts]
            for chunk in set().union(*split).difference(rows):
                learn(chunk)
            known, lone = np.array(values, dtype=float), np.array(single, dtype=bool)
            found = []
            for chunks in split:
                at = np.fromiter(map(rows.__getitem__, chunks), np.int64, len(chunks))
                found.append(summary(np.concatenate([known[at], self.spaced(chunks, lone[at])])))
            x = np.array(found).reshape(len(texts), 2)
            return sigmoid(x @ self.coefficients[:2] + self.coefficients[2]).tolist()

        return score

    def most(self, words: list[str]) -> float:
        return max((self.evidence.get(f, 0.0) for w in words for f in features(w)), default=0.0)

    def spaced(self, chunks: list[str], lone: np.ndarray) -> np.ndarray:
        return np.array([self.most(spaced_words(r, self.lm)) for r in spaced_runs(chunks, lone)])


def spaced_runs(chunks: list[str], lone: np.ndarray) -> list[str]:
    """Three or more single characters in a row that aren't all the same, joined."""
    if lone.sum() < 3:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], lone.astype(np.int8), [0]])))
    runs = ["".join(c.strip(_EDGE).lower() for c in chunks[s:e]) for s, e in zip(edges[::2], edges[1::2], strict=True) if e - s > 2]
    return [r for r in runs if len(set(r)) > 1]


def summary(x: np.ndarray) -> tuple[float, float]:
    """The strongest evidence in a text, and the sum of its three strongest."""
    top = heapq.nlargest(3, x[x > 0].tolist())
    return (top[0] if top else 0.0), sum(top)


def fit(texts: list[str], y: np.ndarray, prior: float, lm: np.ndarray) -> Model:
    """Evidence of a word or prefix: log of the ratio of toxic to other documents with it, where the toxic
    ones count less a standard error. What has little evidence, or few documents, is left out. A
    logistic regression on a document's strongest evidence turns it into a probability; it is fitted to
    rows whose own words don't count towards the evidence, in five folds. With one class or none
    every score is the prior."""
    if min(y.sum(), (1 - y).sum()) == 0:
        return Model(lm, {}, np.array([0.0, 0.0, np.log(prior / (1 - prior))]))
    cache: dict[str, list[str]] = {}

    def words(text: str) -> list[list[str]]:
        chunks = text.split()
        for c in chunks:
            if c not in cache:
                cache[c] = restore(c, lm)
        lone = np.array([len(c.strip(_EDGE)) == 1 for c in chunks], dtype=bool)
        return [*(cache[c] for c in set(chunks)), *(spaced_words(r, lm) for r in spaced_runs(chunks, lone))]

    rows = [[[f for w in ws for f in features(w)] for ws in words(t)] for t in texts]

    def evidence(at: np.ndarray) -> dict[str, float]:
        seen: tuple[dict, dict] = ({}, {})
        for i in at:
            count = seen[y[i]]
            for f in {f for fs in rows[i] for f in fs}:
                count[f] = count.get(f, 0) + 1
        ones, zeros = y[at].sum(), len(at) - y[at].sum()
        out = {}
        for f, p in seen[1].items():
            if p >= LEAST_DOCUMENTS:
                e = np.log((p - 0.8 * np.sqrt(p)) / (ones + 1)) - np.log((seen[0].get(f, 0) + 0.5) / (zeros + 1))
                if e > LEAST_EVIDENCE:
                    out[f] = float(e)
        return out

    fold = np.arange(len(y)) % 5
    x = np.zeros((len(y), 2))
    for k in range(5):
        own = evidence(np.flatnonzero(fold != k))
        for i in np.flatnonzero(fold == k):
            x[i] = summary(np.array([max((own.get(f, 0.0) for f in fs), default=0.0) for fs in rows[i]]))
    return Model(lm, evidence(np.arange(len(y))), logistic(x, y, prior_weights(y, prior)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """The language model reads all documents, whole and null ones as empty; the evidence comes from a bounded
    labelled sample, in which repeated rows and labels and rows without an id change nothing (``labelled_sample``)."""
    return fit(*labelled_sample(docs, labels, label), language_model(docs))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` behind its columns; only the text is read.

    A null text scores as the empty one, very long texts are decoded whole, and equal texts, so also repeated rows,
    score alike; a score equal to the threshold is predicted 1. Columns of these two names are replaced; rows and other
    columns stay as they are; an empty table gives no rows.
    """
    docs = without(docs, "score", "predicted")
    keep = docs.columns
    at = keep.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = shared.value.scorer()
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                x = scorer(part.column(at).to_pylist())
                more = [pa.array(x, pa.float64()), pa.array([int(v >= threshold) for v in x], pa.int32())]
                yield pa.record_batch([*part.columns, *more], [*keep, "score", "predicted"])

    return docs.mapInArrow(run, extended(docs, score=T.DoubleType(), predicted=T.IntegerType()))
