"""Language ID: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extended, held_out, without

BUCKETS = 1 << 14
DIMENSION = 16
ORDERS = (2, 3, 4)
#: Documents to learn from, of each language and in all at most, and their longest text in characters.
SAMPLE = 600
SAMPLE_ROWS = 8_000
SAMPLE_CHARS = 20_000
#: Labels to learn at most; a table with more is refused.
MOST_LABELS = 500
EPOCHS = 12
BATCH = 32
RATE = 20.0
#: The share of accepted documents that may be wrong on the calibration rows.
MAX_ERROR = 0.02
SEED = 11
UNKNOWN = "und"
#: Words that stay scored, and words scored at a time.
CACHE, NEW = 100_000, 8_000

_LETTERS = re.compile(r"[^\W\d_]+")


def subword_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, index of the word)`` of the byte 2- to 4-grams of every ``<word>``."""
    joined = b"<" + b"><".join(words) + b">"
    b = np.frombuffer(joined, dtype=np.uint8).astype(np.uint32)
    word = np.cumsum(b == ord("<")) - 1
    at, owner = [], []
    for n in ORDERS:
        if len(b) < n:
            continue
        m = len(b) - n + 1
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for i in range(n):
            h = (h ^ b[i : i + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        inside = word[:m] == word[n - 1 :]
        at.append((h & np.uint32(BUCKETS - 1))[inside])
        owner.append(word[:m][inside])
    return np.concatenate(at), np.concatenate(owner)


def words_of(text: str) -> list[bytes]:
    """Runs of letters in lower case."""
    return [w.encode() for w in _LETTERS.findall(text.lower())]


@dataclass
class Model:
    """``log_odds[bucket]`` is the embedding of a subword times the softmax weights, a column a language."""

    languages: list[str]
    log_odds: np.ndarray
    bias: np.ndarray
    scale: float
    threshold: float

    def predictor(self):
        """A function from texts to ``(languages, scores)``; words are scored once while they stay cached."""
        rows: dict[str, int] = {}
        sums = np.zeros((1, len(self.languages) + 1))

        def learn(new: list[str], first: int) -> np.ndarray:
            parts = [words_of(chunk) for chunk in new]
            flat = [w for p in parts for w in p]
            own = np.zeros((len(new), len(self.languages) + 1))
            if flat:
                at, word = subword_hashes(flat)
                chunk = np.repeat(np.arange(len(new)), [len(p) for p in parts])[word]
                for c in range(len(self.languages)):
                    own[:, c] = np.bincount(chunk, self.log_odds[at, c], len(new))
                own[:, -1] = np.bincount(chunk, minlength=len(new))
            rows.update(zip(new, range(first, first + len(new)), strict=True))
            return own

        def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
            nonlocal sums
            if len(rows) > CACHE:
                rows.clear()
                sums = sums[:1]
            split = [(t or "").split() for t in texts]
            new = set().union(*split).difference(rows)
            new = list(new)
            own = [learn(new[at : at + NEW], len(sums) + at) for at in range(0, len(new), NEW)]
            if own:
                sums = np.concatenate([sums, *own])
            total = np.array([sums[np.fromiter(map(rows.__getitem__, s), np.int64, len(s))].sum(axis=0) for s in split])
            total = total.reshape(len(texts), len(self.languages) + 1)
            known = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], dtype=bool)
            p = self.probabilities(total[:, :-1] / np.maximum(total[:, -1:], 1))
            best = p.argmax(axis=1)
            names = [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
            return names, np.where(known, p[np.arange(len(p)), best], 0.0).tolist()

        return predict

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        return softmax((mean + self.bias) * self.scale)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], languages: list[str], seed: int = SEED, max_error: float = MAX_ERROR) -> Model:
    """Stochastic gradient descent on the mean of subword embeddings and the softmax above it.

    Every fifth row is left out, to fit the softmax's temperature and then the rejection threshold: the
    least score above which at most ``max_error`` of these rows are wrong. With one language or no rows
    the model knows only that, or nothing.
    """
    names = sorted(set(languages)) or [UNKNOWN]
    c = len(names)
    if c == 1:
        return Model(names, np.zeros((BUCKETS, 1)), np.zeros(1), 1.0, 0.0)
    y = np.array([names.index(x) for x in languages])
    rng = np.random.default_rng(seed)
    docs = []
    for t in texts:
        words = words_of(t)
        at = subword_hashes(words)[0] if words else np.zeros(0, np.uint32)
        k, n = np.unique(at, return_counts=True)
        docs.append((k, (n / max(1, len(at))).astype(np.float32)))
    order = rng.permutation(len(docs))
    held, train = order[::5], np.array([i for k, i in enumerate(order) if k % 5])
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    w = np.zeros((DIMENSION, c), np.float32)
    bias = np.zeros(c, np.float32)
    weight = (len(y) / c / np.maximum(np.bincount(y, minlength=c), 1)).astype(np.float32)

    def dense(rows) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for r, i in enumerate(rows):
            x[r, docs[i][0]] = docs[i][1]
        return x

    steps, step = EPOCHS * max(1, -(-len(train) // BATCH)), 0
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for s in range(0, len(train), BATCH):
            rows = train[s : s + BATCH]
            x = dense(rows)
            hidden = x @ e
            g = softmax(hidden @ w + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g *= weight[y[rows], None] / len(rows)
            rate = RATE * (1 - step / steps)
            used = np.flatnonzero(x.any(axis=0))
            back = g @ w.T
            w -= rate * hidden.T @ g
            bias -= 0.01 * rate * g.sum(axis=0)
            e[used] -= rate * x[:, used].T @ back
            step += 1
    log_odds = (e @ w).astype(float)
    held = held if len(held) else train
    logits = np.array([docs[i][1] @ log_odds[docs[i][0]] for i in held]) + bias
    scales = np.geomspace(0.05, 20, 60)
    unsure = 1 / (len(held) + 2)  # so that rows without an error don't call for certainty
    target = np.full(logits.shape, unsure / c)
    target[np.arange(len(held)), y[held]] += 1 - unsure
    loss = [-(target * np.log(np.maximum(softmax(logits * s), 1e-12))).sum() for s in scales]
    scale = float(scales[int(np.argmin(loss))])
    p = softmax(logits * scale)
    score, wrong = p.max(axis=1), p.argmax(axis=1) != y[held]
    best = np.argsort(-score)
    error = np.cumsum(wrong[best]) / np.arange(1, len(best) + 1)
    fine = np.flatnonzero(error <= max_error)
    if not len(fine):
        threshold = 1.0
    elif fine[-1] == len(best) - 1:
        threshold = min(1.0 / c + 0.1, float(score.min()))
    else:
        threshold = float(score[best[fine[-1]]])
    return Model(names, log_odds, bias.astype(float), scale, threshold)


def train(docs: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE, most_labels: int = MOST_LABELS) -> Model:
    """Fit on a bounded sample: about ``sample`` texts of each label, chosen by a hash of the text.

    Only rows that aren't held out, have a label, and have a text of at most ``SAMPLE_CHARS`` characters
    count; a label that only longer texts have is never learned, though longer texts are predicted whole.
    More than ``most_labels`` labels among them raise an error, as a label left out would never be predicted.
    Repeated rows and rows without an id count as others do, equal texts of one label once in the
    sample; at most twice ``SAMPLE_ROWS`` texts come to the driver. A table without such rows gives a model
    that knows no language and calls every text ``und``.
    """
    rows = docs.where(~held_out(F.col(doc_id)) & F.col(label).isNotNull() & F.col(text).isNotNull())
    rows = rows.where(F.length(text) <= SAMPLE_CHARS)
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(most_labels + 1).collect()}
    if len(counts) > most_labels:
        raise ValueError(f"{label} has more than {most_labels} labels")
    if not counts:
        return fit([], [])
    sample = min(sample, SAMPLE_ROWS / len(counts))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))])
    order = F.xxhash64(F.lit(SEED), text)
    u = F.pmod(order, F.lit(1 << 20)) / (1 << 20)
    chosen = rows.where(u < F.element_at(share, F.col(label))).select(text, label).distinct()
    got = chosen.orderBy(order, text, label).limit(2 * SAMPLE_ROWS).toArrow().to_pylist()
    return fit([r[text] for r in got], [r[label] for r in got])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``accepted`` behind its columns.

    Only the text is read, whole at any length. A null text and one without letters get ``und`` and score 0
    and aren't accepted; of other texts those that score under the model's threshold aren't. Equal scores
    go to the language that is first by name. Equal texts, and so repeated rows, get equal results. Columns
    of these three names are replaced; rows and other columns stay as they are; an empty table gives no rows.
    """
    docs = without(docs, "lang_pred", "score", "accepted")
    keep = docs.columns
    at = keep.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        predict = shared.value.predictor()
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                names, scores = predict(part.column(at).to_pylist())
                ok = [n != UNKNOWN and x >= shared.value.threshold for n, x in zip(names, scores, strict=True)]
                more = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(ok, pa.bool_())]
                yield pa.record_batch([*part.columns, *more], [*keep, "lang_pred", "score", "accepted"])

    return docs.mapInArrow(run, extended(docs, lang_pred=T.StringType(), score=T.DoubleType(), accepted=T.BooleanType()))
