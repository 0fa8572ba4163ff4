"""Quality classifier: naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import extended, without
from .learning import labelled_sample, logistic, prior_weights, sigmoid

#: Indicators: byte bigrams, then hashed bigrams and trigrams of word shapes.
BYTES = 1 << 16
SHAPES = 1 << 16
SMOOTHING = 1.0
COST = 0.1
EPOCHS = 15
THRESHOLD = 0.7
SEED = 3
CACHE = 400_000


def shape(word: str) -> int:
    """Case (none, lower, capital, upper, mixed), last character (letter, digit, mark, symbol), digits, length."""
    case = 0 if word.lower() == word.upper() else 1 if word.islower() else 3 if word.isupper() else 2 if word.istitle() else 4
    last = word[-1]
    end = 0 if last.isalpha() else 1 if last.isdigit() else 2 if last in ".,;:?" else 3
    return ((case * 4 + end) * 2 + any(map(str.isdigit, word))) * 4 + min(3, len(word) // 6)


class _Shapes(dict):
    """Words to ``(running number, shape)``, cached."""

    def __missing__(self, word: str) -> int:
        self[word] = v = len(self) << 8 | shape(word)
        return v


def indicators(text: str, cache: _Shapes) -> np.ndarray:
    """Sorted numbers of the n-grams that the whole text has.

    The shape of a word also tells whether the word is one of the two before it, so that n-grams of
    shapes see repetition.
    """
    raw = np.frombuffer(text.encode(), dtype=np.uint8).astype(np.uint32)
    seen = np.zeros(BYTES + SHAPES, dtype=bool)
    seen[raw[:-1] << 8 | raw[1:]] = True
    words = text.split()
    code = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
    if len(code):
        again = np.zeros(len(code), dtype=np.int64)
        again[1:] |= code[1:] == code[:-1]
        again[2:] |= code[2:] == code[:-2]
        s = (code & 255) * 2 + again + 1
        for n in (1, 2, 3):
            if len(s) >= n:
                h = np.full(len(s) - n + 1, n, dtype=np.int64)
                for i in range(n):
                    h = (h * 0x2545F491 + s[i : len(s) - n + 1 + i]) & 0x7FFFFFFF
                    h ^= h >> 13
                seen[BYTES + (h & (SHAPES - 1))] = True
    return np.flatnonzero(seen)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    n = BYTES + SHAPES
    p, q = np.full(n, SMOOTHING), np.full(n, SMOOTHING)
    for x, label in zip(rows, y, strict=True):
        (p if label else q)[x] += 1
    return np.log(p / (y.sum() + 2 * SMOOTHING)) - np.log(q / (len(y) - y.sum() + 2 * SMOOTHING))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS):
    """Weights and bias of the L2-regularised hinge loss; row i's dual variable stays in [0, cost[i]]."""
    w, bias = np.zeros(BYTES + SHAPES), 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    alpha = np.zeros(len(y))
    square = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(SEED)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g = sign[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if step := (new - alpha[i]) * sign[i]:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-6:
            break
    return w, bias


@dataclass
class Model:
    """``weights`` are already scaled by the log-count ratios; ``slope`` and ``offset`` calibrate the margin."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scorer(self):
        cache = _Shapes()

        def score(texts: list[str | None]) -> list[float]:
            if len(cache) > CACHE:
                cache.clear()
            rows = [indicators(t or "", cache) for t in texts]
            margins = [self.weights[x].sum() / np.sqrt(max(1, len(x))) + self.bias for x in rows]
            return sigmoid(np.array(margins) * self.slope + self.offset).tolist()

        return score


def fit(texts: list[str], y: np.ndarray, prior: float) -> Model:
    """Rows of either class weigh alike in the hinge loss. Every fifth row is left out of it and calibrates
    the margin to probabilities under ``prior``. With one class or none every score is the prior."""
    rest = np.arange(len(y)) % 5 != 0
    if min(y[rest].sum(), (1 - y[rest]).sum()) == 0:
        return Model(np.zeros(BYTES + SHAPES), 0.0, 0.0, float(np.log(prior / (1 - prior))))
    cache = _Shapes()
    rows = [indicators(t, cache) for t in texts]
    at = np.flatnonzero(rest)
    r = log_count_ratio([rows[i] for i in at], y[at])
    values = [r[x] / np.sqrt(max(1, len(x))) for x in rows]
    cost = COST * len(at) / 2 / np.where(y[at] == 1, y[at].sum(), (1 - y[at]).sum())
    w, bias = dual_coordinate_descent([rows[i] for i in at], [values[i] for i in at], y[at], cost)
    margin = np.array([w[x] @ v for x, v in zip(rows, values, strict=True)]) + bias
    held = np.flatnonzero(~rest)
    if min(y[held].sum(), (1 - y[held]).sum()) == 0:
        held = np.arange(len(y))
    slope, offset = logistic(margin[held, None], y[held], prior_weights(y[held], prior))
    return Model(w * r, bias, float(slope), float(offset))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learn from a bounded labelled sample, in which repeated rows and labels and rows without an id change
    nothing (``labelled_sample``); without labels of both classes every score is their share."""
    return fit(*labelled_sample(docs, labels, label))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` behind its columns; only the text is read.

    A null text scores as the empty one, very long texts count whole, and equal texts, so also repeated rows, score
    alike; a score equal to the threshold is predicted 1. Columns of these two names are replaced; rows and other
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
