"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens."""

from __future__ import annotations

import math
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extended, without

#: The base patterns, and the least length of what counts.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "crf")

#: States of a token: outside, beginning, inside.
O, B, I = 0, 1, 2  # noqa: E741
STATES = 3
SAMPLE = 16_000
SAMPLE_CHARS = 20_000
#: Texts with secrets that the sample should have.
LEAST_SECRETS = 200
EPOCHS = 4
RATE = 0.2
DECAY = 1e-5
SEED = 7
CACHE = 200_000

#: What values are drawn from in masked views.
ALPHABETS = tuple(
    "".join(x)
    for x in (
        "0123456789abcdef", "0123456789ABCDEF", string.digits + string.ascii_lowercase, string.digits + string.ascii_uppercase,
        string.digits + string.ascii_letters, string.digits + string.ascii_letters + "+/", string.digits * 2 + string.ascii_letters + "_-",
    )
)

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_LONG_HEX = re.compile(r"[0-9a-f]{16}")
_EDGE = ".,;:!?\"'()[]{}<>"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed patterns, leftmost and non-overlapping in each kind, by start, then kind as listed."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if _LONG_HEX.search(text):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shape_features(token: str) -> list[str]:
    """Length, kinds of characters and how they alternate, and how evenly they are spread."""
    core = token.strip(_EDGE)
    if core.isalpha() and (core.islower() or core.istitle()):
        return ["word", f"word:{min(4, len(core) // 6)}"]
    kinds = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "-" for c in core)
    squeezed = re.sub(r"(.)\1+", r"\1", kinds)
    n = max(1, len(core))
    counts: dict[str, int] = {}
    for c in core:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    size = min(8, n // 4)
    mix = "".join(k for k in "aA9-" if k in kinds)
    return [
        f"mix:{mix}", f"size:{mix}:{size}", f"shape:{squeezed[:8]}", f"turns:{min(6, len(squeezed) // 3)}:{mix}",
        f"entropy:{int(entropy * 2)}:{min(4, size)}", f"digits:{int(5 * kinds.count('9') / n)}:{mix}",
        f"sign:{''.join(s for s in '=:@./_+-' if s in core)}", f"head:{core[:4]}" if len(core) > 15 else "short",
    ]


def neighbour_features(token: str) -> list[str]:
    core = token.strip(_EDGE + "=").lower()
    key = core if core.isalpha() else re.split(r"[:=]", core)[0]
    return [f"is:{key if len(key) <= 12 and key.isascii() else '*'}", f"ends:{token[-1] if token[-1] in ':=' else '*'}"]


def file_features(text: str, tokens: int) -> list[str]:
    """Buckets of the share of digits and of symbols, of the number of tokens, and of lines a token."""
    n = max(1, len(text))
    digits = sum(map(text.count, "0123456789")) / n
    marks = sum(map(text.count, "=:{}<>_/")) / n
    lines = text.count("\n") / max(1, tokens)
    return [
        f"file digits:{min(9, int(math.log2(1 + 200 * digits)))}", f"file marks:{min(9, int(math.log2(1 + 200 * marks)))}",
        f"file tokens:{min(12, int(math.log2(1 + tokens)))}", f"file lines:{min(9, int(20 * lines))}",
    ]


def token_features(token: str) -> tuple[list[str], list[str], list[str]]:
    """Of the token itself, as the one before another, and as the one behind another."""
    near = neighbour_features(token)
    shape = "plain" if token.isalpha() else "odd"
    return (
        ["own " + f for f in (*shape_features(token), near[0])],
        ["before " + f for f in (*near, shape)],
        ["behind " + f for f in (near[0], shape)],
    )


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of states (n x 3) and of transitions (summed, 3 x 3) of one sequence, by forward and backward sums."""
    n = len(e)
    f, b = np.empty_like(e), np.zeros_like(e)
    f[0] = e[0]
    for i in range(1, n):
        f[i] = log_sum(f[i - 1][:, None] + t, 0) + e[i]
    for i in range(n - 2, -1, -1):
        b[i] = log_sum(t + e[i + 1] + b[i + 1], 1)
    z = log_sum(f[-1], 0)
    pairs = np.zeros((STATES, STATES))
    if n > 1:
        pairs = np.exp(f[:-1, :, None] + t + (e[1:] + b[1:])[:, None, :] - z).sum(axis=0)
    return np.exp(f + b - z), pairs


def viterbi(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The best states of a sequence with emissions ``e`` and transitions ``t``.

    A token whose lead of O over both others exceeds what two transitions can make up is O in every best
    path, so paths are searched only between such tokens. The result is that of the whole search.
    """
    n = len(e)
    states = np.zeros(n, dtype=np.int8)
    sure = e[:, O] - e[:, 1:].max(axis=1) > 2 * (t.max() - t.min())
    open_ = np.flatnonzero(~sure)
    if not len(open_):
        return states
    cuts = np.flatnonzero(np.diff(open_) > 1) + 1
    for part in np.split(open_, cuts):
        s, x = part[0], part[-1] + 1
        score = e[s] + (t[O] if s else 0)
        back = []
        for i in range(s + 1, x):
            step = score[:, None] + t
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + e[i]
        if x < n:
            score = score + t[:, O]
        k = int(score.argmax())
        for i in range(x - 1, s - 1, -1):
            states[i] = k
            if i > s:
                k = int(back[i - s - 1][k])
    return states


@dataclass
class Model:
    """``weights[feature]``, a value a state, of the features met in learning, and ``transitions[from, to]``."""

    weights: dict[str, tuple[float, ...]]
    transitions: np.ndarray

    def scanner(self):
        """A function from a text to all its spans, base ones and those the field adds."""
        rows: dict[str, int] = {}
        alike: dict[tuple, int] = {}
        table = np.zeros((0, 3, STATES))
        met = {f.partition("is:")[2] for f in self.weights if "is:" in f}

        def learn(new: list[str]) -> None:
            """Plain words that no learned feature names share a row by length and marks."""
            nonlocal table
            own = []
            for w in new:
                core = w.strip(_EDGE)
                plain = core.isalpha() and (core.islower() or core.istitle()) and w[-1] not in ":=" and (k := core.lower()) not in met
                key = (min(4, len(core) // 6), w.isalpha(), len(k) <= 12 and k.isascii()) if plain else None
                if key in alike:
                    rows[w] = alike[key]
                    continue
                rows[w] = len(table) + len(own)
                own.append([self.total(f) for f in token_features(w)])
                if key:
                    alike[key] = rows[w]
            if own:
                table = np.concatenate([table, np.array(own)])

        def scan(texts: list[str]) -> list[list[tuple[int, int, str]]]:
            nonlocal table
            if len(rows) > CACHE:
                rows.clear()
                alike.clear()
                table = table[:0]
            split = [_TOKEN.findall(t) if _ODD_SPACE.search(t) else t.split() for t in texts]
            learn(sorted(set().union(*split).difference(rows)))
            return [self._spans(t, np.fromiter(map(rows.__getitem__, s), np.int64, len(s)), table) for t, s in zip(texts, split, strict=True)]

        return scan

    def total(self, features: list[str]) -> tuple[float, ...]:
        a = b = c = 0.0
        for f in features:
            if (w := self.weights.get(f)) is not None:
                a, b, c = a + w[0], b + w[1], c + w[2]
        return a, b, c

    def emissions(self, text: str, at: np.ndarray, table: np.ndarray) -> np.ndarray:
        x = table[at]
        e = x[:, 0] + np.array(self.total(file_features(text, len(at))))
        e[1:] += x[:-1, 1]
        e[:-1] += x[1:, 2]
        return e

    def _spans(self, text: str, at: np.ndarray, table: np.ndarray) -> list[tuple[int, int, str]]:
        base = base_spans(text)
        if not len(at):
            return base
        states = viterbi(self.emissions(text, at, table), self.transitions)
        if states.any():
            base += [s for s in tagged_spans(text, states) if all(s[1] <= b[0] or b[1] <= s[0] for b in base)]
        return sorted(base, key=lambda s: (s[0], KINDS.index(s[2])))


#: White space that parts words for ``str.split`` but isn't ASCII's.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def tagged_spans(text: str, states: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans from a token that begins a secret to the last one inside it, without marks around it."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    out, i = [], 0
    while i < len(tokens):
        if states[i] == O:
            i += 1
            continue
        k = i + 1
        while k < len(tokens) and states[k] == I:
            k += 1
        s, e = tokens[i][0], tokens[k - 1][1]
        while s < e and text[s] in _EDGE:
            s += 1
        while e > s and text[e - 1] in _EDGE:
            e -= 1
        if e > s:
            out.append((s, e, "crf"))
        i = k
    return out


def masked(text: str, spans: list[tuple[int, int, str]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]]:
    """A view of a text in which no secret shows what its pattern goes by, and where the secrets are there.

    Key words make way for other words of the text, alone, with a sign, or as a prefix. Values are drawn anew: other
    lengths and alphabets, in pieces or whole, behind a short prefix of their own or none. So only shape, spread of characters
    and neighbours tell a secret. Spans that overlap an earlier one go as part of it."""
    words = [w for w in (x.strip(_EDGE) for x in text[:2000].split()) if w.isalpha()] or ["word"]
    out, found, at, size = [], [], 0, 0

    def put(piece: str) -> None:
        nonlocal size
        out.append(piece)
        size += len(piece)

    for s, e, kind in spans:
        if s < at:
            continue
        put(text[at:s])
        letters = ALPHABETS[int(rng.integers(len(ALPHABETS)))]
        value = "".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(12, 45))))
        if rng.random() < 0.3:
            value = words[int(rng.integers(len(words)))][:3] + "_-"[int(rng.integers(2))] + value
        elif rng.random() < 0.2:
            third = len(value) // 3
            value = "-".join((value[:third], value[third : 2 * third], value[2 * third :]))
        if kind == "assign" and rng.random() < 0.7:
            put(words[int(rng.integers(len(words)))] + (": ", " = ", "=", ' = "', " ")[int(rng.integers(5))])
        found.append((size, size + len(value), kind))
        put(value)
        at = e
    put(text[at:])
    return "".join(out), found


def silver_states(text: str, base: list[tuple[int, int, str]] | None = None) -> tuple[list[str], np.ndarray]:
    """Tokens and their states under the base patterns, or given spans: a token that overlaps one is part of a secret."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    states = np.zeros(len(spans), dtype=np.int8)
    end = -1
    base = base_spans(text) if base is None else base
    k = 0
    for i, (s, e) in enumerate(spans):
        while k < len(base) and base[k][1] <= s:
            end = max(end, base[k][1])
            k += 1
        hit = next((b for b in base[k : k + 4] if b[0] < e and s < b[1]), None)
        if hit:
            states[i] = I if i and states[i - 1] != O and spans[i - 1][1] > hit[0] else B
    return [text[s:e] for s, e in spans], states


def fit(texts: list[str], seed: int = SEED, width: int = 12) -> Model:
    """Maximum likelihood by stochastic gradient steps (AdaGrad) on windows of texts.

    The states to learn are those that the base patterns give: all windows of ``width`` tokens to either
    side of a secret, and as many from elsewhere. Two of three texts with secrets are learned from a ``masked``
    view, so that the field finds secrets which no pattern names. Texts without any give a model that tags
    nothing. The same texts in the same order give the same model.
    """
    names: dict[str, int] = {}
    t = np.zeros((STATES, STATES))
    rng = np.random.default_rng(seed)
    views, hot, cold = [], [], []
    for text in texts:
        base = base_spans(text)
        if base and rng.random() < 2 / 3:
            text, base = masked(text, base, rng)
        tokens, states = silver_states(text, base)
        if not tokens:
            continue
        marks = np.flatnonzero(states)
        starts = [max(0, m - width) for m in marks]
        if not len(starts) or rng.random() < 0.3:
            starts.append(int(rng.integers(0, max(1, len(tokens) - width))))
        odd = [i for i, x in enumerate(tokens) if not states[i] and not x.strip(_EDGE).isalpha()]
        starts += [max(0, i - width) for i in rng.permutation(odd)[:3]]
        last = -1
        for s in sorted(starts):
            if s < last:
                continue
            last = e = min(len(tokens), s + 2 * width)
            (hot if states[s:e].any() else cold).append((len(views), int(s), int(e)))
        views.append((text, base))
    if not hot:
        return Model({}, t)
    # features are made of the windows that are learned from only, and held as flat arrays
    cold = [cold[i] for i in rng.permutation(len(cold))[: 2 * len(hot) + 200]]
    windows, held = [], None
    for k, s, e in sorted(hot + cold):
        if held != k:
            held = k
            tokens, states = silver_states(*views[k])
            filed = file_features(views[k][0], len(tokens))
        at, sizes = [], []
        for i in range(s, e):
            f = [*token_features(tokens[i])[0], *filed]
            if i:
                f += token_features(tokens[i - 1])[1]
            if i + 1 < len(tokens):
                f += token_features(tokens[i + 1])[2]
            at += [names.setdefault(x, len(names)) for x in f]
            sizes.append(len(f))
        windows.append((np.array(at, np.int32), np.array(sizes, np.int32), states[s:e].copy()))
    del views
    w = np.zeros((len(names), STATES))
    gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(windows)):
            at, sizes, states = windows[i]
            e = np.add.reduceat(w[at], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
            p, pairs = marginals(e, t)
            p[np.arange(len(states)), states] -= 1
            np.subtract.at(pairs, (states[:-1], states[1:]), 1)
            gt += pairs**2
            t -= RATE * (pairs + DECAY * t) / np.sqrt(gt)
            unique, owner = np.unique(at, return_inverse=True)
            g = np.zeros((len(unique), STATES))
            np.add.at(g, owner, np.repeat(p, sizes, axis=0))
            g += DECAY * w[unique]
            gw[unique] += g**2
            w[unique] -= RATE * g / np.sqrt(gw[unique])
    return Model(dict(zip(names, map(tuple, w.tolist()), strict=True)), t)


def train(docs: DataFrame, sample: int = SAMPLE, least: int = LEAST_SECRETS) -> Model:
    """Fit on a bounded sample: of texts of at most ``SAMPLE_CHARS`` characters, chosen by a hash of the text,
    those with base spans and a tenth of the others, ``sample`` at most.

    About ``sample`` texts are looked at first, and eight times as many again while fewer than ``least`` of them
    have a secret, so rare secrets are learned at any size. Neither ids nor the partitions of the table
    matter, and equal texts are learned once; a table without secrets gives a model that tags nothing.
    """
    short = docs.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select("text")
    total = docs.count()
    order = F.xxhash64(F.lit(SEED), "text")
    u = F.pmod(order, F.lit(1 << 30)) / (1 << 30)

    def telling(batches):
        for b in batches:
            tenth = b.column(1).to_numpy() % 10 == 0
            spans = np.array([bool(base_spans(t)) for t in b.column(0).to_pylist()], dtype=bool)
            yield pa.record_batch([*b.columns, pa.array(spans)], ["text", "order", "telling"]).filter(pa.array(tenth | spans))

    looked = sample
    while True:
        share = min(1.0, looked / max(1, total))
        some = short.where(u < share).distinct().select("text", order.alias("order"))
        found = some.mapInArrow(telling, "text string, order long, telling boolean")
        got = found.orderBy(F.desc("telling"), "order", "text").limit(sample).toArrow().to_pylist()
        if share >= 1 or sum(r["telling"] for r in got) >= least:
            return fit([r["text"] for r in sorted(got, key=lambda r: (r["order"], r["text"]))])
        looked *= 8


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def find_secrets(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``secrets``, an array of ``(start, end, kind)``, behind its columns.

    Spans are code points of the whole text, end exclusive, by start, then kind as listed. Base spans
    always stay; the field adds those of its spans that overlap none. Null text has none. Very long texts are
    scanned whole; equal texts, and so repeated rows, get equal spans. A column ``secrets`` is replaced; rows and other columns stay as they are; an empty table gives no rows.
    """
    docs = without(docs, "secrets")
    keep = docs.columns
    at = keep.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        scan = shared.value.scanner()
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                found = scan([t or "" for t in part.column(at).to_pylist()])
                cells = [[{"start": x, "end": y, "kind": k} for x, y, k in spans] for spans in found]
                yield pa.record_batch([*part.columns, pa.array(cells, kind)], [*keep, "secrets"])

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])
    return docs.mapInArrow(run, extended(docs, secrets=T.ArrayType(span)))


def redact(text, spans):
    """Column of the text with every span replaced by ``[kind]``; spans that overlap go as one, by the first's kind."""
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    return F.when(F.size(spans) > 0, step).otherwise(text)
