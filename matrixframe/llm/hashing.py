"""64-bit hashes of words and of runs of words, in numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

CACHE = 400_000
LARGEST = np.uint64((1 << 64) - 1)
ODD, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _B
    x ^= x >> np.uint64(27)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """Words to their hashes, cached."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` words in a row; fewer words make one gram of all, also none."""
    n = len(words) - k + 1
    k = k if n > 0 else len(words)
    out = np.full(max(1, n), k, dtype=np.uint64)
    for i in range(k):
        out *= ODD
        out += words[i : i + len(out)]
    return mixed(out)


class TextHasher:
    """Hashes of all words of a text at once: polynomials over their bytes, from one running sum.

    ``sum[i]`` has the terms of all bytes before i; a word's are those between its ends, brought back to
    where a word begins by an inverse power. Long texts go by segments of about a million bytes. Words of more than
    ``POLYNOMIAL`` bytes are hashed one by one, as polynomials modulo 2^64 are equal for some long regular words.
    """

    POLYNOMIAL = 64

    SEGMENT = 1 << 20
    _SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
    _GAP = re.compile(rb"[\x20\x09-\x0D]")

    def __init__(self):
        self.inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
        self.powers = self.back = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        def powers(base):
            out = np.full(max(n, 1 << 14), base, dtype=np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        self.powers, self.back = powers(ODD), powers(self.inverse)

    def words(self, raw: bytes) -> np.ndarray:
        if len(raw) <= self.SEGMENT:
            return self._words(raw)
        parts, s = [], 0
        while s < len(raw):
            gap = self._GAP.search(raw, s + self.SEGMENT)
            e = gap.start() if gap else len(raw)
            parts.append(self._words(raw[s:e]))
            s = e
        return np.concatenate(parts)

    def _words(self, raw: bytes) -> np.ndarray:
        b = np.frombuffer(raw, dtype=np.uint8)
        if len(b) >= len(self.powers):
            self._grow(2 * len(b))
        edge = np.empty(len(b) + 1, dtype=bool)
        inside = ~self._SPACE[b]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        edge[0], edge[-1] = (inside[0], inside[-1]) if len(b) else (False, False)
        at = np.flatnonzero(edge)
        terms = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.powers[: len(b)], out=terms[1:])
        out = mixed((terms[at[1::2]] - terms[at[::2]]) * self.back[at[::2]])
        for i in np.flatnonzero(at[1::2] - at[::2] > self.POLYNOMIAL):
            out[i] = xxhash.xxh3_64_intdigest(raw[at[2 * i] : at[2 * i + 1]])
        return out
