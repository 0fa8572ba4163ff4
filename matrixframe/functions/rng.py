"""Seed-compatible random numbers: a 48-bit linear congruential generator, and low-discrepancy points."""

from __future__ import annotations

import math

import numpy as np

#: Fixed values of the generator.
MULTIPLIER, INCREMENT, MODULUS = 0x5DEECE66D, 0xB, 1 << 48


class Lcg48:
    """Uniform doubles, polar Gaussians and bounded integers that equal those of other 48-bit generators of
    this kind for the same seed."""

    def __init__(self, seed: int):
        self.state = (seed ^ MULTIPLIER) % MODULUS
        self.spare: float | None = None

    def bits(self, n: int) -> int:
        self.state = (self.state * MULTIPLIER + INCREMENT) % MODULUS
        return self.state >> (48 - n)

    def double(self) -> float:
        high = self.bits(26)
        return ((high << 27) + self.bits(27)) / (1 << 53)

    def gaussian(self) -> float:
        if self.spare is not None:
            out, self.spare = self.spare, None
            return out
        while True:
            x, y = 2 * self.double() - 1, 2 * self.double() - 1
            r = x * x + y * y
            if 0 < r < 1:
                break
        f = math.sqrt(-2 * math.log(r) / r)
        self.spare = y * f
        return x * f

    def integer(self, bound: int) -> int:
        if bound & (bound - 1) == 0:
            return bound * self.bits(31) >> 31
        while True:
            draw = self.bits(31)
            out = draw % bound
            if draw - out + bound - 1 < 1 << 31:
                return out

    def gaussians(self, n: int) -> np.ndarray:
        return np.array([self.gaussian() for _ in range(n)])

    def doubles(self, n: int) -> np.ndarray:
        return np.array([self.double() for _ in range(n)])


def primes(n: int) -> list[int]:
    out: list[int] = []
    c = 2
    while len(out) < n:
        if all(c % p for p in out if p * p <= c):
            out.append(c)
        c += 1
    return out


def halton(n: int, d: int, leap: int | None = None, start: int = 1) -> np.ndarray:
    """n points of d coordinates of a Halton sequence, every ``leap``-th (a prime that isn't a base)."""
    bases = primes(d)
    leap = leap or primes(d + 1)[-1]
    index = start + leap * np.arange(n, dtype=np.int64)
    out = np.zeros((n, d))
    for j, b in enumerate(bases):
        i, f = index.copy(), 1.0 / b
        while i.any():
            out[:, j] += f * (i % b)
            i //= b
            f /= b
    return out


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """The inverse of the normal distribution function: bisection on erfc, then Newton's steps."""
    p = np.clip(np.asarray(p, dtype=float), 1e-16, 1 - 1e-16)
    erfc = np.vectorize(math.erfc, otypes=[float])
    x = np.where(p < 0.5, -1, 1) * np.sqrt(-2 * np.log(np.minimum(p, 1 - p))) * 0.7
    for _ in range(60):
        f = 0.5 * erfc(-x / math.sqrt(2)) - p
        slope = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        step = np.clip(f / np.maximum(slope, 1e-300), -0.5, 0.5)
        x = x - step
        if np.abs(step).max(initial=0) < 1e-13:
            break
    return x
