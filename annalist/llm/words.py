"""Vectorised words, word hashes and word windows over many texts at once.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, as in ``[^\\x20\\x09-\\x0D]+``.
Hashes are 64 bit and equal exactly when the byte strings are, but for collisions
(for n different words or windows in one comparison about n*n/2**65).
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
STEP = U(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), U(base))
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _powers.clear() if len(_powers) > 4 else None
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Words:
    """Words of texts whose bytes lie one after another.

    first, last: byte range of each word; text: the text it is in; count: words per text;
    begin: index of each text's first word (one more entry than texts).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        word = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], word))
        after = np.concatenate((word, [False]))
        self.first = np.flatnonzero(after & (~before | edge))
        self.last = np.flatnonzero(before & (~after | edge))
        self.begin = np.searchsorted(self.first, offsets)
        self.count = np.diff(self.begin)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, U)
            np.cumsum((self.data.astype(U) + U(1)) * powers(BASE, n), out=total[1:])
            h = (total[self.last] - total[self.first]) * powers(INVERSE, n + 1)[self.first]
            return mix(h ^ ((self.last - self.first).astype(U) * STEP))

    def windows(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each window of k words that lies in one text."""
        h = self.hashes() if hashes is None else hashes
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        with np.errstate(over="ignore"):
            out = h[:n].copy()
            for j in range(1, k):
                out *= STEP
                out += h[j : j + n]
        at = np.flatnonzero(self.text[:n] == self.text[k - 1 :])
        return at, mix(out[at] ^ U(k))


def repeated(keys: np.ndarray) -> np.ndarray:
    """For each key whether it occurs twice or more."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive offsets, empty ranges included."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]
