"""Vectorised text primitives: code points, words and hashes of a whole Arrow batch at once.

A *word* is a maximal run of Unicode letters and digits; words are compared in lower case. Everything here
works on one flat array of code points for all texts of a batch, so that no Python loop runs over
characters or words.
"""

from __future__ import annotations

import functools
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, DIGIT, SPACE, UPPER = 0, 1, 2, 4, 8
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class bits, lower case, random 64-bit value of the lower case) by code point."""
    n = sys.maxunicode + 1
    cls, low = np.zeros(n, np.uint8), np.arange(n, dtype=np.uint32)
    for c in range(n):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if s.isspace():
            cls[c] = SPACE
        elif s.isalpha():
            cls[c] = LETTER | (UPPER if s.isupper() else 0)
        elif s.isalnum():
            cls[c] = DIGIT
        lo = s.lower()
        if len(lo) == 1 and lo != s:
            low[c] = ord(lo)
    return cls, low, mix(low.astype(np.uint64) + np.uint64(1))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n (base is odd)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a))
        have = _POWERS[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _WORD_BASE) -> np.ndarray:
    """A 64-bit hash of values[s:e] for every span, from prefix sums of a polynomial modulo 2**64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


@dataclass
class Points:
    """Code points of a batch; text i is points[at[i]:at[i + 1]]."""

    points: np.ndarray
    at: np.ndarray


def points(col: pa.Array) -> Points:
    """Nulls count as empty texts."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(col) or at[0] == at[-1]:
        return Points(np.zeros(0, np.uint32), np.zeros(len(col) + 1, np.int64))
    raw = np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    if raw.max() < 128:
        return Points(raw.astype(np.uint32), at)
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    return Points(np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), lead[at])


@dataclass
class Words:
    """Words of a batch: start and end (code points, in the flat array), lower-case hash; text i has words first[i]:first[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs that don't cross the bounds in ``at``."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = at[(at > 0) & (at < len(inside))]
    start[cut] |= inside[cut]
    end[cut - 1] |= inside[cut - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(p: Points) -> Words:
    cls, _, value = tables()
    start, end = runs((cls[p.points] & (LETTER | DIGIT)) != 0, p.at)
    return Words(start, end, spans_hash(value[p.points], start, end, _BASE), np.searchsorted(start, p.at))


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``n`` words; a text of 1 to n - 1 words has one gram, of all its words."""
    count = np.diff(w.first)
    per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(per)), per)
    begin = np.zeros(len(per) + 1, np.int64)
    np.cumsum(per, out=begin[1:])
    start = w.first[:-1][text] + (np.arange(len(text)) - begin[:-1][text])
    return spans_hash(w.hash, start, start + np.minimum(count[text], n)), text
