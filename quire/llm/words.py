"""Words and shingles of many texts at once, on their UTF-8 bytes, with numpy.

A word is a maximal run of bytes other than space, tab, newline, vertical tab, form feed and carriage return, with A-Z
in lower case; no byte of a longer UTF-8 character is one of these, so words are the same on characters.
Words are known by 64-bit hashes: a polynomial over the bytes modulo 2**64, mixed.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


class Words(NamedTuple):
    """Of each word: hash, first byte, end, document; and where each document's words begin (one entry more)."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of them."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        made = []
        for base in (_BASE, inverse):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = made
    return _powers[0], _powers[1]


def words(data: np.ndarray, at: np.ndarray, gap: np.ndarray = _SPACE, heads: tuple[int, ...] = ()) -> Words | tuple[Words, list[np.ndarray]]:
    """The words of the texts that lie one after the other in ``data``, text i from at[i] to at[i+1].

    ``gap`` tells of each byte whether it parts words. With ``heads`` also the hashes of each word's first so many
    bytes (of the whole word, if it is shorter).
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        nothing = Words(np.zeros(0, np.uint64), none, none, none, np.zeros(len(at), np.int64))
        return (nothing, [np.zeros(0, np.uint64) for _ in heads]) if heads else nothing
    solid = ~gap[data]
    fresh = np.zeros(n + 1, bool)
    fresh[at] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | fresh[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | fresh[1:])) + 1
    power, inverse = _tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    hashed = mix((total[end] - total[start]) * inverse[start])
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    found = Words(hashed, start, end, doc, first)
    if not heads:
        return found
    return found, [mix((total[np.minimum(start + k, end)] - total[start]) * inverse[start] + np.uint64(k)) for k in heads]


def word_hash(word: str) -> int:
    """The hash that ``words`` gives this word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(words(raw, np.array([0, len(raw)])).hash[0])


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``size`` words, where each document's begin); a shorter document is one shingle, one without words none."""
    count = np.diff(w.first)
    parts = np.where(count == 0, 0, np.maximum(count - size + 1, 1))
    first = np.concatenate(([0], np.cumsum(parts)))
    total = int(first[-1])
    if total == 0:
        return np.zeros(0, np.uint64), first
    source = np.repeat(w.first[:-1] - first[:-1], parts) + np.arange(total)  # the shingle's first word
    left = np.repeat(w.first[1:], parts) - source  # words from there to the end of the document
    out = np.full(total, size, np.uint64)
    padded = np.concatenate((w.hash, np.zeros(size, np.uint64)))
    for k in range(size):
        out = mix(out * np.uint64(_BASE) + np.where(left > k, padded[source + k], np.uint64(k + 1)))
    return out, first
