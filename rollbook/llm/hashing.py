"""Vectorised hashing of the words of a batch of texts, shared by the linear models."""

from __future__ import annotations

import numpy as np

#: Lower-cased ASCII letters, digits and bytes from 0x80 on are parts of words; all else separates them.
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
PART = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 0x80 for b in range(256)])
ODD = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.cumprod(np.full(4096, 0xD1342543DE82EF95, np.uint64), dtype=np.uint64)
VALUES = np.random.default_rng(97).integers(1, 1 << 63, 256, dtype=np.uint64)


def stirred(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and where each text's words begin (one more at the end)."""
    codes = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    inside = PART[codes]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    bounds = np.concatenate(([0], np.searchsorted(starts, text_ends)))
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    at = np.flatnonzero(inside)
    place = at - np.repeat(starts, ends - starts)
    with np.errstate(over="ignore"):
        terms = VALUES[LOWERED[codes[at]]] * POWERS[place % len(POWERS)]
        first = np.concatenate(([0], np.cumsum(ends - starts)[:-1]))
        return stirred(np.add.reduceat(terms, first)), bounds


def grams(words: np.ndarray, bits: int) -> np.ndarray:
    """Distinct hashed features of one text's words: words, pairs, and pairs that skip one word; sorted, 0 to 2**bits - 1."""
    with np.errstate(over="ignore"):
        pairs = stirred(words[:-1] * ODD + words[1:])
        skips = stirred(words[:-2] * ODD + words[2:] * np.uint64(3))
    return np.unique(np.concatenate((words, pairs, skips)) >> np.uint64(64 - bits)).astype(np.int64)
