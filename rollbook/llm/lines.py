"""Counts of words and lines over a slice of texts at once, in numpy and Arrow; the rules of operator 5 rest on them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from rollbook.llm.common import SPACE

FEATURES = ("bias", "symbols", "capitals", "breaks", "digits", "few words", "seen before", "ends as a sentence", "long words", "stutter", "first", "last", "words")


def marked(members: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(members))


IS_SPACE, SYMBOL, BREAK = marked(SPACE), marked(b"#*$%&|<>"), marked(b"!|{}[]\\~^_=@")
LOWER, UPPER, DIGIT, CONTINUATION, STOP = marked(bytes(range(97, 123))), marked(bytes(range(65, 91))), marked(bytes(range(48, 58))), marked(bytes(range(0x80, 0xC0))), marked(b".?:")


@dataclass
class Measured:
    """counts[text]: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. A row of x, sizes and places for each line
    with a word: FEATURES, bytes in words, begin and end in the joined texts; bounds[text]: its first line (one more at the end)."""

    counts: np.ndarray
    x: np.ndarray
    sizes: np.ndarray
    places: np.ndarray
    bounds: np.ndarray


def twice(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an entry's code occurs earlier, and whether it occurs later, with the same owner; owners ascend."""
    order = np.argsort(code, kind="stable")
    same = (code[order[1:]] == code[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    earlier, later = np.zeros(len(code), bool), np.zeros(len(code), bool)
    earlier[order[1:]] = same
    later[order[:-1]] = same
    return earlier, later


def coded(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers of the strings that lie between offsets in data: equal strings have equal numbers."""
    if len(offsets) < 2:
        return np.zeros(0, np.int64)
    strings = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return strings.dictionary_encode().indices.to_numpy().astype(np.int64)


def measured(texts: list[bytes]) -> Measured:
    """All counts and line features of a slice of texts."""
    data = np.frombuffer(b"".join([t + b"\n" for t in texts]), np.uint8)
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    gap, new_line = IS_SPACE[data], data == 10
    line_ends = np.flatnonzero(new_line)
    line_starts = np.concatenate(([0], line_ends + 1))[: len(line_ends)]
    text_of_line = np.searchsorted(text_ends, line_starts, "right")

    def by_line(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[line_ends] - total[line_starts]

    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]  # the data end in a line break, so every word ends
    line_of_word = np.searchsorted(line_ends, starts)
    text_of_word = text_of_line[line_of_word]
    word = coded(data[~gap], np.concatenate(([0], np.cumsum(ends - starts))))
    covered = np.zeros(len(word), bool)
    if len(word) > 2:
        distinct = int(word.max()) + 1
        pair = word[:-1] * distinct + word[1:]
        if distinct >= 1 << 21:  # three numbers do not fit in 63 bits
            pair = np.unique(pair, return_inverse=True)[1]
        inside = text_of_word[:-2] == text_of_word[2:]
        window, owner = (pair[:-1] * distinct + word[2:])[inside], text_of_word[:-2][inside]
        earlier, later = twice(window, owner)
        at = np.flatnonzero(inside)[earlier | later]
        for k in range(3):
            covered[at + k] = True
    words = np.bincount(line_of_word, minlength=len(line_starts))
    line = coded(data, np.append(line_starts, len(data)))
    seen = twice(line, text_of_line)[0]
    solid, symbols, up, low = by_line(~gap), by_line(SYMBOL[data]), by_line(UPPER[data]), by_line(LOWER[data])
    chars = solid - by_line(CONTINUATION[data])

    n = len(texts)
    per_text = lambda weights: np.bincount(text_of_line, weights, n).astype(np.int64)
    counts = np.stack([per_text(words), per_text(chars), per_text(symbols), per_text(seen & (words > 0)), np.bincount(text_of_word, covered, n).astype(np.int64)], 1)

    has = np.flatnonzero(words)
    same = (word[1:] == word[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    stutter = np.bincount(line_of_word[1:], same, len(line_starts))[has] if len(word) else np.zeros(0)
    closing = STOP[data[ends[np.cumsum(words)[has] - 1] - 1]]
    of, k, size = text_of_line[has], words[has], solid[has].astype(np.float64)
    bounds = np.searchsorted(of, np.arange(n + 1))
    first, last = np.zeros(len(has), bool), np.zeros(len(has), bool)
    full = bounds[1:] > bounds[:-1]
    first[bounds[:-1][full]] = last[bounds[1:][full] - 1] = True
    x = np.stack([np.ones(len(has)), symbols[has] / size, up[has] / np.maximum(1, up[has] + low[has]), by_line(BREAK[data])[has] / size, by_line(DIGIT[data])[has] / size, k < 3, seen[has], closing, np.minimum(1.0, size / k / 40), stutter / k, first, last, np.log2(1 + k) / 8], 1).astype(np.float32)
    return Measured(counts, x, size.astype(np.int64), np.stack([line_starts[has], line_ends[has]], 1), bounds)
