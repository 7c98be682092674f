"""Token ids through a table of pieces: each distinct piece goes through the tokenizers library once.

Both kinds of vocabulary used here cut a text before they merge, and at the boundaries between runs of spaces, letters,
digits and punctuation they always do. numpy finds these boundaries in a whole column at once, Arrow numbers the distinct
pieces, those seen before and those that are new, and the new ones are encoded: a run of ASCII characters of one kind by
the library's model, any other piece by all of the library. Then numpy lays the pieces' ids out. Apostrophes
and bytes beyond ASCII stay with what is beside them, as contractions and letters with marks are cut by other rules. A text
where cutting is not safe (special strings, other white space) goes to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

SPACE, LETTER, DIGIT, MARK, GLUE = range(5)
KIND = np.array([GLUE if b >= 0x80 or b == 0x27 else SPACE if b == 0x20 or 9 <= b <= 13 else DIGIT if 48 <= b <= 57 else LETTER if chr(b).isalpha() else MARK for b in range(256)], np.uint8)
#: First bytes of, and then whole, white space that not all libraries agree on.
ODD_FIRST = np.isin(np.arange(256), [*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3])
ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8d\xa8\xa9\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80")
#: Letters of the Latin blocks (but for one whose lower case is two characters), then punctuation that no rule joins.
PLAIN = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@\\[-`{-~]*)")
#: Bytes of a column that are worked on at a time, whatever Arrow's batch size is.
BLOCK = 8 << 20
#: Pieces of which places are laid out at a time.
LAID = 1 << 20
_open: dict[tuple[str, str], Encoder] = {}


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones themselves, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where pieces of the texts in data begin; starts are those of the texts, the first 0.

    A single space stands before its word. Of a run of white space the last character is apart from the others.
    """
    kind = KIND[data]
    cut = np.empty(len(data), bool)
    a, b = kind[:-1], kind[1:]
    np.not_equal(a, b, out=cut[1:])
    cut[1:] &= (a != GLUE) & (b != GLUE)
    gap = kind == SPACE
    if (kind == GLUE).any():
        cut[1:] |= (a == GLUE) & gap[1:]
    after = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    cut[after] = data[after - 1] != 0x20
    double = np.flatnonzero(gap[:-1] & gap[1:]) + 1
    if len(double):
        last = np.append(~gap[1:], False)
        last[starts[1:] - 1] = False  # a run at the end of a text is one piece
        cut[double] = last[double]
    cut[starts] = True
    return np.flatnonzero(cut)


class Encoder:
    """kind "words": white space is dropped, pieces are words. kind "bytes": a piece keeps its leading space.

    most_pieces bounds the table; beyond it, the half that was met least often lately is forgotten.
    """

    def __init__(self, path: str, kind: str, most_pieces: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.words, self.most = Tokenizer.from_file(path), kind == "words", most_pieces
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.letters, self.tokenize = byte_letters(), self.library.model.tokenize
        self.shown = {b: c for b, c in self.letters.items() if b < 0x80 and c != chr(b)}
        self.known = pa.array([], pa.binary())
        self.sizes, self.starts, self.met = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def by_model(self, text: str) -> list[int]:
        """Ids of one piece that the library would not cut, by its model."""
        shown = text.translate(self.shown) if text.isascii() else "".join([self.letters[b] for b in text.encode()])
        return [t.id for t in self.tokenize(shown)]

    def by_kind(self, piece: str) -> list[int] | None:
        """Ids of an ASCII run of one kind, or of Latin letters with punctuation; None for any other piece."""
        if piece.isascii() and "'" not in piece:
            if not self.words:
                return self.by_model(piece)
            piece = piece.strip(" \t\n\r\v\f")
            return [i for d in piece for i in self.by_model(d)] if piece.isdigit() else self.by_model(piece.lower()) if piece else []
        if m := PLAIN.fullmatch(piece):
            lead, stem, tail = m.groups()
            return self.by_model(stem.lower() if self.words else lead + stem) + (self.by_model(tail) if tail else [])
        return None

    def learn(self, pieces: list[bytes]) -> None:
        """Adds new pieces and their ids to the table."""
        ids = [self.by_kind(p.decode()) for p in pieces]
        rest = [i for i, x in enumerate(ids) if x is None]
        for a in range(0, len(rest), 4096):
            at = rest[a : a + 4096]
            for i, x in zip(at, self.whole([pieces[i].decode() for i in at]), strict=True):
                ids[i] = x
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), "<u4", int(sizes.sum()))
        self.starts = np.concatenate((self.starts, len(self.pool) + np.cumsum(sizes, dtype=np.int64) - sizes))
        self.sizes, self.pool = np.concatenate((self.sizes, sizes)), np.concatenate((self.pool, flat))
        self.met = np.concatenate((self.met, np.zeros(len(pieces), np.int64)))

    def forget(self) -> None:
        """Keeps the half of the table that was met most, if it is over its bound."""
        if len(self.known) <= self.most:
            return
        keep = np.sort(np.argsort(-self.met, kind="stable")[: self.most // 2])
        self.known, self.met = self.known.take(pa.array(keep)), self.met[keep] // 2
        sizes, starts = self.sizes[keep], self.starts[keep]
        self.pool = self.pool[spread(starts, sizes)]
        self.sizes, self.starts = sizes, np.cumsum(sizes, dtype=np.int64) - sizes

    def cut_ids(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in data, and where each text's begin."""
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(starts), np.int64)
        full = starts[np.append(starts[1:], len(data)) > starts]  # of the texts with a character
        at = cuts(data, full)
        offsets = np.append(at, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = pa.chunked_array([self.known, pieces]).dictionary_encode().chunks[-1]
        code, old = coded.indices.to_numpy(), len(self.known)
        if len(coded.dictionary) > old:
            self.learn(coded.dictionary[old:].to_pylist())
            self.known = coded.dictionary
        sizes = self.sizes[code]
        after = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        out = np.empty(int(after[-1]), "<u4")
        for a in range(0, len(code), LAID):
            b = min(len(code), a + LAID)
            out[after[a] : after[b]] = self.pool[spread(self.starts[code[a:b]], sizes[a:b])]
        self.met += np.bincount(code, minlength=len(self.met))
        self.forget()
        return out, after[np.searchsorted(at, starts)]

    def unsafe(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Numbers of the texts that must not be cut."""
        raw = data.tobytes()
        found = [m.start() for s in self.special if s in raw for m in re.finditer(re.escape(s), raw)]
        if ODD_FIRST[data].any():
            found += [m.start() for m in ODD.finditer(raw)]
        return np.unique(np.searchsorted(starts, np.array(found, np.int64), "right") - 1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column, one text after the other, and where each text's begin (one more at the end); null is empty."""
        if texts.null_count:
            texts = texts.fill_null("")
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        starts = offsets[:-1] - offsets[0]
        odd = self.unsafe(data, starts) if len(data) else []
        if not len(odd):
            ids, begin = self.cut_ids(data, starts)
            return ids, np.append(begin, len(ids))
        parts, sizes, done = [], [], 0
        for k in [*odd.tolist(), len(starts)]:
            end = starts[k] if k < len(starts) else len(data)
            if k > done:
                ids, begin = self.cut_ids(data[starts[done] : end], starts[done:k] - starts[done])
                parts.append(ids)
                sizes.append(np.diff(np.append(begin, len(ids))))
            if k < len(starts):
                own = np.array(self.whole([texts[k].as_py()])[0], "<u4")
                parts.append(own)
                sizes.append(np.array([len(own)]))
            done = k + 1
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ... (sizes[0] of them), then those from starts[1] on, and so on."""
    after = np.cumsum(sizes, dtype=np.int64)
    total = int(after[-1]) if len(after) else 0
    return np.repeat(starts - (after - sizes), sizes) + np.arange(total)


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a string column of about size bytes each."""
    ends = np.cumsum(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield a, b
        a = b


def encoder(path: str, kind: str) -> Encoder:
    """The worker process's encoder for a vocabulary file; its table serves all tasks of the process."""
    if (path, kind) not in _open:
        _open[path, kind] = Encoder(path, kind)
    return _open[path, kind]
