"""Cross-tokenizer alignment (operator 12): which ids of two vocabularies stand for the same bytes, and how often.

Both tokenizers see the same bytes. Where a token of A and one of B end at the same byte, a group ends; every token of A in
a group is linked with every one of B. A pair of linked ids is one int64, the A id in its upper half. Each document's distinct
pairs are stored as its digest is made, so that texts are encoded once. Counts: np.unique over many documents at a
time within a partition, a range-partitioned global sort of these partial counts, and run-length sums, written as
shards of sorted keys and of their counts. Lookups map the shards into memory and search them by bisection.

Every row is a document of its own, repeated ones too; keys may be null and of any type that Arrow writes. Null and
empty texts, and texts that a tokenizer's tokens do not give back byte by byte, have no tokens: zeros and an empty digest. An
empty table gives an empty result. Columns other than key and text are not read. A text of any length is one piece of
work; its groups, which end at nearly every word, bound what is paired at a time.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import fresh_path, passing, stored, trim
from rollbook.llm.tokens import Encoder, blocks, spread

#: Texts that are encoded and aligned at a time.
BLOCK = 2 << 20
#: Keys that are counted at a time, and distinct ones that a partition holds.
COUNTED, HELD = 4 << 20, 4 << 20
#: Groups with more pairs are paired by their distinct ids.
WIDE = 1 << 12
#: Ids up to this are sorted together with their document as one int64.
SHORT = (1 << 20) - 1
#: Pairs of documents that are looked up at a time.
ASKED = 1 << 21
DIGEST = ("n_a", "n_b", "n_groups", "n_links")


@cache
def byte_side(path: str) -> tuple[Encoder, list[bytes]]:
    """Encoder of a byte-level vocabulary, to which special strings are text, and each id's bytes."""
    a = Encoder(path, "bytes")
    a.library.encode_special_tokens = True
    back = {c: b for b, c in a.letters.items()}
    special = a.library.get_added_tokens_decoder()
    names = [a.library.id_to_token(i) or "" for i in range(a.library.get_vocab_size())]
    return a, [t.encode() if i in special else bytes(back[c] for c in t) for i, t in enumerate(names)]


@cache
def piece_side(path: str):
    """Model of pieces with byte fallback, and each id's bytes."""
    import sentencepiece

    b = sentencepiece.SentencePieceProcessor(model_file=path)
    return b, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.vocab_size())]


class Bytes:
    """Ids as the bytes that they stand for, and as decimal text."""

    def __init__(self, table: list[bytes], within: str, last: str) -> None:
        self.sizes = np.fromiter(map(len, table), np.int64, len(table))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(table), np.uint8)
        self.said = [f"{i}{end}".encode() for end in (within, last) for i in range(len(table))]

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[spread(self.starts[ids], self.sizes[ids])]


@cache
def sides(path_a: str, path_b: str) -> tuple[Bytes, Bytes]:
    return Bytes(byte_side(path_a)[1], ",", "|"), Bytes(piece_side(path_b)[1], ",", ";")


@dataclass
class Aligned:
    """Digest columns of some texts; pairs of all of them with their times, and where each text's begin."""

    counts: dict[str, np.ndarray]
    sha256: list[str]
    keys: np.ndarray
    times: np.ndarray
    begins: np.ndarray


def faithful(side: Bytes, ids: np.ndarray, begin: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Which texts their ids give back byte by byte."""
    spelled = side.spelled(ids)
    data = np.frombuffer(b"".join(raw), np.uint8)
    after = np.concatenate(([0], np.cumsum(side.sizes[ids])))[begin]
    due = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))))
    if np.array_equal(after, due) and np.array_equal(spelled, data):
        return np.ones(len(raw), bool)
    return np.array([spelled[after[i] : after[i + 1]].tobytes() == x for i, x in enumerate(raw)], bool)


def chosen(ids: np.ndarray, begin: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the kept texts, the others being without any."""
    sizes = np.where(keep, np.diff(begin), 0)
    return ids[np.repeat(keep, np.diff(begin))].astype(np.int64), np.concatenate(([0], np.cumsum(sizes)))


def linked(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, times) of each document's distinct linked pairs, in this order; groups have na and nb tokens."""
    sa, sb, n = np.cumsum(na) - na, np.cumsum(nb) - nb, na * nb
    small = np.flatnonzero(n <= WIDE)
    group = np.repeat(small, n[small])
    at = spread(np.zeros(len(small), np.int64), n[small])
    wide = np.maximum(nb[group], 1)
    docs, keys, times = [doc[group]], [a[sa[group] + at // wide] << 32 | b[sb[group] + at % wide]], [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(n > WIDE):
        ua, ca = np.unique(a[sa[g] : sa[g] + na[g]], return_counts=True)
        ub, cb = np.unique(b[sb[g] : sb[g] + nb[g]], return_counts=True)
        keys.append((ua[:, None] << 32 | ub).ravel())
        times.append((ca[:, None] * cb).ravel())
        docs.append(np.full(len(keys[-1]), doc[g]))
    d, k, t = np.concatenate(docs), np.concatenate(keys), np.concatenate(times)
    short = max(d.max(initial=0) >> 3, (k >> 32).max(initial=0), (k & 0xFFFFFFFF).max(initial=0)) <= SHORT
    order = np.argsort(d << 40 | k >> 32 << 20 | k & SHORT, kind="stable") if short else np.lexsort((k, d))
    d, k, t = d[order], k[order], t[order]
    first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])))) if len(k) else np.zeros(0, np.int64)
    return d[first], k[first], np.add.reduceat(t, first) if len(first) else t


def digests(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, side_a: Bytes, side_b: Bytes, ends: np.ndarray) -> list[str]:
    """SHA-256 of each text's groups, written out; ends: each text's tokens of both sides, summed up."""
    after_a, after_b = np.cumsum(na), np.cumsum(nb)
    place_a = np.arange(len(a)) + np.repeat(after_b - nb, na)
    place_b = np.arange(len(b)) + np.repeat(after_a, nb)
    code_a, code_b = a.copy(), b.copy()
    code_a[after_a - 1] += len(side_a.sizes)
    code_b[after_b - 1] += len(side_b.sizes)
    said = np.empty(len(a) + len(b), np.int64)
    said[place_a], said[place_b] = code_a, code_b + 2 * len(side_a.sizes)
    words = side_a.said + side_b.said
    out, start = [], 0
    for end in ends.tolist():
        out.append(hashlib.sha256(b"".join(map(words.__getitem__, said[start:end].tolist()))[:-1]).hexdigest() if end > start else "")
        start = end
    return out


def align(texts: pa.Array, path_a: str, path_b: str) -> Aligned:
    """Aligns a column of texts as one run of bytes: each text's end is an end on both sides."""
    texts = texts.cast(pa.large_string()).fill_null("")
    encode, model = byte_side(path_a)[0].encode, piece_side(path_b)[0]
    side_a, side_b = sides(path_a, path_b)
    raw = [b" " + x for x in texts.cast(pa.large_binary()).to_pylist()]
    ids_a, begin_a = encode(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
    listed = model.encode(texts.to_pylist(), num_threads=1)
    begin_b = np.concatenate(([0], np.cumsum(np.fromiter(map(len, listed), np.int64, len(listed)))))
    ids_b = np.fromiter(chain.from_iterable(listed), np.int64, int(begin_b[-1]))
    keep = np.array([len(x) > 1 for x in raw], bool)
    keep &= faithful(side_a, ids_a, begin_a, raw) & faithful(side_b, ids_b, begin_b, raw)
    (a, begin_a), (b, begin_b) = chosen(ids_a, begin_a, keep), chosen(ids_b, begin_b, keep)
    ends_a, ends_b = np.cumsum(side_a.sizes[a]), np.cumsum(side_b.sizes[b])
    total = int(ends_a[-1]) if len(a) else 0
    mark_a, mark_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    mark_a[ends_a], mark_b[ends_b] = True, True
    cut_a, cut_b = np.flatnonzero(mark_b[ends_a]), np.flatnonzero(mark_a[ends_b])
    na, nb = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    doc = np.searchsorted(begin_a, cut_a, "right") - 1
    n = len(raw)
    counts = {"n_a": np.diff(begin_a), "n_b": np.diff(begin_b), "n_groups": np.bincount(doc, minlength=n), "n_links": np.zeros(n, np.int64)}
    np.add.at(counts["n_links"], doc, na * nb)
    d, keys, times = linked(a, b, na, nb, doc)
    return Aligned(counts, digests(a, b, na, nb, side_a, side_b, begin_a[1:] + begin_b[1:]), keys, times, np.searchsorted(d, np.arange(n + 1)))


def binaries(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """The bytes of values from each begin to the next, a row each."""
    return pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer((begins * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every document; the scan's partitions are kept."""
    schema = T.StructType([docs.schema[key], *(T.StructField(c, T.LongType()) for c in DIGEST), T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.BinaryType()), T.StructField("times", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for x, y in blocks(texts, BLOCK):
                got = align(texts.slice(x, y - x), path_a, path_b)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), *(pa.array(got.counts[c], pa.int64()) for c in DIGEST), pa.array(got.sha256), binaries(got.keys, got.begins), binaries(got.times.astype("<u4"), got.begins)], names=schema.names)
        trim()

    return docs.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, schema)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    return run_lengths(keys[order], counts[order])


def run_lengths(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def partial_counts(aligned: DataFrame) -> DataFrame:
    """(key, n): in how many of a partition's documents each pair is linked; a key may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        buffer, size = [], 0

        def rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

        for batch in batches:
            for p in batch.column(0).to_pylist():
                buffer.append(np.frombuffer(p, "<i8"))
                size += len(buffer[-1])
                if size >= COUNTED:
                    keys, n = np.unique(np.concatenate(buffer), return_counts=True)
                    held, sums = added(np.concatenate((held, keys)), np.concatenate((sums, n)))
                    buffer, size = [], 0
                    if len(held) >= HELD:
                        yield rows(held, sums)
                        held, sums = held[:0], sums[:0]
        if buffer:
            keys, n = np.unique(np.concatenate(buffer), return_counts=True)
            held, sums = added(np.concatenate((held, keys)), np.concatenate((sums, n)))
        yield rows(held, sums)
        trim()

    return aligned.select("pairs").mapInArrow(run, "key long, n long")


@dataclass
class Counts:
    """Sorted shards of keys and counts in the shared folder, in ascending order, and each A id's highest count."""

    folder: str
    names: list[str]
    firsts: np.ndarray
    highest: np.ndarray

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys that are in the shards."""
        out = np.zeros(len(keys), np.int64)
        cut = np.concatenate((np.searchsorted(keys, self.firsts), [len(keys)]))
        for name, x, y in zip(self.names, cut, cut[1:], strict=False):
            if y > x:
                there, counts = mapped(f"{self.folder}/{name}.keys"), mapped(f"{self.folder}/{name}.counts")
                out[x:y] = counts[np.searchsorted(there, keys[x:y])]
        return out


@cache
def mapped(uri: str) -> np.ndarray:
    """A file of int64 mapped into memory; one that no local path reaches is copied first, to a file that has no name any more."""
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, "<i8", "r")
    with tempfile.NamedTemporaryFile() as f, store.open_input_stream(path) as source:
        while chunk := source.read(8 << 20):
            f.write(chunk)
        f.flush()
        return np.memmap(f.name, "<i8", "r")


def sorted_counts(partial: DataFrame, vocabulary_a: int) -> Counts:
    """The partial counts sorted over all partitions, summed by runs, and written as shards.

    A shard holds the runs of one range of keys, of which none is in two. To the driver comes a line for each shard, with
    the highest counts of the A ids in it: of these there are as many as the vocabulary has, and two halves for each cut.
    """
    spark = partial.sparkSession
    folder = fresh_path(spark, "pair-counts")
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    passing(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        last_key, last_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, highest = None, {}
        with store.open_output_stream(f"{root}/{name}.keys") as keys_out, store.open_output_stream(f"{root}/{name}.counts") as counts_out:

            def write(keys: np.ndarray, n: np.ndarray) -> None:
                if len(keys):
                    keys_out.write(keys.tobytes())
                    counts_out.write(n.tobytes())
                    ids, at = np.unique(keys >> 32, return_index=True)
                    for i, most in zip(ids.tolist(), np.maximum.reduceat(n, at).tolist(), strict=True):
                        highest[i] = max(most, highest.get(i, 0))

            for batch in batches:
                if batch.num_rows:
                    keys, n = run_lengths(np.concatenate((last_key, batch.column(0).to_numpy())), np.concatenate((last_n, batch.column(1).to_numpy())))
                    first = int(keys[0]) if first is None else first
                    write(keys[:-1], n[:-1])
                    last_key, last_n = keys[-1:], n[-1:]  # its run may go on
            write(last_key, last_n)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([np.array(list(highest), "<i8").tobytes()]), pa.array([np.array(list(highest.values()), "<i8").tobytes()])], names=["name", "first", "ids", "most"])
        trim()

    made = stored(partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "name string, first long, ids binary, most binary"), "pair-shards")
    highest = np.zeros(vocabulary_a, np.int64)
    names, firsts = [], []
    for r in made.orderBy("first").collect():
        names.append(r["name"])
        firsts.append(r["first"])
        np.maximum.at(highest, np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["most"], "<i8"))
    return Counts(folder, names, np.array(firsts, np.int64), highest)


def with_counts(aligned: DataFrame, counts: Counts, key: str) -> DataFrame:
    """Each document's digest with n_best and count_sum, by lookups of its pairs."""
    schema = T.StructType([aligned.schema[key], *(T.StructField(c, T.LongType()) for c in (*DIGEST, "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, sums = [], []
            pairs, times = batch.column("pairs"), batch.column("times")
            for x, y in blocks(pairs, 8 * ASKED):
                sizes = np.array([len(p) // 8 for p in pairs.slice(x, y - x).to_pylist()], np.int64)
                keys = np.frombuffer(b"".join(pairs.slice(x, y - x).to_pylist()), "<i8")
                t = np.frombuffer(b"".join(times.slice(x, y - x).to_pylist()), "<u4").astype(np.int64)
                distinct, at = np.unique(keys, return_inverse=True)
                n = counts.of(distinct)[at]
                after = np.concatenate(([0], np.cumsum(sizes)))
                for values, out in ((t * (n == counts.highest[keys >> 32]), best), (t * n, sums)):
                    out += np.diff(np.concatenate(([0], np.cumsum(values)))[after]).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(key), *(batch.column(c) for c in DIGEST), pa.array(best, pa.int64()), pa.array(sums, pa.int64()), batch.column("groups_sha256")], names=schema.names)
        trim()

    return aligned.mapInArrow(run, schema)


def align_corpus(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: tokens, groups, links, and how its links' pairs stand in the corpus.

    path_a: a byte-level vocabulary of the tokenizers library; path_b: a sentencepiece model that puts a space before a
    text. Columns n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 follow the key.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    aligned = stored(aligned_documents(docs, path_a, path_b, key, text), "aligned")
    counts = sorted_counts(stored(partial_counts(aligned), "pair-counts"), len(byte_side(path_a)[1]))
    return with_counts(aligned, counts, key)
