"""Language-model scoring (operator 2): prediction by partial matching over bytes, beside a smoothed word unigram.

Every run of up to ORDER bytes that occurs in a training text is a context; none is left out, so the model grows with the
corpus and nowhere lies in one piece. At a context with total T and D distinct symbols the escape is D / (T + D), and a
shorter context leaves out all symbols of the longer one (symbol exclusion). A context's symbols are among those of its
suffix, so what a context passes down are three numbers: T, D, and X, the total that its suffix gives to its symbols. The
probability of a byte thus depends on the gram of ORDER bytes and itself, and on counts of its suffixes.

A scan lists each partition's distinct grams and words with their counts in training texts. The grams' counts are summed
over partitions; grams with the same last bytes of context, whose whole subtree of the trie is then in one place, get
their probabilities; these and the words' counts are joined back to the partitions that asked and written as a small
dictionary for each. A second scan, cut into the same partitions, adds up what its dictionary says.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import SPACE, crc_remainder, fresh_path, passing, raw_texts, slices, stored, trim

ORDER = 5
#: Contexts of so many bytes and fewer are known everywhere: at most 256**3 grams; longer ones by these last bytes.
NEAR = 2
#: Bytes of texts laid out at a time: a few dozen bytes of numbers stand for each.
BLOCK = 2 << 20
END = b""  # the token that ends a text; the byte is 0
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
IS_SPACE = np.isin(np.arange(256), list(SPACE))


@dataclass
class Laid:
    """A slice of texts: the grams of every byte and end, with the text's bounds in them; the words, with theirs."""

    grams: np.ndarray
    gram_bounds: np.ndarray
    words: pa.Array
    word_bounds: np.ndarray


def laid_out(texts: list[bytes], order: int = ORDER) -> Laid:
    """Grams are order + 1 bytes as a number, the last byte lowest; a text starts after order zeros and has one at its end."""
    data = LOWERED[np.frombuffer(b"".join([bytes(order) + t + b"\0" for t in texts]), np.uint8)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes + order + 1) - (sizes + order + 1)
    grams = np.zeros(max(0, len(data) - order), np.int64)
    for i in range(order + 1):
        grams <<= 8
        grams |= data[i : i + len(grams)]
    inside = np.ones(len(grams), bool)
    inside[(begin[1:, None] - np.arange(1, order + 1)).ravel()] = False  # these reach over into the next text
    own = np.ones(len(data), bool)
    own[(begin[:, None] + np.arange(order)).ravel()] = False
    own[begin + sizes + order] = False
    gap = IS_SPACE[data] | ~own
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap])]).cast(pa.binary())
    return Laid(grams[inside], np.concatenate(([0], np.cumsum(sizes + 1))), words, np.append(np.searchsorted(starts, begin), len(starts)))


class Tally:
    """Distinct values met so far and how often each was counted.

    Each slice is numbered by itself; slices are merged when they hold as many distinct values as there are already, so
    that the whole table is hashed a few times only.
    """

    LEAST = 1 << 18

    def __init__(self, kind: pa.DataType) -> None:
        self.values, self.counts = pa.array([], kind), np.zeros(0, np.int64)
        self.later: list[tuple[pa.Array, np.ndarray]] = []

    def add(self, values: pa.Array, counted: np.ndarray) -> None:
        """Takes in all values; counted tells which of them count."""
        if not len(values):
            return
        coded = values.dictionary_encode()
        self.later.append((coded.dictionary, np.bincount(coded.indices.to_numpy(), counted, len(coded.dictionary)).astype(np.int64)))
        if sum(len(d) for d, _ in self.later) >= max(self.LEAST, len(self.values)):
            self.merge()

    def merge(self) -> None:
        parts = [x for x in [(self.values, self.counts), *self.later] if len(x[0])]
        if parts:
            coded = pa.chunked_array([d for d, _ in parts]).dictionary_encode()
            self.values, self.later = coded.chunk(0).dictionary, []
            self.counts = np.zeros(len(self.values), np.int64)
            for chunk, (_, n) in zip(coded.chunks, parts, strict=True):
                self.counts[chunk.indices.to_numpy()] += n  # a part has each value once


def subtables(grams: np.ndarray, counts: np.ndarray, low: int, high: int, below: tuple | None) -> list[tuple]:
    """For contexts of low to high bytes: (context and symbol), their count, contexts, T, D, X by context; all sorted.

    grams end in the contexts' last bytes and the symbol; below is the table of contexts one byte shorter than low.
    """
    out = [] if below is None else [below]
    for k in range(low, high + 1):
        pairs, at = np.unique(grams & ((1 << (8 * (k + 1))) - 1), return_inverse=True)
        n = np.bincount(at, counts, len(pairs))
        contexts, of, distinct = np.unique(pairs >> 8, return_inverse=True, return_counts=True)
        x = np.zeros(len(contexts))
        if out:
            x = np.bincount(of, out[-1][1][np.searchsorted(out[-1][0], pairs & ((1 << (8 * k)) - 1))], len(contexts))
        out.append((pairs, n, contexts, np.bincount(of, n, len(contexts)), distinct.astype(float), x))
    return out if below is None else out[1:]


def places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where wanted stand in sorted keys, -1 for those that don't."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def log10_chances(grams: np.ndarray, tables: list[tuple]) -> np.ndarray:
    """log10 of the probability of each gram's last byte after the others; tables: of contexts of 0 bytes, 1 byte, and so on."""
    p, found = np.ones(len(grams)), np.zeros(len(grams), bool)
    left_d, left_x = np.zeros(len(grams)), np.zeros(len(grams))  # symbols of the longer context, and their total here
    for k in range(len(tables) - 1, -1, -1):
        pairs, n, contexts, total, distinct, x = tables[k]
        key = grams & ((1 << (8 * (k + 1))) - 1)
        at, hit = places(contexts, key >> 8), places(pairs, key)
        if not len(contexts):
            continue
        known = at >= 0
        t, d = np.where(known, total[at] - left_x, 0.0), np.where(known, distinct[at] - left_d, 0.0)
        here = (hit >= 0) & ~found
        p[here] *= n[hit[here]] / (t[here] + d[here])
        found |= here
        escaped = ~found & (d > 0)
        p[escaped] *= d[escaped] / (t[escaped] + d[escaped])
        left_d, left_x = np.where(known, distinct[at], 0.0), np.where(known, x[at], 0.0)
    met = tables[0][4][0] if len(tables[0][4]) else 0
    p[~found] /= max(1, 256 - met)
    return np.log10(np.maximum(p, 1e-300))


def listed(docs: DataFrame, order: int) -> DataFrame:
    """part, token or gram, n: the distinct words and grams of each partition of docs (train, text), counted in training texts.

    A row of neither has the number of training texts as n, and a partition's first row as token tells it apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ends = TaskContext.get().partitionId(), 0
        words, grams = Tally(pa.binary()), Tally(pa.int64())
        for batch in batches:
            texts, learned = raw_texts(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in slices(texts, BLOCK):
                laid, train = laid_out(texts[a:b], order), learned[a:b]
                ends += int(train.sum())
                words.add(laid.words, np.repeat(train, np.diff(laid.word_bounds)))
                grams.add(pa.array(laid.grams), np.repeat(train, np.diff(laid.gram_bounds)))
        words.add(pa.array([END], pa.binary()), np.array([ends]))
        words.merge()
        grams.merge()
        order_of = np.argsort(grams.values.to_numpy())
        made = ((words.values, pa.nulls(len(words.values), pa.int64()), words.counts), (None, grams.values.take(pa.array(order_of)), grams.counts[order_of]))
        for tokens, numbers, counts in made:
            for a in range(0, len(counts), 100_000):
                n = min(100_000, len(counts) - a)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.nulls(n, pa.binary()) if tokens is None else tokens.slice(a, n), numbers.slice(a, n), pa.array(counts[a : a + n])], names=["part", "token", "gram", "n"])
        trim()

    return docs.mapInArrow(run, "part int, token binary, gram long, n long")


def chances(totals: DataFrame, near: list[tuple], order: int) -> DataFrame:
    """gram, logp: log10 of the probability of each gram of totals (gram, n), where n counts training texts.

    Grams meet by their NEAR + 1 last bytes of context: all longer contexts of a gram are then where it is.
    """
    shared = totals.sparkSession.sparkContext.broadcast(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        grams, n = (np.concatenate(x) for x in zip(*held, strict=True))
        met = n > 0
        logp = log10_chances(grams, [*shared.value, *subtables(grams[met], n[met], NEAR + 1, order, shared.value[NEAR])])
        for a in range(0, len(grams), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(grams[a : a + 100_000]), pa.array(logp[a : a + 100_000].astype(np.float32))], names=["gram", "logp"])
        trim()

    suffix = F.expr(f"shiftright(gram, 8) & {(1 << (8 * (NEAR + 1))) - 1}")
    return totals.select("gram", "n").repartition(suffix).mapInArrow(run, "gram long, logp float")


def by_part(rows: DataFrame, by: str, name: str) -> str:
    """Path of rows as one Parquet folder for each part, in the order of by."""
    path = fresh_path(rows.sparkSession, name)
    rows.repartition("part").sortWithinPartitions("part", by).write.partitionBy("part").parquet(path)
    passing(rows.sparkSession, path)
    return path


@contextmanager
def same_partitions(spark: SparkSession):
    """File scans are cut alike in here, however many cores come and go meanwhile."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def read_part(path: str, part: int, columns: list[str]) -> pa.Table:
    """The rows of one part; none if it has no folder."""
    store, root = fs.FileSystem.from_uri(path)
    folder = f"{root}/part={part}"
    if store.get_file_info(folder).type == fs.FileType.NotFound:
        return pa.table({c: pa.array([], {"token": pa.binary(), "gram": pa.int64(), "c": pa.int64(), "logp": pa.float32()}[c]) for c in columns})
    return pq.read_table(folder, filesystem=store, columns=columns, partitioning=None)


def score_corpus(docs: DataFrame, folds: int = 7, held: int = 2, order: int = ORDER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model is learned from the rows whose keyed remainder is not held. A null text is empty: one token, the end.
    Repeated rows count as often as they occur; a null key counts as the empty text; an empty table gives an empty one;
    columns other than key and text are not read. Very long texts are one row of a scan; a NUL byte counts as an end.
    docs is scanned twice and must come out in the same partitions: a table does, and anything else is refused where a
    partition holds what it did not hold before. The shared folder must be one that pyarrow opens.
    """
    if not NEAR < order <= 7:
        raise ValueError("an order of 3 to 7 bytes")
    spark = docs.sparkSession
    with same_partitions(spark):
        learned = crc_remainder(F.col(key), folds) != held
        rows = stored(listed(docs.select(learned.alias("train"), F.col(text).alias("text")), order), "grams")
        tokens, grams = rows.where("token is not null").select("part", "token", "n"), rows.where("token is null").select("part", "gram", "n")
        n_all = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        near = grams.where("n > 0").groupBy(F.col("gram").bitwiseAND((1 << (8 * (NEAR + 1))) - 1).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
        tables = subtables(near.column("gram").to_numpy(), near.column("n").to_numpy(), 0, NEAR, None)

        # each of the two is dealt out once: for the sums, and for the join with them
        dealt = tokens.repartition("token")
        sums = dealt.groupBy("token").agg(F.sum("n").alias("c"), F.min(F.when(F.col("n") > 0, F.col("part"))).alias("home")).where("c > 0")
        words = by_part(dealt.join(sums, "token").select("part", "token", "n", "c", (F.col("part") == F.col("home")).alias("first")), "token", "words")
        n_distinct = spark.read.schema("token binary, n long, c long, first boolean, part int").parquet(words).where("first").count() if n_all else 0
        dealt = grams.repartition("gram")
        model = chances(dealt.groupBy("gram").agg(F.sum("n").alias("n"), F.min("part").alias("home")), tables, order)
        known = by_part(dealt.join(model, "gram").select("part", "gram", "n", "logp"), "gram", "chances")
        floor = float(n_all + n_distinct + 1)
        made = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
        schema = T.StructType([docs.schema[key], *made])

        def total(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate(([0.0], np.cumsum(x, dtype=np.float64)))[bounds])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, own = TaskContext.get().partitionId(), None
            for batch in batches:
                if own is None:
                    own = read_part(words, part, ["token", "c"]).combine_chunks(), read_part(known, part, ["gram", "logp"]).combine_chunks()
                    token_set, gram_set = own[0].column("token").combine_chunks(), own[1].column("gram").to_numpy()
                    if (gram_set[1:] < gram_set[:-1]).any():  # more than one file
                        own = own[0], own[1].sort_by("gram")
                        gram_set = own[1].column("gram").to_numpy()
                    terms = np.append(np.log10((own[0].column("c").to_numpy() + 1.0) / floor), np.log10(1.0 / floor))
                    logp = own[1].column("logp").to_numpy()
                    end = pc.index_in(pa.array([END], pa.binary()), value_set=token_set)[0].as_py()
                texts, parts = raw_texts(batch.column(1)), []
                for a, b in slices(texts, BLOCK):
                    laid = laid_out(texts[a:b], order)
                    word, gram = laid.words.dictionary_encode(), pa.array(laid.grams).dictionary_encode()
                    wanted = gram.dictionary.to_numpy()
                    ranked = np.argsort(wanted)  # neighbours are looked up together
                    at = places(gram_set, wanted[ranked])
                    if len(at) and at.min() < 0:
                        raise ValueError("docs came out in other partitions the second time: pass a stored table")
                    value = np.empty(len(wanted))
                    value[ranked] = logp[at]
                    parts.append((a, b, laid.word_bounds, word.indices.to_numpy(), word.dictionary, total(value[gram.indices.to_numpy()], laid.gram_bounds)))
                found = pc.index_in(pa.chunked_array([p[4] for p in parts], pa.binary()), value_set=token_set).combine_chunks().fill_null(-1).to_numpy() if parts else []
                done = 0
                for a, b, bounds, code, dictionary, scores in parts:
                    word = found[done : done + len(dictionary)][code]
                    done += len(dictionary)
                    columns = [np.diff(bounds) + 1, total(word >= 0, bounds).astype(np.int64) + (end is not None), total(terms[word], bounds) + terms[-1 if end is None else end], scores]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, columns)], names=schema.names)
            trim()

        scored = stored(docs.select(key, F.col(text).alias("__text")).mapInArrow(run, schema), "scored")
    return scored.select(key, (crc_remainder(F.col(key), folds) == held).alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
