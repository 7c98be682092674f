"""Ranked lexical search (operator 13) over a tiered index of impacts, exact to the last unit.

The index is sharded by documents. A shard's postings (document, impact) lie in tiers: the first has all postings of terms
that are rare in the shard, and of other terms those of high impact; lower tiers have the rest. For each term and tier the
largest impact below is known, the residual bound. A search reads the first tier and sums what it finds. If what an item's
terms may still have below is less than its k-th best sum, then no document outside the sums so far can enter: the item is
proved, and only the documents whose sum and residuals reach that k-th sum are completed from the tiers below, in the shards
that have any. An item without this proof falls through to the next tier; in the last one nothing is left and sums are exact.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII; A-Z is lower-cased. Scores are
integers. Each row of documents is a document of its own: repeated rows are ranked as often as they occur. Null texts and
texts without terms are never found. Equal scores are ranked by ascending key, null keys last. Equal items are one; an item
without terms has no rows. Empty documents give an empty result. Columns other than key and text are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import raw_texts, slices, stored, trim

#: Lower-cases A-Z and turns every ASCII byte outside terms into a space.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))
#: A shard ends at so many documents or bytes of text, give or take a slice of texts that are cut into terms together.
SHARD_DOCS, SHARD_BYTES, SLICE = 8192, 16 << 20, 1 << 20
#: A posting is in the first tier of which its term occurs in no more than this share of the shard's documents (or in FEW), or
#: its impact is no less. All others are in one more tier.
TIERS = ((0.05, 650_000), (0.2, 550_000))
FEW = 8
LAST = len(TIERS)
#: Items are searched in blocks of about so many terms, which are on the driver and in each task.
BLOCK_TERMS = 200_000


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLDED).split()


def damping(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents of these lengths (in terms) among n documents of total terms."""
    if 75 * int(lengths.max(initial=0)) * n >= 1 << 63:
        return np.array([25 + 75 * int(x) * n // total for x in lengths], np.int64)
    return 25 + 75 * lengths.astype(np.int64) * n // total


@dataclass
class Index:
    """rows: (tier, shard, term, n, top, postings, keys); tier -1 holds each shard's keys. n documents of total terms."""

    rows: DataFrame
    n: int
    total: int
    key: T.DataType


def corpus_totals(docs: DataFrame, text: str) -> tuple[int, int]:
    """Documents with a term, and terms with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            sizes = [len(terms_of(t)) for t in raw_texts(batch.column(0))]
            n, total = n + sum(map(bool, sizes)), total + sum(sizes)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])
        trim()

    got = docs.select(F.col(text).alias("text")).mapInArrow(count, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return got[0] or 0, got[1] or 0


def shard_rows(words: pa.ChunkedArray, lengths: np.ndarray, n: int, total: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """Of one shard's documents: tier, term, number of postings, largest impact and postings of each row, by tier and term.

    words: the terms of all of them, one after the other; lengths: how many each has.
    """
    coded, docs = words.dictionary_encode().combine_chunks(), len(lengths)
    in_order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(in_order), np.int64)
    place[in_order.to_numpy()] = np.arange(len(in_order))
    pair, tf = np.unique(place[coded.indices.to_numpy()] * docs + np.repeat(np.arange(docs), lengths), return_counts=True)
    term, doc = pair // docs, pair % docs
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * damping(lengths, n, total)[doc])
    df = np.bincount(term, minlength=len(in_order))[term]
    tier = np.full(len(term), LAST)
    for t, (share, least) in reversed(list(enumerate(TIERS))):
        tier[(df <= max(FEW, share * docs)) | (impact >= least)] = t
    order = np.argsort(tier, kind="stable")
    tier, term, doc, impact = tier[order], term[order], doc[order], impact[order]
    first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (tier[1:] != tier[:-1]))))
    ends = np.append(first, len(term))
    pairs = np.column_stack((doc, impact)).astype("<u4")
    postings = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(pairs)])
    terms = coded.dictionary.take(in_order).take(pa.array(term[first])).cast(pa.string())
    return tier[first], terms, np.diff(ends), np.maximum.reduceat(impact, first), postings


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Index of all terms of whole texts, in the shared folder: one scan counts, one writes; nothing is shuffled."""
    n, total = corpus_totals(docs, text)
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("tier", T.IntegerType()), T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("top", T.LongType()), T.StructField("postings", T.BinaryType()), T.StructField("keys", T.ArrayType(kind))])
    names = schema.names

    def batch_of(shard: int, keys: list[pa.Array], words: list[pa.Array], lengths: list[int]) -> Iterator[pa.RecordBatch]:
        if not any(lengths):
            return
        own = pa.concat_arrays(keys)
        listed = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([shard], pa.int64()), pa.nulls(1, pa.string()), pa.array([len(own)], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), listed], names=names)
        tier, terms, counts, top, postings = shard_rows(pa.chunked_array(words, pa.binary()), np.array(lengths, np.int64), n, total)
        rows = len(tier)
        yield pa.RecordBatch.from_arrays([pa.array(tier, pa.int32()), pa.array(np.full(rows, shard)), terms, pa.array(counts, pa.int64()), pa.array(top, pa.int64()), postings, pa.nulls(rows, listed.type)], names=names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size = TaskContext.get().partitionId() << 32, 0
        keys, words, lengths = [], [], []
        for batch in batches:
            texts = raw_texts(batch.column(1))
            for a, b in slices(texts, SLICE):
                cut = [terms_of(t) for t in texts[a:b]]
                words.append(pa.array(chain.from_iterable(cut), pa.binary()))  # compact: a slice's terms are objects, a shard's are not
                lengths += map(len, cut)
                keys.append(batch.column(0).slice(a, b - a))
                size += sum(map(len, texts[a:b]))
                if len(lengths) >= SHARD_DOCS or size >= SHARD_BYTES:
                    yield from batch_of(shard, keys, words, lengths)
                    shard, size, keys, words, lengths = shard + 1, 0, [], [], []
        yield from batch_of(shard, keys, words, lengths)
        trim()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(build, schema)
    return Index(stored(rows, "tiers", ("tier",)), n, total, kind)


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, key, term, qtf): the terms of each distinct item with their counts; item numbers the items."""
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("key", items.schema[key].dataType), T.StructField("term", T.StringType()), T.StructField("qtf", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(raw_texts(batch.column(2))):
                words = pa.array(terms_of(t), pa.binary()).value_counts()
                at = pa.array(np.full(len(words), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), words.field("values").cast(pa.string()), words.field("counts")], names=schema.names)

    distinct = items.select(F.col(key).alias("key"), F.col(text).alias("text")).distinct()
    return stored(distinct.select(F.monotonically_increasing_id().alias("item"), "key", "text").mapInArrow(cut, schema), "items")


@dataclass
class Block:
    """Items of a block: each item's terms with weight times count, and each term's largest impact in each tier."""

    keys: pa.Array
    of: list[list[tuple[str, int]]]
    tops: dict[str, np.ndarray]

    def left(self, term: str, tier: int) -> int:
        """The largest impact of a term's postings below a tier."""
        return int(self.tops[term][tier + 1 :].max(initial=0))

    def residual(self, i: int, tier: int) -> int:
        return sum(w * self.left(t, tier) for t, w in self.of[i])

    def terms(self, items: list[int]) -> list[str]:
        return sorted({t for i in items for t, _ in self.of[i]})


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def block_of(index: Index, asked: pa.Table) -> Block:
    """Weights and bounds of a block's terms: columns n and top of the index alone are read."""
    spark = index.rows.sparkSession
    terms = F.broadcast(spark.createDataFrame(pa.table({"term": asked["term"].unique()})))  # BLOCK_TERMS or so at most
    seen = index.rows.where("tier >= 0").select("tier", "term", "n", "top").join(terms, "term").groupBy("term", "tier").agg(F.sum("n").alias("n"), F.max("top").alias("top")).toArrow()
    df: dict[str, int] = {}
    tops: dict[str, np.ndarray] = {}
    for t, tier, n, top in zip(*(seen[c].to_pylist() for c in ("term", "tier", "n", "top")), strict=True):
        df[t] = df.get(t, 0) + n  # a document's posting of a term is in one tier
        tops.setdefault(t, np.zeros(LAST + 1, np.int64))[tier] = top
    number: dict[int, int] = {}
    rows, of = [], []
    for r, (item, t, qtf) in enumerate(zip(*(asked[c].to_pylist() for c in ("item", "term", "qtf")), strict=True)):
        if item not in number:
            number[item] = len(of)
            of.append([])
            rows.append(r)
        if t in tops and (w := weight(index.n, df[t])):
            of[number[item]].append((t, qtf * w))
    return Block(asked["key"].combine_chunks().take(pa.array(rows, pa.int64())), of, tops)


class Shard:
    """One shard's postings of the terms asked for, by tier, and its keys."""

    def __init__(self, rows: pa.Table) -> None:
        tiers, terms = rows["tier"].to_numpy(), rows["term"].to_pylist()
        own = int(np.flatnonzero(tiers == -1)[0])
        self.keys = rows["keys"].combine_chunks().slice(own, 1).flatten()
        self.number = rows["shard"][0].as_py()
        self.postings: dict[str, list[tuple[int, np.ndarray]]] = {}
        for k, p in enumerate(rows["postings"].to_pylist()):
            if k != own:
                self.postings.setdefault(terms[k], []).append((int(tiers[k]), np.frombuffer(p, "<u4").reshape(-1, 2)))

    def sums(self, asked: list[tuple[str, int]], least: int, most: int, into: np.ndarray) -> bool:
        """Adds the terms' weighted impacts in tiers least to most to each document's sum; whether there are any."""
        some = False
        for t, w in asked:
            for tier, p in self.postings.get(t, ()):
                if least <= tier <= most:
                    into[p[:, 0]] += w * p[:, 1].astype(np.int64)
                    some = True
        return some

    def reach(self, asked: list[tuple[str, int]], tier: int, block: Block) -> np.ndarray:
        """What each document may still have below a tier: the residual bounds of the terms that it was not found with so far."""
        out = np.full(len(self.keys), sum(w * block.left(t, tier) for t, w in asked), np.int64)
        for t, w in asked:
            if bound := w * block.left(t, tier):
                for own, p in self.postings.get(t, ()):
                    if own <= tier:
                        out[p[:, 0]] -= bound
        return out

    def best(self, sums: np.ndarray, k: int) -> np.ndarray:
        """The k documents of the largest sums over 0, equal ones by ascending key, null keys last."""
        at = np.flatnonzero(sums > 0)
        if len(at) > k:
            at = at[sums[at] >= np.partition(sums[at], len(at) - k)[len(at) - k]]
        if len(at) > k:  # ties at the end
            place = np.empty(len(at), np.int64)
            place[pc.sort_indices(self.keys.take(pa.array(at))).to_numpy()] = np.arange(len(at))
            at = at[np.lexsort((place, -sums[at]))[:k]]
        return at


def found_rows(shard: Shard, got: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    """(item, shard, score, doc) of each item's documents and sums."""
    items, at, sums = [np.full(len(a), i) for i, a, _ in got], [a for _, a, _ in got], [s for _, _, s in got]
    join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    places = join(at)
    return pa.table({"item": pa.array(join(items), pa.int32()), "shard": pa.array(np.full(len(places), shard.number), pa.int64()), "score": pa.array(join(sums), pa.int64()), "doc": shard.keys.take(pa.array(places))})


def of_shards(index: Index, block: Block, items: list[int], most: int, open_pairs: DataFrame | None = None) -> DataFrame:
    """The index's rows of tiers up to most that the items ask for, and each shard's keys.

    open_pairs: (item, shard), where only these are to be read.
    """
    spark = index.rows.sparkSession
    rows = index.rows.where(F.col("tier").between(0, most))
    terms = spark.createDataFrame(pa.table({"term": pa.array(block.terms(items), pa.string())}))
    rows, keys = rows.join(F.broadcast(terms), "term", "left_semi"), index.rows.where("tier = -1")
    if open_pairs is not None:
        wanted = open_pairs.select("shard").distinct()
        rows, keys = rows.join(wanted, "shard", "left_semi"), keys.join(wanted, "shard", "left_semi")
    return rows.unionByName(keys)


def largest(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, with their rank: among shards' best first, so that no item meets all its rows in one task."""
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    near = found.withColumn("__rank", F.row_number().over(Window.partitionBy("item", F.pmod(F.xxhash64("shard"), F.lit(64))).orderBy(*order))).where(F.col("__rank") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def first_sums(index: Index, block: Block, items: list[int], tier: int, k: int) -> DataFrame:
    """Each shard's k best documents of each item by what the tiers up to tier hold: their sums are lower bounds."""

    def run(rows: pa.Table) -> pa.Table:
        shard = Shard(rows)
        got = []
        for i in items:
            sums = np.zeros(len(shard.keys), np.int64)
            if shard.sums(block.of[i], 0, tier, sums):
                at = shard.best(sums, k)
                got.append((i, at, sums[at]))
        return found_rows(shard, got)

    return of_shards(index, block, items, tier).groupBy("shard").applyInArrow(run, found_schema(index))


def completed(index: Index, block: Block, at_least: dict[int, int], tier: int, k: int, open_pairs: DataFrame) -> DataFrame:
    """The k best of each proved item in each open shard: documents that may reach the item's bound, summed to the last tier."""

    def run(rows: pa.Table) -> pa.Table:
        shard = Shard(rows)
        got = []
        for i, least in at_least.items():
            sums = np.zeros(len(shard.keys), np.int64)
            if not shard.sums(block.of[i], 0, tier, sums):
                continue
            may = (sums > 0) & (sums + shard.reach(block.of[i], tier, block) >= least)
            if may.any():
                shard.sums(block.of[i], tier + 1, LAST, sums)
                sums[~may] = 0
                at = shard.best(sums, k)
                got.append((i, at, sums[at]))
        return found_rows(shard, got)

    return of_shards(index, block, list(at_least), LAST, open_pairs).groupBy("shard").applyInArrow(run, found_schema(index))


def found_schema(index: Index) -> T.StructType:
    return T.StructType([T.StructField("item", T.IntegerType()), T.StructField("shard", T.LongType()), T.StructField("score", T.LongType()), T.StructField("doc", index.key)])


def search_block(index: Index, block: Block, k: int) -> list[DataFrame]:
    """(item, score, doc, rank, tier) of a block's items, by the tier that proved them."""
    pending, out = [i for i, terms in enumerate(block.of) if terms], []
    for tier in range(LAST + 1):
        if not pending:
            break
        found = stored(first_sums(index, block, pending, tier, k), "sums")
        ranked = largest(found, k)
        left = {i: block.residual(i, tier) for i in pending}
        kth = {r["item"]: r["score"] for r in ranked.where(F.col("rank") == k).select("item", "score").collect()}  # a row for each item of the block
        whole = [i for i in pending if not left[i]]
        proved = {i: kth[i] for i in pending if 0 < left[i] < kth.get(i, 0)}
        if whole:
            out.append(ranked.where(F.col("item").isin(whole)).select("item", "score", "doc", "rank", F.lit(tier).alias("tier")))
        if proved:
            spark = index.rows.sparkSession
            bounds = spark.createDataFrame(pa.table({"item": pa.array(list(proved), pa.int32()), "__need": pa.array([proved[i] - left[i] for i in proved], pa.int64())}))
            open_pairs = found.groupBy("item", "shard").agg(F.max("score").alias("most")).join(F.broadcast(bounds), "item").where(F.col("most") >= F.col("__need")).select("item", "shard")
            out.append(largest(stored(completed(index, block, proved, tier, k, open_pairs), "completed"), k).select("item", "score", "doc", "rank", F.lit(tier).alias("tier")))
        done = {*whole, *proved}
        pending = [i for i in pending if i not in done]
    return out


def search(index: Index, items: DataFrame, key: str = "item_id", text: str = "text", k: int = 10) -> DataFrame:
    """The k best documents of each item: (item's key, rank, doc_id, score, proved_by), proved_by the last tier searched."""
    spark = items.sparkSession
    name = key
    terms = item_terms(items, key, text)
    blocks = max(1, math.ceil(terms.count() / BLOCK_TERMS))
    made = []
    for b in range(blocks):
        asked = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow()
        if not asked.num_rows or not index.n:
            continue
        block = block_of(index, asked)
        keys = spark.createDataFrame(pa.table({"item": pa.array(range(len(block.keys)), pa.int32()), "key": block.keys}), schema=T.StructType([T.StructField("item", T.IntegerType()), T.StructField("key", items.schema[key].dataType)]))
        made += [part.join(F.broadcast(keys), "item").select(F.col("key").alias(name), "rank", F.col("doc").alias("doc_id"), "score", F.col("tier").alias("proved_by")) for part in search_block(index, block, k)]
    if not made:
        return spark.createDataFrame([], T.StructType([T.StructField(name, items.schema[key].dataType), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", index.key), T.StructField("score", T.LongType()), T.StructField("proved_by", T.IntegerType())]))
    out = made[0]
    for part in made[1:]:
        out = out.unionByName(part)
    return out
