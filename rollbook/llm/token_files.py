"""Token-id files (operator 10): raw id payloads with a minimal perfect hash index from document keys to offsets.

A shard is two files. NAME.ids holds ids alone, little-endian, 16 bits each where the vocabulary allows it, else 32.
NAME.mph holds a JSON line, then arrays: displacements by bucket, then by slot a fingerprint of the key, the offset and
the length in ids; last the keys in payload order, as an Arrow stream. A key is hashed to a bucket, the bucket's
displacement gives the slot, and the slot's fingerprint tells an unknown key: three array reads for any key, however many
there are. manifest.json names the shards in order, with the first id's number, the first key and the last.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import fresh_path, pa_type, trim
from rollbook.llm.tokens import blocks, encoder

#: A shard ends at so many ids or documents.
SHARD_IDS, SHARD_DOCS = 16 << 20, 1 << 20
#: Hash seeds of a shard, and displacements of a bucket, that are tried before giving up.
MOST_SEEDS, MOST_TRIES = 32, 1 << 16


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser in the splitmix manner."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@dataclass
class Keys:
    """Document keys (integers or texts, null allowed) and which occurrence of its key each row is, from 0 on."""

    values: pa.Array
    nth: np.ndarray

    @classmethod
    def of(cls, values: pa.Array) -> Keys:
        """Keys in an order in which equal ones are neighbours."""
        code = values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
        return cls(values, np.arange(len(code)) - np.repeat(begins, np.diff(np.append(begins, len(code)))))

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each key: its value is mixed first, then its occurrence, then whether it is null."""
        if pa.types.is_integer(self.values.type):
            own = self.values.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").view("<u8")
        else:
            own = np.fromiter((xxhash.xxh64_intdigest(x or "", seed) for x in self.values.to_pylist()), "<u8", len(self.values))
        null = self.values.is_null().to_numpy(zero_copy_only=False).astype("<u8")
        return mixed(mixed(mixed(own, 5 * seed + 11) ^ self.nth.astype("<u8"), 5 * seed + 12) ^ null, 5 * seed + 13)


def slot_of(h: np.ndarray, displacement: np.ndarray, slots: int) -> np.ndarray:
    """Slot of each hash under its bucket's displacement: a seed from 0 up, or a slot itself as -1 - slot."""
    with np.errstate(over="ignore"):
        seeded = (mixed(h + displacement.astype("<i8").view("<u8") * np.uint64(0xD6E8FEB86659FD93), 3) % np.uint64(slots)).astype("<i8")
    return np.where(displacement < 0, -1 - displacement, seeded)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(h, 2) % np.uint64(buckets)).astype(np.int64)


def perfect(h: np.ndarray, tries: int = MOST_TRIES) -> np.ndarray | None:
    """Displacements that send n distinct hashes to n slots, one each; None if a bucket finds none in so many tries.

    Buckets of the same size, the largest first, look for their slots side by side: of those that want one slot, one gets
    it, and the others go on to their next displacement. Buckets of one key get the slots that are left.
    """
    n = len(h)
    buckets = max(1, n // 3)
    of = bucket_of(h, buckets)
    order, counts = np.argsort(of, kind="stable"), np.bincount(of, minlength=buckets)
    starts = np.concatenate(([0], np.cumsum(counts)))
    out, free, owner = np.zeros(buckets, "<i8"), np.ones(n, bool), np.zeros(n, np.int64)
    for size in range(int(counts.max(initial=0)), 1, -1):
        todo = np.flatnonzero(counts == size)
        own = h[order[starts[todo][:, None] + np.arange(size)]]
        d = np.zeros(len(todo), "<i8")
        while len(todo):
            slots = slot_of(own, np.broadcast_to(d[:, None], own.shape), n)
            in_order = np.sort(slots, axis=1)
            good = np.flatnonzero(free[slots].all(axis=1) & (in_order[:, 1:] != in_order[:, :-1]).all(axis=1))
            owner[slots[good]] = good[:, None]
            won = good[(owner[slots[good]] == good[:, None]).all(axis=1)]
            out[todo[won]] = d[won]
            free[slots[won]] = False
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, own, d = todo[rest], own[rest], d[rest] + 1
            if len(d) and d[0] > tries:
                return None
    single = np.flatnonzero(counts == 1)
    out[single] = -1 - np.flatnonzero(free)[: len(single)]
    return out


@dataclass
class Index:
    """Constant-time lookup of a key's place in a shard."""

    seed: int
    displacements: np.ndarray
    fingerprints: np.ndarray
    offsets: np.ndarray
    lengths: np.ndarray
    keys: Keys
    id_type: str

    @classmethod
    def build(cls, keys: Keys, lengths: np.ndarray, id_type: str) -> Index:
        """The first seed is taken under which all keys' hashes differ and every bucket finds its slots."""
        n = len(keys.nth)
        for seed in range(MOST_SEEDS):
            h = keys.hashes(seed)
            if len(np.unique(h)) < n:
                continue
            d = perfect(h) if n else np.zeros(1, "<i8")
            if d is not None:
                break
        else:
            raise ValueError(f"no perfect hash of {n} keys under {MOST_SEEDS} seeds")
        slots = slot_of(h, d[bucket_of(h, len(d))], max(1, n))
        offsets = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        f, o, size = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u8")
        f[slots], o[slots], size[slots] = cls.fingerprint(h), offsets, lengths
        return cls(seed, d, f, o, size, keys, id_type)

    @staticmethod
    def fingerprint(h: np.ndarray) -> np.ndarray:
        return (mixed(h, 5) >> np.uint64(32)).astype("<u4")

    def find(self, keys: Keys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is there (but for one in 2**32 strangers), its offset and its length in ids."""
        if not len(self.fingerprints):
            return np.zeros(len(keys.nth), bool), np.zeros(len(keys.nth), "<u8"), np.zeros(len(keys.nth), "<u8")
        h = keys.hashes(self.seed)
        slots = slot_of(h, self.displacements[bucket_of(h, len(self.displacements))], len(self.fingerprints))
        return self.fingerprints[slots] == self.fingerprint(h), self.offsets[slots], self.lengths[slots]

    def tobytes(self) -> bytes:
        sink, table = pa.BufferOutputStream(), pa.table({"key": self.keys.values, "nth": pa.array(self.keys.nth, pa.int64())})
        with pa.ipc.new_stream(sink, table.schema) as f:
            f.write_table(table)
        head = {"keys": len(self.fingerprints), "buckets": len(self.displacements), "seed": self.seed, "ids": self.id_type}
        return json.dumps(head).encode() + b"\n" + b"".join(x.tobytes() for x in (self.displacements, self.fingerprints, self.offsets, self.lengths)) + sink.getvalue().to_pybytes()

    @classmethod
    def frombytes(cls, data: bytes) -> Index:
        line, _, body = data.partition(b"\n")
        head = json.loads(line)
        n, at, parts = head["keys"], 0, []
        for kind, count in (("<i8", head["buckets"]), ("<u4", n), ("<u8", n), ("<u8", n)):
            parts.append(np.frombuffer(body, kind, count, at))
            at += parts[-1].nbytes
        table = pa.ipc.open_stream(body[at:]).read_all().combine_chunks()
        values = table.column("key").chunk(0) if table.num_rows else pa.array([], table.schema.field("key").type)
        return cls(head["seed"], *parts, Keys(values, table.column("nth").to_numpy()), head["ids"])


def write_shard(store: fs.FileSystem, base: str, keys: Keys, payload: list[bytes], lengths: np.ndarray, id_type: str) -> None:
    """Both files under temporary names, then renamed: a repeated task replaces its own files with equal ones."""
    for end, data in ((".ids", payload), (".mph", [Index.build(keys, lengths, id_type).tobytes()])):
        part = f"{base}{end}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            for x in data:
                f.write(x)
        store.move(part, base + end)


def key_column(docs: DataFrame, key: str) -> Column:
    """The key as a long or a string; keys of any other type are refused."""
    kind = docs.schema[key].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(key).cast("long")
    if isinstance(kind, T.StringType):
        return F.col(key)
    raise TypeError(f"keys must be integers or strings; {key} is {kind.simpleString()}")


def with_ends(ids: np.ndarray, begin: np.ndarray, end_id: int, id_type: str) -> tuple[np.ndarray, np.ndarray]:
    """The texts' ids, each with the end id behind it, and their lengths."""
    return np.insert(ids, begin[1:], end_id).astype(id_type), np.diff(begin) + 1


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0, key: str = "doc_id", text: str = "text", kind: str = "bytes", vocabulary_size: int = 50_257, shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS) -> list[tuple]:
    """Shards of all documents in ascending order of key; returns (name, first id's number, first key, last key) by shard.

    Nulls count as empty texts; null keys sort first. The order of repeated keys is that of their texts' hashes, so that
    one key's rows may be dealt over several tasks. What comes to the driver is a line for each shard of shard_ids ids or
    shard_docs documents. The folder must be one that pyarrow opens (a local or mounted path, HDFS, S3, GCS).
    """
    id_type = "<u2" if vocabulary_size <= 1 << 16 else "<u4"
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    columns = docs.select(key_column(docs, key).alias("key"), F.col(text).alias("text"))
    key_type = columns.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        encode, task = encoder(vocabulary, kind).encode, TaskContext.get().partitionId()
        keys, payload, lengths = [], [], []
        size = shard = docs = 0

        def flush() -> pa.RecordBatch:
            name = f"{task:06d}-{shard:04d}"
            own = pa.concat_arrays(keys)
            write_shard(store, f"{root}/{name}", Keys.of(own), payload, np.concatenate(lengths), id_type)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), own[:1], own[-1:]], names=["name", "ids", "first", "last"])

        for batch in batches:
            names, texts = batch.column(0).cast(pa_type(key_type)), batch.column(1)
            for a, b in blocks(texts):
                ids, n = with_ends(*encode(texts.slice(a, b - a)), end_id, id_type)
                keys.append(names.slice(a, b - a))
                payload.append(ids.tobytes())
                lengths.append(n)
                size, docs = size + len(ids), docs + b - a
                if size >= shard_ids or docs >= shard_docs:
                    yield flush()
                    keys, payload, lengths, size, docs, shard = [], [], [], 0, 0, shard + 1
        if keys:
            yield flush()
        trim()

    tie = F.xxhash64("text")
    made = columns.repartitionByRange(F.col("key").asc_nulls_first(), tie).sortWithinPartitions(F.col("key").asc_nulls_first(), tie)
    shape = T.StructType([T.StructField("name", T.StringType()), T.StructField("ids", T.LongType()), T.StructField("first", key_type), T.StructField("last", key_type)])
    out, start = [], 0
    for r in sorted(made.mapInArrow(run, shape).collect(), key=lambda r: r.name):
        out.append((r.name, start, r.first, r.last))
        start += r.ids
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(out).encode())
    return out


def ids_of(folder: str, key: int | str) -> list[np.ndarray]:
    """Ids of every document of one key, each read at the place that its shard's index names; none for an unknown key.

    Only shards whose range of keys holds the key are opened.
    """
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        listed = json.loads(f.read())
    out = []
    for name, _, first, last in listed:
        if last is None or key > last or (first is not None and key < first):
            continue
        with store.open_input_stream(f"{root}/{name}.mph") as f:
            index = Index.frombytes(f.read())
        width, nth = np.dtype(index.id_type).itemsize, 0
        with store.open_input_file(f"{root}/{name}.ids") as f:
            while True:
                there, offset, length = index.find(Keys(pa.array([key], index.keys.values.type), np.array([nth])))
                if not there[0]:
                    break
                out.append(np.frombuffer(f.read_at(int(length[0]) * width, int(offset[0]) * width), index.id_type).astype("<u4"))
                nth += 1
    return out


def read_token_files(spark: SparkSession, folder: str, manifest: list[tuple], key: T.DataType | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, each looked up by its key in its shard's index."""
    shape = T.StructType([T.StructField("doc_id", key or T.LongType()), *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{name}.mph") as f:
                    index = Index.frombytes(f.read())
                there, offsets, lengths = index.find(index.keys)
                if not there.all():
                    raise ValueError(f"{name}: a key is not in its own index")
                crcs, width = [], np.dtype(index.id_type).itemsize
                with store.open_input_file(f"{root}/{name}.ids") as f:
                    for o, n in zip(offsets.tolist(), lengths.tolist(), strict=True):
                        crcs.append(zlib.crc32(np.frombuffer(f.read_at(n * width, o * width), index.id_type).astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([index.keys.values, pa.array(offsets.astype(np.int64) + base), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())], names=shape.names)

    listed = spark.createDataFrame([(r[0], r[1]) for r in manifest], "name string, start long")
    return listed.repartition(max(1, min(len(manifest), 10_000)), "name").mapInArrow(run, shape)


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 0, key: str = "doc_id", **options) -> DataFrame:
    """Writes token files of docs to the shared folder and reads them back, a row per document.

    Empty table: no shard, no row. Very long texts are one payload each; repeated rows each have their own key
    (key, occurrence); keys are integers or strings, null included, others are refused. Columns other than key and text
    are not read.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "token-ids")
    manifest = write_token_files(docs, vocabulary, folder, end_id, key, **options)
    return read_token_files(spark, folder, manifest, T.StringType() if isinstance(docs.schema[key].dataType, T.StringType) else T.LongType())
