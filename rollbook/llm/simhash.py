"""SimHash near-duplicates (operator 8) by meet-in-the-middle ball hashing.

The 64 bits are taken in three parts. Of two fingerprints that differ in at most 4 bits, some two parts differ in at most 2
bits together. So for each two parts, 42 or 43 bits, a fingerprint emits all variants within 1 bit, half of that radius:
two that are within 2 bits meet at some variant. That is 131 variants for a fingerprint instead of the 2,081 of the whole
ball of radius 2, with the same pairs found; by chance few meet, as there are 2**43 variants and more for each choice of
parts. Fingerprints are deduplicated first, variants are shuffled, colliding pairs are verified, and the links'
components are found by star contractions. A variant of many fingerprints is split by the variants of the part that it
leaves out, which bounds every group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import map_texts, stored
from rollbook.llm.components import components, join_to_one

#: Fingerprints of one variant that are compared with each other as they are; larger groups are split.
DIRECT = 1024
RADIUS = 4


def fingerprint(raw: bytes, width: int = 4) -> int:
    """64-bit SimHash of a text's width-word shingles, repeats included; a bit is set if it is in over half the hashes."""
    words = raw.lower().split()
    if not words:
        return 0
    hashes = hash_shingles(words, width)
    return bits_of(np.array(hashes, "<u8"))


def hash_shingles(words: list[bytes], width: int) -> list[int]:
    """XXH64 with seed 42 of each shingle, its words joined by a space."""
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(b" ".join(words), 42)]
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(words) - width + 1].tolist()
    return [digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def bits_of(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 8192):
        part = hashes[a : a + 8192]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, keep: list[str], width: int = 4, text: str = "text") -> DataFrame:
    """keep columns and fp, the fingerprint as a signed long; a text without words (or null) has fingerprint 0."""
    return map_texts(docs, keep, text, [T.StructField("fp", T.LongType())], lambda texts: [[signed(fingerprint(t, width)) for t in texts]])


#: First bit and size of each part.
PARTS = ((0, 22), (22, 21), (43, 21))


def ball(values: np.ndarray, bits: int, radius: int) -> np.ndarray:
    """All variants of values of so many bits within radius (0 to 2) bits, a row for each value."""
    one = np.int64(1) << np.arange(bits, dtype=np.int64)
    masks = [np.zeros(1, np.int64)]
    if radius >= 1:
        masks.append(one)
    if radius >= 2:
        i, j = np.triu_indices(bits, 1)
        masks.append(one[i] | one[j])
    return values[:, None] ^ np.concatenate(masks)[None, :]


def without(fp: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The two other parts side by side, and the part itself."""
    at, size = PARTS[part]
    u, low = fp.view(np.uint64), np.uint64((1 << at) - 1)
    return ((u >> np.uint64(at + size) << np.uint64(at) if at + size < 64 else u & np.uint64(0)) | u & low).astype(np.int64), (u >> np.uint64(at) & np.uint64((1 << size) - 1)).astype(np.int64)


def variants(fps: DataFrame) -> DataFrame:
    """fp with each variant within 1 bit of each two of its parts; from bit 60 on, a variant has the part left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a in range(0, len(fp), 10_000):
                part = fp[a : a + 10_000]
                for k, (_, size) in enumerate(PARTS):
                    v = ball(without(part, k)[0], 64 - size, 1) | np.int64(k << 60)
                    yield pa.RecordBatch.from_arrays([pa.array(v.ravel()), pa.array(np.repeat(part, v.shape[1]))], names=["variant", "fp"])

    return fps.select("fp").mapInArrow(run, "variant long, fp long")


def other_variants(rows: DataFrame) -> DataFrame:
    """(variant, fp) rows by (variant, sub): sub is each variant of the part left out within 2 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            variant, fp = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for a in range(0, len(fp), 4000):
                for k, (_, size) in enumerate(PARTS):
                    own = variant[a : a + 4000] >> 60 == k
                    v, f = variant[a : a + 4000][own], fp[a : a + 4000][own]
                    sub = ball(without(f, k)[1], size, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(v, sub.shape[1])), pa.array(sub.ravel()), pa.array(np.repeat(f, sub.shape[1]))], names=["variant", "sub", "fp"])

    return rows.select("variant", "fp").mapInArrow(run, "variant long, sub long, fp long")


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect whatever fingerprints within radius connect: a breadth-first forest, n - 1 links at most."""
    left, links = fps.view(np.uint64), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                links += [(int(np.int64(at.view(np.int64))), int(x)) for x in left[near].view(np.int64)]
                queue += list(left[near])
                left = left[~near]
    return links


def linked(groups: DataFrame, by: list[str], radius: int) -> DataFrame:
    """Verified links (a, b) inside each group of fingerprints; groups are of a bounded size."""

    def run(table: pa.Table) -> pa.Table:
        found = forest(np.unique(table.column("fp").to_numpy()), radius)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return groups.groupBy(*by).applyInArrow(run, "a long, b long")


def scanned(batches: Iterator[pa.RecordBatch], radius: int, direct: int) -> Iterator[pa.RecordBatch]:
    """Verified links of (variant, fp) rows that come sorted; the rows of a variant of over direct fingerprints as they are.

    A link has no variant, a row handed on has no b. What is held is one batch and direct rows at most.
    """

    def batch_of(variant: list, a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (variant, a, b)], names=["variant", "a", "b"])

    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    passing = None  # a variant that is over the limit
    for batch in chained(batches):
        new = held if batch is None else tuple(np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False))) for i, h in enumerate(held))
        v, f = new
        if passing is not None:
            n = int(np.searchsorted(v, passing, "right"))
            if n:
                yield batch_of(v[:n], f[:n], [None] * n)
                v, f = v[n:], f[n:]
            if len(v):
                passing = None
        cut = len(v) if batch is None or not len(v) else int(np.searchsorted(v, v[-1], "left"))
        held = (v[cut:], f[cut:])
        if len(held[0]) > direct:
            passing = int(v[-1])
            yield batch_of(held[0], held[1], [None] * len(held[0]))
            held = (v[:0], f[:0])
        v, f = v[:cut], f[:cut]
        starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate((starts, [len(v)])))
        two = starts[sizes == 2]
        close = two[np.bitwise_count((f[two] ^ f[two + 1]).view(np.uint64)) <= radius] if len(two) else two
        a, b = f[close].tolist(), f[close + 1].tolist()
        for k in np.flatnonzero((sizes > 2) & (sizes <= direct)):
            for x, y in forest(f[starts[k] : starts[k] + sizes[k]], radius):
                a.append(x)
                b.append(y)
        if a:
            yield batch_of([None] * len(a), a, b)
        for k in np.flatnonzero(sizes > direct):
            part = slice(starts[k], starts[k] + sizes[k])
            yield batch_of(v[part], f[part], [None] * int(sizes[k]))


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, and None for the end."""
    yield from batches
    yield None


def links(fps: DataFrame, radius: int = RADIUS, direct: int = DIRECT) -> DataFrame:
    """Links (a, b) between distinct fingerprints that differ in at most radius (at most 4) bits.

    The links connect the same fingerprints as all such pairs do. Variants are shuffled once and scanned in order. One
    of up to direct fingerprints is compared within; beyond, it is split by the variants within 2 bits of the part that it
    leaves out, and then a group has at most 44 x 254 distinct fingerprints.
    """
    if not 0 <= radius <= 4:
        raise ValueError("variants of 1 bit of two parts meet up to a radius of 4")
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a row becomes 131: adaptive execution would see but a few tasks' worth
    sorted_rows = variants(fps.repartition(tasks, "fp")).repartition("variant").sortWithinPartitions("variant", "fp")
    met = stored(sorted_rows.mapInArrow(lambda batches: scanned(batches, radius, direct), "variant long, a long, b long"), "met")
    out = met.where("b is not null").select("a", "b")
    large = met.where("b is null").select("variant", F.col("a").alias("fp"))
    if large.limit(1).count():
        out = out.unionAll(linked(other_variants(large), ["variant", "sub"], radius))
    return out.distinct()


def labelled(marked: DataFrame, radius: int) -> DataFrame:
    """fp, root (least fingerprint of its component), component_id (least key of its component); marked has key and fp."""
    classes = stored(marked.groupBy("fp").agg(F.min("key").alias("least")), "classes")
    of = stored(components(stored(links(classes, radius), "links"), "a", "b").withColumnRenamed("node", "fp"), "components")
    members = of.join(classes, "fp")
    least = members.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("__n"))
    joined = join_to_one(members, least, "root", of.count()).select("fp", "root", "component_id")
    single = classes.join(of, "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return joined.unionAll(single)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, fingerprint (16 hex digits), component_id (least key reachable over links).

    Null and wordless texts share fingerprint zero and are linked like any other. Rows with a null key are returned, and
    count for links, but a null is a component's least key only if it has no other. Repeated rows, equal texts: one
    component. An empty table gives an empty one; other columns are not read. The last join is on the fingerprint, of
    which each label is one row; the rows of a fingerprint that very many texts share are split by Spark's skew join.
    """
    marked = stored(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), ["key"], width, "text"), "fingerprints")
    found = marked.join(labelled(marked, radius), "fp")
    return found.select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near-duplicates: of each component its own row with the least key stays, of repeated rows one.

    A row is told by its key and its text's hash, as keys may repeat over unlike texts. Only these and fingerprints go
    through the search. Rows without a key stay only where their component has no row with one, and then one of them.
    Null and empty texts are one text; an empty table gives an empty one. All columns are kept, whatever their names: a
    row travels as one structure beside names that are this function's own.
    """
    own = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    marked = stored(fingerprints(docs.select(F.col(key).alias("key"), own.alias("hash"), F.col(text).alias("text")), ["key", "hash"], width, "text"), "fingerprints")
    order = F.struct(F.col("key").isNull().alias("bare"), "key", "hash")
    firsts = marked.groupBy("fp").agg(F.min(order).alias("first"))
    told = lambda key: [key.isNull().alias("bare"), F.coalesce(key.cast("string"), F.lit("")).alias("name")]
    heads = stored(firsts.join(labelled(marked, radius), "fp").groupBy("root").agg(F.min("first").alias("first")).select(*told(F.col("first.key")), F.col("first.hash").alias("hash")), "heads")
    rows = docs.select(*told(F.col(key)), own.alias("hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = ["bare", "name", "hash"]
    turn = Window.partitionBy(*same).orderBy("hash")
    single = rows.withColumn("turn", F.row_number().over(turn)).where("turn = 1")  # repeated rows go where they lie, before the one shuffle that the join needs too
    return single.join(heads, same, "left_semi").select("row.*")
