"""Pieces that several operators share: key hashing, the shared folder, batched text transforms."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes 0x20 and 0x09-0x0D, the separators of words; bytes.split() uses the same six.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Texts of a batch are handed to numpy in slices of about so many bytes, whatever Arrow's batch size is.
SLICE_BYTES = 4 << 20


def crc_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo modulus; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only local mode may leave it unset: a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rollbook-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def passing(spark: SparkSession, path: str) -> None:
    """Has the path deleted when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def stored(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df written as a table in the shared folder and read again: computed once, with no lineage to lose.

    The table lives as long as the application. by: columns whose values are folders of their own.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    passing(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def trim() -> None:
    """Gives freed memory back to the machine, as a worker process waits for its next task with whatever it still holds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def slices(texts: list, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most bytes each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def map_texts(df: DataFrame, keep: list[str], text: str, made: list[T.StructField], work: Callable[[list[bytes]], list[list]]) -> DataFrame:
    """keep columns of df beside the columns that work makes of each slice of texts.

    The scan's partitions are kept: no shuffle. work gets UTF-8 bytes (null: empty) and returns one list per made field.
    """
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, *made])
    arrow = [pa_type(f.dataType) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column(len(keep)))
            for a, b in slices(texts):
                got = work(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(keep))] + [pa.array(x, t) for x, t in zip(got, arrow, strict=True)], names=schema.names)
        trim()

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def pa_type(kind: T.DataType) -> pa.DataType:
    return {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}[type(kind)]


def filter_texts(df: DataFrame, text: str, keep: Callable[[list[bytes]], list[bool]]) -> DataFrame:
    """Rows of df whose text keep() accepts (null: as empty); every column passes through as it is, whatever its name."""
    names, at = df.columns, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column(at))
            mask = [x for a, b in slices(texts) for x in keep(texts[a:b])]
            yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array(mask, pa.bool_()))
        trim()

    return df.mapInArrow(run, df.schema)


def sampled(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """About rows rows of df, the same for the same data: those whose hash falls under rows / count, wherever they are.

    The hash is of the key and, if there is one, the text. rows is the documented bound of a training sample; who brings
    a sample to the driver also limits it to twice as much, for tables of which one row is repeated very often.
    """
    n = df.count()
    if n <= rows:
        return df
    share = int(rows / n * (1 << 30))
    parts = [F.col(key).cast("string"), *([F.col("text")] if "text" in df.columns else [])]
    return df.where(F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 30)) < share)


def gathered(sample: DataFrame, size: Column, most: int, seed: int) -> pa.Table:
    """A training sample's rows on the driver, about most bytes of them by their own size: all, or those of the least hashes.

    Which rows these are depends on the rows alone. A row of over a hundredth of most does not fit a sample that is cut:
    the bound holds then, and the documented sizes are such that only a cut sample of very long texts meets it.
    """
    kept = stored(sample.withColumn("__size", size.cast("long")), "sample")
    total = kept.agg(F.coalesce(F.sum("__size"), F.lit(0))).first()[0]
    if total > most:
        share = int(most / total * (1 << 30))
        kept = kept.where((F.pmod(F.xxhash64(*sample.columns, F.lit(seed)), F.lit(1 << 30)) < share) & (F.col("__size") <= most // 100))
    return kept.drop("__size").toArrow()
