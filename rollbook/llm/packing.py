"""Packing (operator 7): bounded-space online best fit into windows of a fixed number of tokens.

Each partition keeps a fixed number of open windows. A document gives full windows of its own first; its rest goes to the
open window that it fills best, and if it fits none, it tops up the fullest one, which is emitted. Windows still open at
the end of a partition are poured together, first within it and then over groups of partitions, until one is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import stored, trim
from rollbook.llm.tokens import blocks, encoder

#: Partitions whose left-over windows meet in one task of a merge round.
MERGE_WIDTH = 64
WIDTH = 4  # bytes of an id


@dataclass
class Window:
    number: int
    used: int = 0
    pieces: list[tuple] = field(default_factory=list)  # (doc_id, start, ids, doc_tokens)

    def put(self, doc_id, start: int, ids: bytes, total: int) -> None:
        self.pieces.append((doc_id, start, ids, total))
        self.used += len(ids) // WIDTH


class Packer:
    """Feeds documents in, gives finished windows out. first numbers the windows."""

    def __init__(self, size: int, open_windows: int, least_piece: int, first: int) -> None:
        self.size, self.most, self.least, self.next, self.open = size, open_windows, least_piece, first, []

    def window(self) -> Window:
        self.next += 1
        return Window(self.next - 1)

    def add(self, doc_id, ids: bytes) -> Iterator[Window]:
        total = len(ids) // WIDTH
        at = 0
        while total - at >= self.size:
            w = self.window()
            w.put(doc_id, at, ids[at * WIDTH : (at + self.size) * WIDTH], total)
            at += self.size
            yield w
        if at == total:
            return
        rest = total - at
        best = min((w for w in self.open if self.size - w.used >= rest), key=lambda w: self.size - w.used, default=None)
        if best is None:
            if len(self.open) == self.most:
                full = max(self.open, key=lambda w: w.used)
                if (gap := self.size - full.used) >= self.least:
                    full.put(doc_id, at, ids[at * WIDTH : (at + gap) * WIDTH], total)
                    at += gap
                self.open.remove(full)
                yield full
            self.open.append(best := self.window())
        best.put(doc_id, at, ids[at * WIDTH :], total)
        if best.used == self.size:
            self.open.remove(best)
            yield best


def pour(windows: list[Window], size: int) -> list[Window]:
    """The windows' contents, the emptiest poured into the fullest: all but the last are full."""
    left = sorted(windows, key=lambda w: (-w.used, w.number))
    done: list[Window] = []
    while left:
        w = left.pop(0)
        while w.used < size and left:
            source = left[-1]
            doc_id, start, ids, total = source.pieces.pop()
            gap = (size - w.used) * WIDTH
            w.put(doc_id, start, ids[:gap], total)
            source.used -= min(gap, len(ids)) // WIDTH
            if len(ids) > gap:
                source.pieces.append((doc_id, start + gap // WIDTH, ids[gap:], total))
            elif not source.pieces:
                left.pop()
        done.append(w)
    return done


def piece_schema(docs: DataFrame, key: str) -> T.StructType:
    named = [(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    return T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(n, t) for n, t in named), T.StructField("ids", T.BinaryType())])


def rows_of(w: Window, is_open: bool) -> list[tuple]:
    """A row for each piece; an open window's rows still carry their ids."""
    rows, at = [], 0
    for doc_id, start, ids, total in w.pieces:
        rows.append((doc_id, start, len(ids) // WIDTH, zlib.crc32(ids), total, w.number, at, ids if is_open else None))
        at += len(ids) // WIDTH
    return rows


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def pack(docs: DataFrame, vocabulary: str, size: int = 4096, end_id: int = 2, open_windows: int = 32, least_piece: int = 16, key: str = "doc_id", text: str = "text", kind: str = "words") -> DataFrame:
    """A row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is a document of the end id alone. A document longer than a window is cut into full windows and
    a rest. Repeated rows are packed as often as they occur; null keys are carried along; an empty table gives an empty
    one; other columns are not read. A partition holds open_windows x size ids at most, a merge task MERGE_WIDTH x size.
    """
    schema = piece_schema(docs, key)
    end = int(end_id).to_bytes(WIDTH, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = encoder(vocabulary, kind).encode, arrow_schema(schema)
        packer = Packer(size, open_windows, least_piece, TaskContext.get().partitionId() << 32)
        rows: list[tuple] = []
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b in blocks(batch.column(1)):
                ids, begin = encode(batch.column(1).slice(a, b - a))
                laid, at = ids.tobytes(), (begin * WIDTH).tolist()
                for doc_id, x, y in zip(names[a:b], at, at[1:], strict=False):
                    for w in packer.add(doc_id, laid[x:y] + end):
                        rows += rows_of(w, False)
                if len(rows) >= 5000:
                    yield batch_of(rows, out)
                    rows = []
        left = pour(packer.open, size)
        for w in left:
            rows += rows_of(w, w.used < size)
        yield batch_of(rows, out)
        trim()

    def merge(table: pa.Table) -> pa.Table:
        out = arrow_schema(schema)
        windows: dict[int, Window] = {}
        for r in sorted(table.select(schema.names).to_pylist(), key=lambda r: (r["sequence_id"], r["offset"])):
            windows.setdefault(r["sequence_id"], Window(r["sequence_id"])).put(r[key], r["start"], r["ids"], r["doc_tokens"])
        done = pour(list(windows.values()), size)
        return pa.Table.from_batches([batch_of([row for w in done for row in rows_of(w, w.used < size)], out)])

    pieces = stored(docs.select(key, F.col(text)).mapInArrow(run, schema), "pieces")
    finished, left = [pieces.where("ids is null").drop("ids")], pieces.where("ids is not null")
    width = 1
    while left.select("sequence_id").distinct().count() > 1:
        width *= MERGE_WIDTH
        group = F.expr(f"shiftright(sequence_id, 32) div {width}")
        merged = stored(left.withColumn("__group", group).groupBy("__group").applyInArrow(merge, schema), "leftovers")
        finished.append(merged.where("ids is null").drop("ids"))
        left = merged.where("ids is not null")
    out = left.drop("ids")
    for part in finished:
        out = out.unionAll(part)
    return out
