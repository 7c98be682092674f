"""Embedding near-duplicates (operator 11): a robust-pruned flat graph, built by shards, searched from medoids.

1. Equal vectors become one class with a count. Centroids are fitted on a bounded sample; every class is a member of the shards
   of its two nearest centroids, the nearest being its home. A shard over its bound is split by hash into parts.
2. Build: within a shard each node's nearest others and some of ever farther ranks are its candidates; robust pruning drops a candidate that
   is nearer to a kept one than, by the factor alpha, to the node. Candidates are of all ranks, so some edges are long. Edges run
   both ways.
3. The lists of all shards are united per node, and each shard gets those of its members.
4. Search: every class visits its shards. A beam search goes greedily from the shard's medoids (and from the class
   itself) to the nearest nodes; then the range expands: every node within the threshold hands on its neighbours until no new one
   is within it. Whoever is found is also a member elsewhere: its other shards are visited next, from it, until no visit
   is new. A link is counted at the found class's home, so that none counts twice.
5. A sample of classes is compared with all others by brute force: if less than `floor` of their links were found, the search
   is repeated with more shards and a wider beam.
6. Links are verified in double precision. A task hands on a spanning forest of its links, not all its pairs.

Each row is a vector of its own: of repeated rows each counts as another vector to the others. Null, zero or non-finite vectors
and vectors with a null component link with nothing, nor do vectors of unlike lengths. A null key counts as a vector;
the component's id is the least key that is not null, and null only where there is none. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import stored, trim
from rollbook.llm.components import components, join_to_one
from rollbook.llm.tokens import spread


@dataclass(frozen=True)
class Graph:
    """Parameters. What is fitted on a sample: centroids, on at most sample_rows classes of sample_bytes."""

    threshold: float = 0.9
    shard_rows: int = 4096  # members of a shard, give or take what hashing gives
    centroids: int = 32_768  # most of them; with more rows than these shards hold, shards have parts
    sample_rows: int = 131_072
    sample_bytes: int = 64 << 20
    degree: int = 20  # edges that a node keeps by pruning in one shard, and as many that others have to it
    pool: int = 32  # nearest candidates of a node; beyond them two of each band of ranks, and a band is half as wide again as the last
    alpha: float = 1.2
    medoids: int = 8
    beam: int = 48
    probes: int = 2  # nearest shards that a class visits at first: its own and, beyond two, more
    audited: int = 1024  # classes compared by brute force
    floor: float = 0.95
    tries: int = 3
    size: int = 8  # bytes of a component, told by the column


def class_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, class, raw): raw holds a vector's numbers, as floats where the column has floats, class their 128-bit hash; both
    are null if it cannot be linked."""
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("class", T.BinaryType()), T.StructField("raw", T.BinaryType())])

    kind = pa.float32() if width(df, vector) == 4 else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, out = batch.column(1), []
            values = column.values
            flat = values.cast(kind).fill_null(np.nan).to_numpy(zero_copy_only=False) + kind.to_pandas_dtype()(0)  # no negative zeros
            offsets, there = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
            for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), there.tolist(), strict=True):
                x = flat[a:b]
                out.append(x.tobytes() if ok and b > a and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else xxhash.xxh3_128_digest(x) for x in out], pa.binary()), pa.array(out, pa.binary())], names=schema.names)
        trim()

    return df.select(F.col(key).alias("key"), F.col(vector).alias("vector")).mapInArrow(run, schema)


def width(df: DataFrame, vector: str) -> int:
    """Bytes of a component: 4 for floats, 8 for any other numbers."""
    return 4 if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else 8


def matrix(raw: pa.ChunkedArray | pa.Array | list[bytes], size: int) -> np.ndarray:
    """Vectors, of size bytes a component, as rows of doubles."""
    parts = raw if isinstance(raw, list) else raw.to_pylist()
    return np.frombuffer(b"".join(parts), f"<f{size}").reshape(len(parts), -1).astype(np.float64) if parts else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component goes first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fitted(x: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """Centroids of unit vectors by cosine, from evenly chosen rows; one that nothing is nearest to stays where it was."""
    centres = x[np.linspace(0, len(x) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        sums = np.zeros(centres.shape)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1)
        moved = size > 1e-9
        centres[moved] = (sums[moved] / size[moved, None]).astype(centres.dtype)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    """The count nearest centres of each row, the nearest first; ties by number."""
    out = np.empty((len(x), min(count, len(centres))), np.int64)
    for a in range(0, len(x), block := max(1, (8 << 20) // len(centres))):
        sims = x[a : a + block] @ centres.T
        if out.shape[1] < len(centres):
            top = np.sort(np.argpartition(-sims, out.shape[1] - 1, axis=1)[:, : out.shape[1]], axis=1)
        else:
            top = np.broadcast_to(np.arange(len(centres)), sims.shape)
        out[a : a + block] = np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1)
    return out


def pruned(x: np.ndarray, own: np.ndarray, pool: np.ndarray, g: Graph) -> np.ndarray:
    """Robust pruning of each node's pool (local numbers, the nearest first, -1: none) to at most degree; the rest is -1.

    Where fewer than half of degree are left, the nearest of the others fill up: among copies all but one would go.
    """
    out = np.full((len(own), g.degree), -1, np.int64)
    for a in range(0, len(own), 256):
        p = pool[a : a + 256]
        safe = np.maximum(p, 0)
        points = x[safe]
        to_node = 1 - np.einsum("nkd,nd->nk", points, x[own[a : a + 256]])
        between = 1 - points @ points.transpose(0, 2, 1)
        alive = p >= 0
        kept, rows = np.zeros(p.shape, bool), np.arange(len(p))
        for d in range(g.degree):
            pick = np.argmax(alive, axis=1)  # the pool is in order
            some = alive[rows, pick]
            if not some.any():
                break
            out[a : a + 256][some, d] = p[some, pick[some]]
            alive &= ~((g.alpha * between[rows, pick] <= to_node) & some[:, None])
            alive[rows, pick] = False
            kept[rows[some], pick[some]] = True
        spare = (p >= 0) & ~kept
        fills = spare & (np.cumsum(spare, axis=1) <= g.degree // 2 - kept.sum(axis=1, keepdims=True))
        i, at = np.nonzero(fills)
        out[a + i, (np.cumsum(fills, axis=1) + kept.sum(axis=1, keepdims=True) - 1)[i, at]] = p[i, at]
    return out


def in_order(x: np.ndarray, own: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Each node's pool by nearness; itself and repeated entries become -1, at the end."""
    pool = np.sort(np.where(pool == own[:, None], -1, pool), axis=1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    sims = np.empty(pool.shape)
    for a in range(0, len(pool), 1024):
        sims[a : a + 1024] = np.einsum("nkd,nd->nk", x[np.maximum(pool[a : a + 1024], 0)], x[own[a : a + 1024]])
    sims[pool < 0] = -9
    return np.take_along_axis(pool, np.argsort(-sims, axis=1, kind="stable"), 1)


def build(x: np.ndarray, g: Graph, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of the graph over unit vectors, both ways, each list pruned."""
    n = len(x)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own, dice = np.arange(n), np.random.default_rng(seed)
    edges = [min(g.pool + 1, n)]
    while edges[-1] < n:
        edges.append(min(n, edges[-1] + edges[-1] // 2 + 1))
    pool = np.empty((n, edges[0] + 2 * (len(edges) - 1)), np.int64)
    for a in range(0, n, 512):
        sims = x[a : a + 512] @ x.T
        sims += dice.random(sims.shape, np.float32) * np.float32(1e-6)  # among copies each has others for its nearest
        ranked = np.argpartition(-sims, [e - 1 for e in edges], axis=1)
        drawn = [dice.integers(low, high, (len(sims), 2)) for low, high in zip(edges, edges[1:], strict=False)]
        pool[a : a + 512] = np.take_along_axis(ranked, np.concatenate((np.broadcast_to(np.arange(edges[0]), (len(sims), edges[0])), *drawn), axis=1), 1)
    forward = pruned(x, own, in_order(x, own, pool), g)
    a, d = np.nonzero(forward >= 0)
    b = forward[a, d]
    # Who names a node is a candidate of that node: the first degree of them, beside its own. So that none is left that no list
    # names, two of a node's five nearest name it in any case.
    order = np.argsort(b, kind="stable")
    nth = np.arange(len(b)) - np.searchsorted(b[order], b[order])
    back = np.full((n, g.degree), -1, np.int64)
    fits = nth < g.degree
    back[b[order][fits], nth[fits]] = a[order][fits]
    close = in_order(x, own, forward)[:, :5]
    some = (close >= 0).sum(axis=1)
    sure = np.concatenate((close[:, 0], close[own, (dice.random(n) * some).astype(int)]))
    both = in_order(x, own, np.concatenate((forward, back), axis=1))[:, : 2 * g.degree]
    a, d = np.nonzero(both >= 0)
    pairs = np.unique(np.concatenate((a * n + both[a, d], (sure * n + np.tile(own, 2))[sure >= 0])))
    return pairs // n, pairs % n


def entries(x: np.ndarray, count: int) -> np.ndarray:
    """Medoids: the node nearest to the mean, then again and again the node that is farthest from those chosen."""
    out = [int(np.argmax(x @ x.mean(axis=0)))]
    close = x @ x[out[0]]
    while len(out) < min(count, len(x)):
        out.append(int(np.argmin(close)))
        close = np.maximum(close, x @ x[out[-1]])
    return np.array(out)


class Searcher:
    """Beam search, then range expansion, for many queries side by side over one shard's graph."""

    def __init__(self, raw: np.ndarray, lists: list[np.ndarray], g: Graph) -> None:
        self.raw, self.x, self.g = raw, unit(raw).astype(np.float32), g
        self.sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.begins, self.flat = np.cumsum(self.sizes) - self.sizes, np.concatenate([np.zeros(0, np.int64), *lists])
        self.padded = np.concatenate((self.x, np.zeros((1, self.x.shape[1]), np.float32)))
        self.starts = entries(self.x, g.medoids)
        self.slack = max(1e-4, 2.4e-7 * raw.shape[1])

    def named(self, i: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query i beside each node on the list of its node k."""
        sizes = self.sizes[k]
        return np.repeat(i, sizes), self.flat[spread(self.begins[k], sizes)]

    def cosines(self, q: np.ndarray, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Of query i and node k, for each pair of them."""
        out = np.empty(len(i), np.float32)
        for a in range(0, len(i), 1 << 16):
            out[a : a + (1 << 16)] = np.einsum("nd,nd->n", q[i[a : a + (1 << 16)]], self.padded[k[a : a + (1 << 16)]])
        return out

    def meet(self, q: np.ndarray, sims: np.ndarray, i: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compares the pairs that are new, each once; returns these."""
        new = np.isnan(sims[i, k])
        pairs = np.unique(i[new] * sims.shape[1] + k[new])
        i, k = pairs // sims.shape[1], pairs % sims.shape[1]
        sims[i, k] = self.cosines(q, i, k)
        return i, k

    def linked(self, raw: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of every link found, in order; known holds a node for each query to start from too, or -1."""
        n, g = len(self.x), self.g
        q, rows = unit(raw).astype(np.float32), np.arange(len(raw))
        sims = np.full((len(raw), n + 1), np.nan, np.float32)  # not met yet: nan
        sims[:, n] = -9
        done = np.zeros((len(raw), n + 1), bool)
        done[:, n] = True
        start = np.concatenate((np.broadcast_to(self.starts, (len(raw), len(self.starts))), np.where(known < 0, n, known)[:, None]), axis=1)
        self.meet(q, sims, np.repeat(rows, start.shape[1]), start.ravel())
        beam = np.full((len(raw), g.beam), n)
        beam[:, : start.shape[1]] = start[:, : g.beam]
        while True:  # the beam's unexpanded nodes, a few at a time, until all are expanded
            order = np.argsort(-sims[rows[:, None], beam], axis=1, kind="stable")
            beam = np.take_along_axis(beam, order, 1)
            todo = ~done[rows[:, None], beam]
            todo &= np.cumsum(todo, axis=1) <= 8
            i, at = np.nonzero(todo)
            if not len(i):
                break
            k = beam[i, at]
            done[i, k] = True
            i, k = self.meet(q, sims, *self.named(i, k))
            if len(i):  # the new ones beside the beam, the best of all are the next beam
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                fresh = np.full((len(raw), int(nth.max()) + 1), n)
                fresh[i, nth] = k
                beam = np.concatenate((beam, fresh), axis=1)
                best = np.argpartition(-sims[rows[:, None], beam], g.beam - 1, axis=1)[:, : g.beam]
                beam = np.take_along_axis(beam, best, 1)
        least = g.threshold - self.slack
        with np.errstate(invalid="ignore"):
            i, k = np.nonzero((sims[:, :n] >= least) & ~done[:, :n])
        while len(i):
            done[i, k] = True
            reached = [self.meet(q, sims, *self.named(i[a : a + 16384], k[a : a + 16384])) for a in range(0, len(i), 16384)]
            i, k = (np.concatenate([r[s] for r in reached]) for s in (0, 1))
            near = (sims[i, k] >= least) & ~done[i, k]
            i, k = i[near], k[near]
        with np.errstate(invalid="ignore"):
            i, k = np.nonzero(sims[:, :n] >= least)
        sure = sims[i, k] >= g.threshold + self.slack
        doubt = np.flatnonzero(~sure)
        for a in range(0, len(doubt), 1 << 14):
            at = doubt[a : a + (1 << 14)]
            sure[at] = exact(raw[i[at]], self.raw[k[at]]) >= g.threshold
        return i[sure], k[sure]


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision."""
    x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def forest(i: np.ndarray, k: np.ndarray, n: int) -> np.ndarray:
    """The least number reachable from each of n numbers by the links i - k."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[k])
        before = root.copy()
        np.minimum.at(root, i, least)
        np.minimum.at(root, k, least)
        root = root[root]
        if np.array_equal(root, before):
            return root


@dataclass
class Shards:
    """members: (shard, id, raw, n, home, other): a row for each class and shard of it, dealt anew whenever it is read. centres
    and parts are what deals them."""

    members: DataFrame
    centres: np.ndarray
    parts: dict[int, int]


def shard_number(cell: np.ndarray, ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (cell << 24) + (mixed % parts.astype(np.uint64)).astype(np.int64)


def dealt(classes: DataFrame, g: Graph, total: int, dim: int) -> Shards:
    """Every class at its two nearest centroids."""
    rows = max(1, min(g.sample_rows, g.sample_bytes // (8 * dim)))
    size = g.size
    count = max(1, min(g.centroids, rows, math.ceil(2 * total / g.shard_rows)))
    share = min(1.0, min(rows, max(4096, 4 * count)) / total)
    sample = classes.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("raw").limit(2 * rows)
    x = unit(matrix(sample.toArrow()["raw"], size)).astype(np.float32)
    if not len(x):
        x = unit(matrix([classes.first()["raw"]], size)).astype(np.float32)
    centres = fitted(x, min(count, len(x)))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = nearest(unit(matrix(batch.column(0), size)).astype(np.float32), centres, 2)
                numbers, n = np.unique(near, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(n, pa.int64())], names=["cell", "n"])
        trim()

    held = classes.select("raw").mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # a row for each centroid
    parts = {r["cell"]: math.ceil(r["n"] / g.shard_rows) for r in held}

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near, ids = nearest(unit(matrix(batch.column("raw"), size)).astype(np.float32), centres, 2), batch.column("id").to_numpy()
            own = np.stack([shard_number(c, ids, np.array([parts[x] for x in c.tolist()])) for c in near.T])
            home, other = own[0], own[-1]
            for shard in own:
                yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column("id"), batch.column("raw"), batch.column("n"), pa.array(home), pa.array(other)], names=["shard", "id", "raw", "n", "home", "other"])
        trim()

    shape = "shard long, id long, raw binary, n long, home long, other long"
    return Shards(classes.select("id", "raw", "n").mapInArrow(members, shape), centres, parts)


def united(shards: Shards, g: Graph) -> DataFrame:
    """The members with the union of their lists in all shards: (shard, id, raw, n, home, other, edges)."""

    def run(rows: pa.Table) -> pa.Table:
        ids = rows["id"].to_numpy()
        order = np.argsort(ids, kind="stable")  # the same graph whatever the rows' order
        a, b = build(unit(matrix(rows["raw"], g.size))[order].astype(np.float32), g, int(rows["shard"][0].as_py() & 0xFFFFFFFF))
        ids = ids[order]
        begins = np.searchsorted(a, np.arange(len(ids) + 1))
        return pa.table({"id": ids, "edges": pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids[b]))})

    lists = shards.members.select("shard", "id", "raw").groupBy("shard").applyInArrow(run, "id long, edges array<long>")
    union = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges"))  # of two shards
    return stored(shards.members.join(union, "id"), "graph")


def first_visits(classes: DataFrame, shards: Shards, g: Graph) -> DataFrame:
    """(shard, id, raw, entry): every class at the shards of its nearest centroids, at all parts of them. raw is null where the
    class is a member, as its vector is there."""
    centres, parts, size, probes = shards.centres, shards.parts, g.size, g.probes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near, ids = nearest(unit(matrix(batch.column("raw"), size)).astype(np.float32), centres, probes), batch.column("id").to_numpy()
            for nth, cell in enumerate(near.T):
                split = np.array([parts.get(c, 0) for c in cell.tolist()])
                at = np.repeat(np.arange(len(cell)), split)
                shard = (cell[at] << 24) + np.arange(len(at)) - np.repeat(np.cumsum(split) - split, split)
                there = (shard == shard_number(cell[at], ids[at], split[at])) & (nth < 2)
                raw = batch.column("raw").take(pa.array(at, mask=there))
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(ids[at]), raw, pa.nulls(len(at), pa.int64())], names=["shard", "id", "raw", "entry"])
        trim()

    return classes.select("id", "raw").mapInArrow(run, "shard long, id long, raw binary, entry long")


#: Queries that go side by side through a shard, and those that one task takes; more visits to a shard are more tasks.
SIDE, VISITS = 256, 4096


def visited(graph: DataFrame, visits: DataFrame, g: Graph) -> DataFrame:
    """What the visits find: (kind, a, b, raw): 0: query a has b linked vectors at home here; 1: a and b are of one component; 2: query a goes on to shard b, entering at c."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[], [], [], []]

        def add(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None) -> None:
            for column, values in zip(out, (np.full(len(a), kind), a, b, np.zeros(len(a), np.int64) if c is None else c), strict=True):
                column.append(np.asarray(values, np.int64))

        if rows.num_rows and asked.num_rows:
            ids = rows["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            lists = rows["edges"].combine_chunks().fill_null([]).take(pa.array(order))
            flat, offsets = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum([len(x) for x in lists])))
            place = np.searchsorted(ids, flat)
            here = (place < len(ids)) & (ids[np.minimum(place, len(ids) - 1)] == flat)
            raw = matrix(rows["raw"], g.size)[order]
            n, home, other = (rows[c].to_numpy()[order] for c in ("n", "home", "other"))
            searcher = Searcher(raw, [place[a:b][here[a:b]] for a, b in zip(offsets, offsets[1:], strict=False)], g)
            shard = rows["shard"][0].as_py()
            q_ids, q_entry = asked["id"].to_numpy(), asked["entry"].fill_null(-1).to_numpy()
            given = asked["raw"].is_valid().to_numpy()
            q_raw = raw[np.minimum(np.searchsorted(ids, q_ids), len(ids) - 1)]
            q_raw[given] = matrix(asked["raw"].drop_null(), g.size).reshape(-1, raw.shape[1])
            pairs = []
            for a in range(0, len(q_ids), SIDE):
                q = q_ids[a : a + SIDE]
                known = np.minimum(np.searchsorted(ids, q), len(ids) - 1)
                enter = np.minimum(np.searchsorted(ids, q_entry[a : a + SIDE]), len(ids) - 1)
                known = np.where(ids[known] == q, known, np.where(ids[enter] == q_entry[a : a + SIDE], enter, -1))
                i, k = searcher.linked(q_raw[a : a + SIDE], known)
                apart = ids[k] != q[i]
                i, k = i[apart], k[apart]
                here_now = home[k] == shard
                add(0, q, np.bincount(i[here_now], n[k[here_now]], len(q)).astype(np.int64))
                pairs.append((i + a, k))
                for to in (home, other):
                    on = np.flatnonzero(to[k] != shard)
                    if len(on):
                        went, at = np.unique(np.column_stack((i[on], to[k[on]])), axis=0, return_index=True)
                        add(2, q[went[:, 0]], went[:, 1], ids[k[on][at]])
            every, at = np.unique(np.concatenate((ids, q_ids)), return_inverse=True)
            i, k = np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
            root = forest(at[len(ids) :][i], at[:len(ids)][k], len(every))
            moved = np.flatnonzero(root != np.arange(len(every)))
            add(1, every[moved], every[root[moved]])
        return pa.table([np.concatenate([np.zeros(0, np.int64), *column]) for column in out], names=["kind", "a", "b", "c"])

    blocks = visits.groupBy("shard").agg(F.ceil(F.count("*") / VISITS).alias("blocks"))
    of = visits.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).drop("blocks")
    copies = graph.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    return of.groupBy("shard", "block").cogroup(copies.groupBy("shard", "block")).applyInArrow(lambda l, r: run(l, r), "kind long, a long, b long, c long")


def searched(classes: DataFrame, shards: Shards, graph: DataFrame, g: Graph) -> tuple[DataFrame, DataFrame]:
    """(id, n): linked vectors of each class, but for its own copies; (a, b): links that span the components."""
    visits = stored(first_visits(classes, shards, g), "visits")
    went, found = visits.select("shard", "id"), []
    while True:
        got = stored(visited(graph, visits, g), "found")
        found.append(got)
        onward = got.where("kind = 2").groupBy(F.col("b").alias("shard"), F.col("a").alias("id")).agg(F.min("c").alias("entry")).join(went, ["shard", "id"], "left_anti")
        visits = stored(onward.join(classes.select("id", "raw"), "id").select("shard", "id", "raw", "entry"), "visits")
        if visits.isEmpty():
            break
        went = went.unionByName(visits.select("shard", "id"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    counts = every.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("n"))
    return counts, every.where("kind = 1").select("a", "b")


def audit(classes: DataFrame, counts: DataFrame, g: Graph, total: int) -> float:
    """Share of the true links that was found, for a sample of classes compared with all."""
    share = min(1.0, g.audited / total)
    sample = classes.where(F.pmod(F.xxhash64("id", F.lit(12)), F.lit(1 << 30)) <= int(share * (1 << 30))).select("id", "raw").limit(2 * g.audited).toArrow()
    if not sample.num_rows:
        return 1.0
    x, ids = unit(matrix(sample["raw"], g.size)), sample["id"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(x), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                near = (x @ unit(matrix(part.column(1), g.size)).T >= g.threshold) & (ids[:, None] != part.column(0).to_numpy()[None])
                sums += near @ part.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums)], names=["id", "true"])
        trim()

    true = classes.select("id", "raw", "n").mapInArrow(run, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    got = true.join(counts, "id", "left").agg(F.sum(F.least("true", F.coalesce("n", F.lit(0)))), F.sum("true")).first()
    return got[0] / got[1] if got[1] else 1.0


def linked_classes(classes: DataFrame, g: Graph, total: int, dim: int) -> tuple[DataFrame, DataFrame, float]:
    """Counts, spanning links and audited recall of classes of one length."""
    shards = dealt(classes, g, total, dim)
    graph = united(shards, g)
    for _ in range(g.tries):
        counts, links = searched(classes, shards, graph, g)
        counts = stored(counts, "counts")
        recall = audit(classes, counts, g, total)
        if recall >= g.floor:
            break
        g = replace(g, probes=4 * g.probes, beam=2 * g.beam)
    return counts, links, recall


def near_duplicate_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", g: Graph | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    g = replace(g or Graph(), size=width(df, vector))
    rows = class_rows(df, key, vector)
    whole = stored(rows.where("raw is not null").groupBy("class").agg(F.first("raw").alias("raw"), F.min("key").alias("head"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "classes")
    rows = stored(rows.select("key", "class"), "vectors")
    counts = links = None
    for dim, total in sorted((r[0], r[1]) for r in whole.groupBy((F.length("raw") / g.size).cast("int")).count().collect()):  # a round for each length of vectors
        own = whole.where(F.length("raw") == g.size * dim)
        c, l, _ = linked_classes(own, g, total, dim)
        counts, links = (c, l) if counts is None else (counts.unionByName(c), links.unionByName(l))
    alone = rows.where("class is null").select(F.col("key").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    if counts is None:
        return alone.withColumn("kept", F.lit(True))
    roots = components(links, "a", "b")
    placed = stored(whole.select("id", "class", "head", "n").join(counts.withColumnRenamed("n", "others"), "id").join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")), "placed")
    total = placed.count()
    least = placed.groupBy("root").agg(F.min("head").alias("component_id"), F.count("*").alias("__n"))
    found = join_to_one(placed.select("root", "class", F.col("n").alias("copies"), (F.col("others") + F.col("n") - 1).alias("n_links")), least, "root", total)
    one = stored(found.select("class", "n_links", "component_id", F.col("copies").alias("__n")), "linked")
    linked = join_to_one(rows.where("class is not null").select(F.col("key").alias("vec_id"), "class"), one, "class", rows.count())
    out = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
