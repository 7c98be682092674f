"""Secret scans (operator 4): fixed patterns, and probabilistic automata inferred from labelled credentials.

A candidate is any run of credential characters. Its score under an automaton is the log-likelihood of the whole run, its
end included, minus that under a background chain learned from ordinary runs. An automaton for each kind of labelled
credential is learned (automata.py); its threshold comes from labelled credentials held out of its learning, and from
ordinary runs. Candidates over some automaton's threshold that touch no pattern match are added to these.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.automata import ALPHABET, CLASSES, CODE, EVIDENCE, LONGEST_PREFIX, Automaton, Chain, chain, chain_counted, class_pairs, count_states, infer, infer_counted, joined
from rollbook.llm.common import map_texts, raw_texts, slices, stored, trim

# The patterns of the contract, over lower-cased bytes for assign, and least lengths.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "format")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
HEX_MASK = bytes(0x68 if b in b"0123456789abcdef" else 0x20 for b in range(256))

#: A candidate is a run of so many credential characters, as few as a credential of the patterns may have.
MIN_CANDIDATE = 8
#: Scores are counted in so many steps a nat for the thresholds.
SCORE_STEPS = 100
#: Least score of a candidate that is added, in nats: a run that is e**9 times likelier as a credential than as ordinary.
LEAST_SCORE = 9.0

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALNUM = _UPPER + _LOWER + _DIGITS
#: Credential formats as their issuers document them, as parts: a literal, or an alphabet and a length.
PUBLISHED = {
    "aws-secret": [(_ALNUM + "/+", 40)],
    "aws-session": ["ASIA", (_UPPER + _DIGITS, 16)],
    "aws-access": ["AKIA", (_UPPER + _DIGITS, 16)],
    "github": ["ghp_", (_ALNUM, 36)],
    "gitlab": ["glpat-", (_ALNUM + "_-", 20)],
    "google": ["AIza", (_ALNUM + "_-", 35)],
    "npm": ["npm_", (_ALNUM, 36)],
    "sendgrid": ["SG.", (_ALNUM + "_-", 22), ".", (_ALNUM + "_-", 43)],
    "slack": ["xoxb-", (_DIGITS, 12), "-", (_DIGITS, 12), "-", (_ALNUM, 24)],
    "stripe": ["sk_live_", (_ALNUM, 24)],
}


def published_examples(each: int, seed: int = 17) -> dict[str, list[bytes]]:
    """Credentials drawn by chance in each published format: labelled examples of formats that a corpus may lack."""
    r = np.random.default_rng(seed)
    draw = lambda part: part if isinstance(part, str) else "".join(part[0][i] for i in r.integers(0, len(part[0]), part[1]))
    return {name: ["".join(map(draw, parts)).encode() for _ in range(each)] for name, parts in PUBLISHED.items()}


@dataclass(frozen=True)
class Formats:
    """Automata by name, the score from which each finds a credential, and the background."""

    automata: dict[str, Automaton]
    thresholds: dict[str, float]
    background: Chain

    def margins(self, values: list[bytes]) -> np.ndarray:
        """By how much each value's score is over the threshold of the automaton that it is most over; -inf if there is none."""
        codes, starts, sizes = joined(values)
        base, best = self.background.scores(codes, starts, sizes), np.full(len(values), -np.inf)
        for name, a in self.automata.items():
            best = np.maximum(best, a.scores(codes, starts, sizes) - base - self.thresholds[name])
        return best


#: Nothing learned: the patterns alone.
NO_FORMATS = Formats({}, {}, chain([]))


def learn_kind(values: list[bytes], ordinary: list[bytes], background: Chain) -> tuple[Automaton, float]:
    """The automaton of labelled credentials and its threshold.

    Every fifth is held out. The threshold is nine tenths of the score that all but one in fifty of the held-out ones
    reach, but no less than LEAST_SCORE and what all but one in a hundred ordinary runs stay under (one in a hundred may
    be a credential that no pattern matches). Under five held-out ones the learned ones stand in for them.
    """
    held = values[::5] if len(values) >= 25 else []
    learned = [v for i, v in enumerate(values) if i % 5] if held else values
    automaton = infer(learned)

    def scores(x: list[bytes]) -> np.ndarray:
        parts = joined(x)
        return automaton.scores(*parts) - background.scores(*parts)

    reached = float(np.quantile(scores(held or learned), 0.02))
    usual = float(np.quantile(scores(ordinary), 0.99)) if ordinary else 0.0
    return automaton, max(LEAST_SCORE, usual, 0.9 * reached)


def base_matches(raw: bytes) -> dict[str, list[tuple[int, int, bytes]]]:
    """Start, end (bytes) and credential of the pattern matches of each kind, leftmost and non-overlapping."""
    out: dict[str, list[tuple[int, int, bytes]]] = {"assign": [], "access": [], "hex": []}
    low = raw.lower()
    if any(w in low for w in WORDS):
        out["assign"] = [(m.start(), m.end(), raw[m.start(2) : m.end(2)]) for m in ASSIGN.finditer(low) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in raw:
        out["access"] = [(m.start(), m.end(), m.group()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 16]
    if b"h" * 32 in raw.translate(HEX_MASK):
        out["hex"] = [(m.start(), m.end(), m.group()) for m in HEX.finditer(raw)]
    return out


def candidate_runs(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, and begin, end and text of each run of MIN_CANDIDATE and more credential characters in them.

    Full stops, hyphens and equals signs behind a run belong to the sentence.
    """
    data = b"".join([t + b"\n" for t in texts])
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], CODE[raw] < len(ALPHABET), [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2].copy()
    wide = ends - starts >= MIN_CANDIDATE
    starts, ends = starts[wide], ends[wide]
    while len(cut := np.flatnonzero((ends > starts) & np.isin(raw[ends - 1], list(b".=-")))):
        ends[cut] -= 1
    wide = ends - starts >= MIN_CANDIDATE
    starts, ends = starts[wide], ends[wide]
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return data, starts, ends, np.searchsorted(text_ends, starts, "right")


@dataclass
class Scanned:
    """Of one text: pattern matches by kind; all other candidates as begin, end, margin. By byte."""

    base: dict[str, list[tuple[int, int, bytes]]]
    candidates: list[tuple[int, int, float]]

    def found(self) -> list[tuple[int, int]]:
        return [(a, b) for a, b, m in self.candidates if m >= 0]


def scan(texts: list[bytes], formats: Formats) -> list[Scanned]:
    """Pattern matches of each text, and the margins of all candidates that touch none of them; equal runs are scored once."""
    data, starts, ends, of = candidate_runs(texts)
    strings = pa.array([data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()).dictionary_encode()
    margin = formats.margins(strings.dictionary.to_pylist())[strings.indices.to_numpy()] if len(starts) else np.zeros(0)
    begins = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
    bounds = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
    a, b = (starts - begins[of]).tolist(), (ends - begins[of]).tolist()
    out = []
    for k, raw in enumerate(texts):
        base = base_matches(raw)
        taken = [(x, y) for v in base.values() for x, y, _ in v]
        own = zip(a[bounds[k] : bounds[k + 1]], b[bounds[k] : bounds[k + 1]], margin[bounds[k] : bounds[k + 1]].tolist(), strict=True)
        out.append(Scanned(base, [c for c in own if not any(c[0] < y and x < c[1] for x, y in taken)] if taken else list(own)))
    return out


def code_points(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans as code-point spans."""
    if not spans or raw.isascii():
        return spans
    starts = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(starts[a]), int(starts[b])) for a, b in spans]


def learn_formats(docs: DataFrame, published: int = 100, text: str = "text") -> Formats:
    """Automata, background and thresholds from the distinct credentials and ordinary runs of all documents.

    The labels are the pattern matches, of any length, and published examples of each published format (0: none); runs of
    credential characters that no pattern matches are the ordinary ones. States, transitions, the background chain and the
    distributions of scores are counted on the executors: beginnings that EVIDENCE credentials share are states, rarer ones
    are one state at each distance. Counts by state come to the driver, never credentials or runs. Null texts and repeated
    rows are taken as they are: equal values count once.
    """
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.BinaryType())])

    def run(batches):
        for batch in batches:
            texts = raw_texts(batch.column(0))
            for a, b in slices(texts):
                seen: set[tuple[str, bytes]] = set()  # ordinary words come again and again
                for raw, got in zip(texts[a:b], scan(texts[a:b], NO_FORMATS), strict=True):
                    seen.update((k, v) for k, x in got.base.items() for _, _, v in x)
                    seen.update(("ordinary", raw[x:y]) for x, y, _ in got.candidates)
                rows = list(seen)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["kind", "value"])
        trim()

    found = stored(docs.select(text).mapInArrow(run, schema).distinct().withColumn("held", F.pmod(F.xxhash64("value"), F.lit(5)) == 0), "credentials")
    sizes = found.groupBy("kind", F.length("value").alias("size"), "held").count().collect()
    kinds = sorted({r.kind for r in sizes} - {"ordinary"})
    apart = {k for k in kinds if sum(r["count"] for r in sizes if r.kind == k) >= 25 and any(r.held for r in sizes if r.kind == k)}
    learned = found.where((F.col("kind") != "ordinary") & ~(F.col("held") & F.col("kind").isin(*apart)))
    begin = F.explode(F.sequence(F.lit(1), F.least(F.length("value"), F.lit(LONGEST_PREFIX))))
    begins = learned.select("kind", "value", begin.alias("d")).groupBy("kind", F.expr("substring(value, 1, d)").alias("begin")).count().where(F.col("count") >= EVIDENCE).collect()
    frequent = {k: {bytes(r.begin) for r in begins if r.kind == k} for k in kinds}
    far = {}
    for k in kinds:  # as many characters as EVIDENCE credentials have
        lengths = sorted(((r["size"], r["count"]) for r in sizes if r.kind == k), reverse=True)
        reached = np.cumsum([n for _, n in lengths])
        far[k] = max(LONGEST_PREFIX, lengths[at][0] if (at := int(np.searchsorted(reached, EVIDENCE))) < len(lengths) else 0)

    def states(values, kind):
        taken, rest = count_states(values, frequent[kind], far[kind])
        return [(kind, x, k if isinstance(k, bytes) else None, -1 if isinstance(k, bytes) else k, c, n) for x, counts in (("taken", taken), ("rest", rest)) for (k, c), n in counts.items()]

    def pairs(values, kind):
        return [(kind, "pairs", None, i, j, int(n)) for (i, j), n in np.ndenumerate(class_pairs(values)) if n]

    counted = tallied(learned, states) + tallied(found.where(F.col("kind") == "ordinary"), pairs)
    every = np.zeros((len(CLASSES) + 1, len(CLASSES)), np.int64)
    taken, rest = ({k: Counter() for k in kinds} for _ in range(2))
    for r in counted:
        if r.what == "pairs":
            every[r.at, r.x] = r.n
        else:
            (taken if r.what == "taken" else rest)[r.kind][bytes(r.begin) if r.begin is not None else r.at, r.x] = r.n
    background = chain_counted(every)
    examples = {name: learn_kind(x, [], background) for name, x in published_examples(published).items() if x}
    automata = {k: infer_counted(taken[k], rest[k], far[k]) for k in kinds} | {name: a for name, (a, _) in examples.items()}

    def scored(values, kind):
        parts = joined(values)
        base, out = background.scores(*parts), []
        for name in automata if kind == "ordinary" else [kind]:
            bins, n = np.unique(np.floor(SCORE_STEPS * np.clip(automata[name].scores(*parts) - base, -1000, 1000)).astype(int), return_counts=True)
            out += [(name, kind, None, 0, int(b), int(c)) for b, c in zip(bins, n, strict=True)]
        return out

    tested = found.where((F.col("kind") == "ordinary") | F.col("held") | ~F.col("kind").isin(*apart))
    scores = tallied(tested, scored)

    def quantile(name: str, kind: str, share: float) -> float:
        rows = sorted((r.x, r.n) for r in scores if r.kind == name and r.what == kind)
        below = np.cumsum([n for _, n in rows])
        return rows[int(np.searchsorted(below, share * below[-1]))][0] / SCORE_STEPS if rows else 0.0

    least = {k: 0.9 * quantile(k, k, 0.02) for k in kinds} | {name: t for name, (_, t) in examples.items()}
    return Formats(automata, {name: max(LEAST_SCORE, quantile(name, "ordinary", 0.99) + 1 / SCORE_STEPS, t) for name, t in least.items()}, background)


def tallied(values: DataFrame, count: Callable[[list[bytes], str], list[tuple]]) -> list:
    """Rows kind, what, begin, at, x, n: what count tells of each batch's values of a kind, summed over all."""
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("what", T.StringType()), T.StructField("begin", T.BinaryType()), *(T.StructField(c, T.IntegerType()) for c in ("at", "x")), T.StructField("n", T.LongType())])
    types = [pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]

    def run(batches):
        for batch in batches:
            of, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [r for kind in sorted(set(of)) for r in count([v for v, k in zip(raw, of, strict=True) if k == kind], kind)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=schema.names)

    made = values.select("kind", "value").mapInArrow(run, schema)
    return made.groupBy("kind", "what", "begin", "at", "x").agg(F.sum("n").alias("n")).collect()


def listed(raw: bytes, by_kind: dict[str, list[tuple[int, int]]]) -> str:
    """kind:start:end by start, then as KINDS has them, in code points."""
    rows = [(a, KINDS.index(k), b, k) for k, v in by_kind.items() for a, b in code_points(raw, v)]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(rows))


def secret_spans(docs: DataFrame, formats: Formats, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_assign, n_access, n_hex, base_sha256, spans, n_format, n_candidates, best_margin.

    A null text is empty: no spans and the hash of the empty text. Whole texts are scanned however long they are;
    repeated rows give repeated rows; an empty table gives an empty one; other columns are not read. Spans of equal start
    stand in the order of KINDS. n_candidates counts the runs that touch no pattern match, best_margin is by how much the
    best of them is over a threshold (null if there is none).
    """
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    def work(texts: list[bytes]) -> list[list]:
        rows = []
        for raw, got in zip(texts, scan(texts, shared.value), strict=True):
            base, more = {k: [(a, b) for a, b, _ in v] for k, v in got.base.items()}, got.found()
            own = listed(raw, base)
            best = max((m for _, _, m in got.candidates), default=None)
            rows.append((len(base["assign"]), len(base["access"]), len(base["hex"]), hashlib.sha256(own.encode()).hexdigest(), listed(raw, base | {"format": more}) if more else own, len(more), len(got.candidates), best if best is not None and np.isfinite(best) else None))
        return [list(x) for x in zip(*rows, strict=True)]

    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    made = [*longs("n_assign", "n_access", "n_hex"), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), *longs("n_format", "n_candidates"), T.StructField("best_margin", T.DoubleType())]
    return map_texts(docs, [key], text, made, work)


def candidate_scores(docs: DataFrame, formats: Formats, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each candidate of each row of docs that touches no pattern match: key, start, end (code points), margin.

    Null and empty texts have none; repeated rows give repeated rows; other columns are not read.
    """
    schema = T.StructType([docs.schema[key], T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("margin", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    def run(batches):
        for batch in batches:
            texts = raw_texts(batch.column(1))
            for a, b in slices(texts):
                at, spans, margins = [], [], []
                for k, (raw, got) in enumerate(zip(texts[a:b], scan(texts[a:b], shared.value), strict=True), a):
                    at += [k] * len(got.candidates)
                    spans += code_points(raw, [(x, y) for x, y, _ in got.candidates])
                    margins += [m for _, _, m in got.candidates]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([x for x, _ in spans], pa.int64()), pa.array([y for _, y in spans], pa.int64()), pa.array(margins, pa.float64())], names=schema.names)
        trim()

    return docs.select(key, F.col(text)).mapInArrow(run, schema)


def redact(raw: bytes, got: Scanned) -> bytes:
    """The text with every found span replaced by its kind in angle brackets; overlapping spans go as one."""
    spans = sorted([(a, b, k) for k, v in got.base.items() for a, b, _ in v] + [(a, b, "format") for a, b in got.found()])
    out, done = [], 0
    for a, b, k in spans:
        if a >= done:
            out += [raw[done:a], f"<{k}>".encode()]
        done = max(done, b)
    return b"".join([*out, raw[done:]])


def redacted_documents(docs: DataFrame, formats: Formats, text: str = "text") -> DataFrame:
    """docs with redacted texts, and n_chars (if there is such a column) counted anew where there was a number.

    Null texts stay null, empty ones empty; repeated rows stay repeated; all other columns pass through as they are,
    whatever their names; an empty table gives an empty one.
    """
    names, at = docs.columns, docs.columns.index(text)
    size = names.index("n_chars") if "n_chars" in names else None
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    def run(batches):
        for batch in batches:
            columns, raw = list(batch.columns), batch.column(at).cast(pa.binary()).to_pylist()
            texts = [x or b"" for x in raw]
            done = [redact(t, got) for a, b in slices(texts) for t, got in zip(texts[a:b], scan(texts[a:b], shared.value), strict=True)]
            done = [None if x is None else d for x, d in zip(raw, done, strict=True)]
            columns[at] = pa.array(done, pa.binary()).cast(columns[at].type)
            if size is not None:
                columns[size] = pa.array([n if d is None or n is None else len(d.decode()) for d, n in zip(done, columns[size].to_pylist(), strict=True)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)
        trim()

    return docs.mapInArrow(run, docs.schema)
