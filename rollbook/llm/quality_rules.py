"""Quality rules (operator 5): counted rules, and a linear-chain CRF that marks each line content or boilerplate.

The CRF has two labels, emission weights on what can be seen of a line, and a 2 x 2 transition table. Its training lines
are labelled weakly and one by one: a line that repeats over documents or within its own, or is made of symbols, capitals,
menu bars or a stuttered word, is boilerplate, wherever it stands; another line of a document marked good is content; another
line of a document marked bad has no label, and counts with the probabilities that the model gives it. Training is
gradient ascent on the likelihood of the labels that there are. The Viterbi path of a document's lines decides what share
of its characters is content.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import filter_texts, gathered, map_texts, sampled
from rollbook.llm.lines import FEATURES, Measured, measured

CONTENT, BOILERPLATE, OPEN = 0, 1, -1
#: Shares of a line from which it is boilerplate by itself: by feature.
TELLING = {"symbols": 0.08, "capitals": 0.6, "breaks": 0.12, "stutter": 0.5, "seen before": 1.0}
#: Training sequences are cut into runs of so many lines, each of which begins with the last line of the one before.
RUN = 48


@dataclass(frozen=True)
class LineCrf:
    """emit: score of boilerplate over content by feature; move[a][b]: score of label b after label a (1: boilerplate)."""

    emit: tuple[float, ...]
    move: tuple[tuple[float, float], tuple[float, float]]


#: Where there is no labelled line to learn from: symbols, capitals, breaks and repetition speak against a line.
UNTRAINED = LineCrf((-3.0, 20.0, 6.0, 20.0, 4.0, 0.5, 2.0, 0.0, 1.0, 8.0, 0.0, 0.0, 0.0), ((1.0, 0.0), (0.0, 1.0)))


def viterbi(score: np.ndarray, move: tuple) -> list[int]:
    """Best label sequence; score[i] is what boilerplate gains over content at line i."""
    (m00, m01), (m10, m11) = move
    a, b, back = 0.0, 0.0, []
    for i, s in enumerate(score.tolist()):
        if i:
            from_a, from_b = a + m00 >= b + m10, a + m01 > b + m11
            a, b = (a + m00 if from_a else b + m10), (a + m01 if from_b else b + m11)
            back.append((0 if from_a else 1, 0 if from_b else 1))
        b += s
    path = [int(b > a)] if len(score) else []
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]


def marks(of: Measured, crf: LineCrf) -> np.ndarray:
    """The label of each line, from the Viterbi path of its text."""
    score = of.x @ np.array(crf.emit)
    return np.array([y for a, b in zip(of.bounds, of.bounds[1:], strict=False) for y in viterbi(score[a:b], crf.move)], np.int64)


def content_shares(of: Measured, crf: LineCrf) -> np.ndarray:
    """By text, the share of the characters in lines that Viterbi marks as content; 0 for a text without a word."""
    total = np.concatenate(([0], np.cumsum(of.sizes)))
    fine = np.concatenate(([0], np.cumsum(of.sizes * (marks(of, crf) == CONTENT))))
    a, b = of.bounds[:-1], of.bounds[1:]
    return (fine[b] - fine[a]) / np.maximum(1, total[b] - total[a])


def alone(x: np.ndarray) -> np.ndarray:
    """Whether each line is boilerplate by itself."""
    return np.any([x[:, FEATURES.index(n)] >= least for n, least in TELLING.items()], axis=0)


def weak_labels(x: np.ndarray, common: np.ndarray, quality: int) -> np.ndarray:
    """A label for each line of a document of quality 0 or 1; common: whether a line repeats over documents."""
    return np.where(alone(x) | common, BOILERPLATE, OPEN if quality == 0 else CONTENT)


def common_lines(hashes: list[np.ndarray], least: int = 5) -> set[int]:
    """Hashes of the lines that stand between at least so many different pairs of lines; copies of a document count once."""
    around = [np.concatenate(([0], h, [0])).astype("<u8") for h in hashes]
    if not around:
        return set()
    with np.errstate(over="ignore"):
        rows = np.concatenate([np.stack([h[1:-1], h[:-2] * np.uint64(3) + h[2:] * np.uint64(5)], 1) for h in around])
    own, n = np.unique(np.unique(rows, axis=0)[:, 0], return_counts=True)
    return set(own[n >= least].tolist())


def sums(s: np.ndarray, mask: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected labels [run, line] (of boilerplate) and transitions [2, 2] under scores s [run, line, label]."""
    n, longest = mask.shape
    fwd, bwd = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    fwd[:, 0] = s[:, 0]
    for t in range(1, longest):
        fwd[:, t] = np.where(mask[:, t, None], np.logaddexp.reduce(fwd[:, t - 1, :, None] + move[None], axis=1) + s[:, t], fwd[:, t - 1])
    for t in range(longest - 2, -1, -1):
        bwd[:, t] = np.where(mask[:, t + 1, None], np.logaddexp.reduce(move[None] + (s[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2), 0)
    z = np.logaddexp.reduce(fwd[:, -1], axis=1)[:, None]
    both = mask[:, 1:]
    moves = np.array([[(np.exp(fwd[:, :-1, a] + move[a, b] + s[:, 1:, b] + bwd[:, 1:, b] - z) * both).sum() for b in (0, 1)] for a in (0, 1)])
    return np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z) * mask, moves


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 120, rate: float = 0.4, decay: float = 1e-5) -> LineCrf:
    """Maximum likelihood of the labels by Adam; sequences are (line features, line labels), OPEN lines are summed over.

    The start is UNTRAINED, as lines without a label first take theirs from it.
    """
    sequences = [(x, y) for x, y in sequences if len(y)]
    if len({int(v) for _, y in sequences for v in np.unique(y)} - {OPEN}) < 2:
        return UNTRAINED
    parts = [(x[i : i + RUN], y[i : i + RUN]) for x, y in sequences for i in range(0, max(1, len(y) - 1), RUN - 1)]
    n, longest, width = len(parts), max(len(y) for _, y in parts), len(FEATURES)
    X, Y, mask = np.zeros((n, longest, width)), np.full((n, longest), OPEN), np.zeros((n, longest), bool)
    for k, (x, y) in enumerate(parts):
        X[k, : len(y)], Y[k, : len(y)], mask[k, : len(y)] = x, y, True
    barred = np.stack([np.where(Y == BOILERPLATE, -1e6, 0.0), np.where(Y == CONTENT, -1e6, 0.0)], 2)
    theta = np.array([*UNTRAINED.emit, *np.ravel(UNTRAINED.move)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = mask.sum()
    for step in range(1, steps + 1):
        move = theta[width:].reshape(2, 2)
        s = np.stack([np.zeros((n, longest)), X @ theta[:width]], 2)
        p_free, moves_free = sums(s, mask, move)
        p_given, moves_given = sums(s + barred, mask, move)
        grad = np.concatenate((np.einsum("nt,ntf->f", p_given - p_free, X), (moves_given - moves_free).ravel())) / total - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return LineCrf(tuple(theta[:width].tolist()), tuple(tuple(r) for r in theta[width:].reshape(2, 2).tolist()))


def line_rows(texts: list[bytes]) -> list[list[bytes]]:
    """Of each text, its lines' features as float32 and hashes as 64-bit numbers."""
    of, data = measured(texts), b"".join([t + b"\n" for t in texts])
    hashes = np.array([xxhash.xxh64_intdigest(data[a:b]) for a, b in of.places.tolist()], "<u8")
    spans = list(zip(of.bounds.tolist(), of.bounds[1:].tolist(), strict=False))
    return [[of.x[a:b].astype("<f4").tobytes() for a, b in spans], [hashes[a:b].tobytes() for a, b in spans]]


def learn_crf(docs: DataFrame, labels: DataFrame | None, sample_docs: int = 1500, sample_bytes: int = 16 << 20, key: str = "doc_id", text: str = "text") -> LineCrf:
    """A CRF from a bounded sample of documents with a quality label: about sample_docs documents and sample_bytes of features.

    Both bounds are parameters. Executors make the features of whole texts, 60 bytes a line; they alone come to the driver.
    Labels without key or quality don't count, of several for a key the least does; rows of a repeated key all do. Without
    labels, or with lines of one label only: UNTRAINED.
    """
    if labels is None:
        return UNTRAINED
    marked = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min("quality").cast("int").alias("__quality"))
    got = F.broadcast(sampled(marked, "__key", sample_docs, 5))
    found = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(got, "__key")
    rows = map_texts(found, ["__key", "__quality"], "__text", [T.StructField("x", T.BinaryType()), T.StructField("lines", T.BinaryType())], line_rows)
    seen = gathered(rows, F.length("x") + F.length("lines"), sample_bytes, 5).sort_by([("__key", "ascending"), ("lines", "ascending")]).to_pylist()
    hashes = [np.frombuffer(r["lines"], "<u8") for r in seen]
    common, sequences = common_lines(hashes), []
    for r, h in zip(seen, hashes, strict=True):
        x = np.frombuffer(r["x"], "<f4").reshape(-1, len(FEATURES)).astype(np.float64)
        sequences.append((x, weak_labels(x, np.array([v in common for v in h.tolist()], bool), r["__quality"])))
    return fit(sequences)


def judged(texts: list[bytes], crf: LineCrf, min_words: int, max_repeat_percent: int, min_content: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """counts, base_failed, kept, content_share of each text."""
    of = measured(texts)
    n, repeat = of.counts[:, 0], of.counts[:, 4]
    failed, share = (n < min_words) | (100 * repeat > max_repeat_percent * n), content_shares(of, crf)
    return of.counts, failed, ~failed & (share >= min_content), share


def quality_rules(docs: DataFrame, crf: LineCrf, min_words: int = 50, max_repeat_percent: int = 50, min_content: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share.

    A null text has no words, so it fails; an empty table gives an empty one; repeated rows give repeated rows; other
    columns, whatever their names, are not read. kept = not base_failed and content_share >= min_content.
    """

    def work(texts: list[bytes]) -> list[list]:
        counts, failed, kept, share = judged(texts, crf, min_words, max_repeat_percent, min_content)
        return [*counts.T, failed, kept, share]

    longs = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return map_texts(docs, [key], text, [*longs, T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("content_share", T.DoubleType())], work)


def kept_documents(docs: DataFrame, crf: LineCrf, min_words: int = 50, max_repeat_percent: int = 50, min_content: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns, whatever their names; null texts are dropped."""
    return filter_texts(docs, text, lambda texts: judged(texts, crf, min_words, max_repeat_percent, min_content)[2])


def content_documents(docs: DataFrame, crf: LineCrf, text: str = "text") -> DataFrame:
    """docs with the lines that Viterbi marks as content alone; null texts stay null, a text without content is empty."""
    import pyarrow as pa

    names, at = docs.columns, docs.columns.index(text)

    def run(batches):
        for batch in batches:
            raw = batch.column(at).cast(pa.binary()).to_pylist()
            out = []
            for t in raw:
                if t is None:
                    out.append(None)
                    continue
                of = measured([t])
                out.append(b"\n".join([t[a:b] for (a, b), y in zip(of.places.tolist(), marks(of, crf).tolist(), strict=True) if y == CONTENT]))
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.binary()).cast(batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
