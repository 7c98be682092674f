"""Quality classifier (operator 3): a weak-label model over heuristic labellers, and a hashed linear scorer.

Overlapping heuristics vote junk, fine or nothing on each document. Expectation-maximisation over the counts of all vote
patterns estimates each labeller's accuracy and the share of junk. The patterns' posteriors then label a bounded sample,
on which a logistic model over hashed byte n-grams is fitted; that scorer alone decides about every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import SPACE, filter_texts, gathered, map_texts, sampled

BITS = 16
#: Class of each byte for coarse n-grams: shapes of words rather than words.
SHAPE = np.array([1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b >= 0x80 else 5 if b in SPACE and b != 10 else 6 if b == 10 else 7 + b % 25 for b in range(256)], np.uint32)
STUTTER = 0x7FFF  # no trigram of shapes has this number
SYMBOLS, STOPS = b"#*$%&|<>{}[]\\~^_=@+", b".!?"
LABELLERS = ("symbols", "capitals", "fields", "marks", "repeats", "stutter", "letters", "sentences", "numbers")


MIN_WORDS = 30
#: Words among which a repeated one counts: whatever a text's length, so many at a time.
NEARBY = 64


def repeats(words: list[bytes]) -> float:
    """Share of the words that stand once more among the NEARBY words that they are taken with."""
    distinct = sum(len(set(words[i : i + NEARBY])) for i in range(0, len(words), NEARBY))
    return 1 - distinct / len(words) if words else 0.0


def stutters(words: list[bytes]) -> int:
    """Words equal to the word before."""
    return sum(map(eq, words, words[1:]))


def votes(raw: bytes) -> list[int]:
    """-1 junk, 1 fine, 0 no opinion from each of LABELLERS; on a text of under MIN_WORDS words only the first four have one."""
    solid = raw.translate(None, SPACE)
    n = max(1, len(solid))
    words = raw.split()
    k = max(1, len(words))
    count = np.bincount(np.frombuffer(solid, np.uint8), minlength=256)
    low, up = int(count[97:123].sum()), int(count[65:91].sum())
    symbols = int(count[list(SYMBOLS)].sum()) / n
    alone = raw.count(b" | ") / k
    ends = int(count[list(STOPS)].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeat = repeats(words)
    letters = (low + up + int(count[0x80:].sum())) / n
    short = k < MIN_WORDS
    by = lambda x, fine, junk: 1 if x <= fine else -1 if x >= junk else 0
    return [
        by(symbols, 0.01, 0.06),
        by(up / max(1, low + up), 0.10, 0.40),
        by(alone, 0.02, 0.15),
        by(int(count[33]) / k, 0.05, 0.30),
        0 if short else -1 if repeat >= 0.6 or len(lines) >= 4 and len(set(lines)) * 2 <= len(lines) else 1 if repeat <= 0.3 else 0,
        0 if short else by(stutters(words) / k, 0.05, 0.30),
        0 if short else 1 if letters >= 0.93 else -1 if letters <= 0.80 else 0,
        0 if short else 1 if 3 <= k / max(1, ends) <= 40 else -1 if k / max(1, ends) > 80 else 0,
        0 if short else by(int(count[48:58].sum()) / n, 0.05, 0.25),
    ]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60, prior: float = 0.1) -> tuple[np.ndarray, float, np.ndarray]:
    """Accuracies [labeller, class, vote], the share of junk, and the posterior of junk for each pattern of votes.

    The start is the majority vote; add-a-little counts keep every probability off 0 and 1.
    """
    onehot = np.stack([patterns == v for v in (-1, 1)], 2).astype(float)  # no opinion is no evidence
    against = (patterns == -1).sum(1) / np.maximum(1, (patterns != 0).sum(1))
    q = np.where((patterns != 0).any(1), np.clip(2 * against, 0.02, 0.9), prior)
    share, table = prior, np.zeros((patterns.shape[1], 2, 2))
    for _ in range(rounds):
        for c, weight in ((0, (1 - q) * counts), (1, q * counts)):
            table[:, c] = np.einsum("p,pjv->jv", weight, onehot) + 1.0
        table /= table.sum(axis=2, keepdims=True)
        share = float(min(0.6, max(0.005, (q * counts).sum() / max(1.0, counts.sum()))))
        logs = np.einsum("pjv,jcv->pc", onehot, np.log(table)) + np.log([1 - share, share])
        q = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -40, 40)))
    return table, share, q


def grams(raw: bytes) -> np.ndarray:
    """Hashed features of a text: shape trigrams, byte pairs, and one for each stutter; empty under three bytes."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    s = SHAPE[b]
    shape = (s[:-2] * np.uint32(1024) + s[1:-1] * np.uint32(32) + s[2:]) % np.uint32(0x7FFF)
    pair = ((b[:-1].astype(np.uint32) << np.uint32(8) | b[1:]) * np.uint32(2654435761)) >> np.uint32(17)
    stutter = np.full(5 * stutters(raw.split()), STUTTER, np.uint32)  # as many as the bytes of a usual word
    return np.concatenate((shape, pair + np.uint32(1 << 15), stutter)).astype(np.int64)


def profile(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their mean number at a byte."""
    at, n = np.unique(grams(raw), return_counts=True)
    return at, n * (40.0 / max(1, len(raw)))


@dataclass(frozen=True)
class Scorer:
    bias: float
    weights: np.ndarray  # float32 by feature

    def junk(self, raw: bytes) -> float:
        """Probability that a text is junk; of a text of under three bytes, that of the bias."""
        g = grams(raw)
        x = self.bias + (float(self.weights[g].sum()) * 40.0 / len(raw) if len(g) else 0.0)
        return float(1 / (1 + np.exp(-min(35.0, max(-35.0, x)))))


def fit(examples: list[tuple[np.ndarray, np.ndarray, float, float]], passes: int = 8, rate: float = 0.4, decay: float = 1e-5, seed: int = 3) -> Scorer:
    """Logistic model by AdaGrad over (features, values, posterior of junk, weight)."""
    w, n = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    bias, nb = -1.0, 1e-2
    r = np.random.default_rng(seed)
    for _ in range(passes):
        for k in r.permutation(len(examples)):
            at, x, y, weight = examples[k]
            g = (1 / (1 + np.exp(-np.clip(bias + w[at] @ x, -35, 35))) - y) * weight
            gx = g * x + decay * w[at]
            n[at] += gx * gx
            w[at] -= rate * gx / np.sqrt(n[at])
            nb += g * g
            bias -= rate * 0.3 * g / np.sqrt(nb)
    return Scorer(float(bias), w.astype(np.float32))


@dataclass(frozen=True)
class QualityModel:
    scorer: Scorer
    accuracies: dict[str, tuple[float, float]]  # by labeller: P(votes junk | junk), P(votes fine | fine)
    junk_share: float


def learn_quality(docs: DataFrame, sample_docs: int = 5000, sample_bytes: int = 96 << 20, key: str = "doc_id", text: str = "text") -> QualityModel:
    """Labeller accuracies from all documents' votes, the scorer from about sample_docs of them, sample_bytes of features.

    Both bounds are parameters. The driver gets a count for each pattern of votes, of which there are 3**9 at most, and the
    sample's feature counts. Null texts vote like empty ones, null keys and repeated rows are taken as they are. An empty
    table gives a scorer that calls everything fine.
    """
    voted = map_texts(docs, [key], text, [T.StructField("pattern", T.StringType())], lambda texts: [[",".join(map(str, votes(t))) for t in texts]])
    rows = sorted((r[0], r[1]) for r in voted.groupBy("pattern").count().collect())
    if not rows:
        return QualityModel(Scorer(-4.0, np.zeros(1 << BITS, np.float32)), {}, 0.0)
    patterns = np.array([[int(v) for v in p.split(",")] for p, _ in rows])
    counts = np.array([n for _, n in rows], float)
    table, share, posterior = expectation_maximisation(patterns, counts)
    of = {p: float(q) for (p, _), q in zip(rows, posterior, strict=True)}

    def work(texts: list[bytes]) -> list[list]:
        made = [profile(t) for t in texts]
        return [[",".join(map(str, votes(t))) for t in texts], [at.astype("<u2").tobytes() for at, _ in made], [x.astype("<f4").tobytes() for _, x in made]]

    picked = sampled(docs.select(key, text), key, sample_docs, 3)
    made = map_texts(picked, [key], text, [T.StructField("pattern", T.StringType()), T.StructField("at", T.BinaryType()), T.StructField("x", T.BinaryType())], work)
    found = gathered(made.select(F.col(key).cast("string").alias("key"), "pattern", "at", "x"), F.length("at") + F.length("x"), sample_bytes, 3)
    found = found.sort_by([(c, "ascending") for c in ("key", "at", "x")])
    columns = [found.column(c).to_pylist() for c in ("pattern", "at", "x")]
    examples = [(np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(x, "<f4").astype(float), of.get(p, share)) for p, at, x in zip(*columns, strict=True)]
    mass = max(1e-6, sum(y for _, _, y in examples) / max(1, len(examples)))
    weight = min(8.0, max(1.0, (1 - mass) / mass / 2))  # the rarer junk counts more
    return QualityModel(fit([(a, x, y, weight * y + 1 - y) for a, x, y in examples]), {n: (float(table[j, 1, 0]), float(table[j, 0, 1])) for j, n in enumerate(LABELLERS)}, share)


def quality(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: key, score (0 to 1, of being fine), kept (score >= 1 - threshold).

    A null or very short text has the score of the bias alone and is judged like any other; whole texts are scored;
    repeated rows give repeated rows; an empty table gives an empty one; columns other than key and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.scorer)

    def work(texts: list[bytes]) -> list[list]:
        fine = [1 - shared.value.junk(t) for t in texts]
        return [fine, [x >= 1 - threshold for x in fine]]

    return map_texts(docs, [key], text, [T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())], work)


def fine_documents(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns, whatever their names; repeated rows stay repeated.

    Null and empty texts are judged by the bias alone; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.scorer)
    return filter_texts(docs, text, lambda texts: [1 - shared.value.junk(t) >= 1 - threshold for t in texts])
