"""Toxicity (operator 9): FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has its own learning rate; L1 keeps all but the telling weights at exactly zero, so that what is
broadcast is a short list of (feature, weight), at most 2**BITS of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import crc_remainder, gathered, map_texts, raw_texts, sampled
from rollbook.llm.hashing import grams, word_hashes

BITS = 20


@dataclass(frozen=True)
class SparseModel:
    bias: float
    features: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.features] = self.weights
        return out


def probability(x: float) -> float:
    return float(1 / (1 + np.exp(-min(35.0, max(-35.0, x)))))


def ftrl(examples: list[tuple[np.ndarray, int]], passes: int = 4, alpha: float = 2.0, beta: float = 1.0, l1_of_6000: float = 8.0, l2: float = 0.5, rare: float = 2.0, seed: int = 9) -> SparseModel:
    """Follow the proximally regularised leader: z and n by coordinate, weight 0 where |z| <= l1.

    l1 goes with the root of the number of examples, as sums of chance gradients do. Label 1, the rarer, counts rare times.
    """
    size, l1 = 1 << BITS, l1_of_6000 * (len(examples) / 6000) ** 0.5
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the bias, without L1
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for k in order.permutation(len(examples)):
            x, y = examples[k]
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2))
            b = -z[size] / ((beta + np.sqrt(n[size])) / alpha + l2)
            g = (probability(w.sum() + b) - y) * (rare if y else 1.0)
            root = np.sqrt(nx + g * g)
            z[x] = zx + g - (root - np.sqrt(nx)) / alpha * w
            n[x] = nx + g * g
            z[size] += g - (np.sqrt(n[size] + g * g) - np.sqrt(n[size])) / alpha * b
            n[size] += g * g
    own, count = z[:size], n[:size]
    at = np.flatnonzero(np.abs(own) > l1)
    weights = -(own[at] - np.sign(own[at]) * l1) / ((beta + np.sqrt(count[at])) / alpha + l2)
    bias = -z[size] / ((beta + np.sqrt(n[size])) / alpha + l2)
    return SparseModel(float(bias), at, weights.astype(np.float32))


def features(texts: list[bytes]) -> list[np.ndarray]:
    words, bounds = word_hashes(texts)
    return [grams(words[a:b], BITS) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def learn_toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = 6000, sample_bytes: int = 96 << 20, folds: int = 5, key: str = "doc_id", text: str = "text", label: str = "toxic") -> SparseModel:
    """A model from about sample_docs labelled documents outside the fold of remainder 0, sample_bytes of features.

    Both bounds are parameters. Features are made on the executors; what comes to the driver are feature numbers of the
    sample. Rows of labels without key or label don't count; a key with several labels takes the greatest; a repeated
    document counts as often as it occurs. Without both labels every score is the labels' mean, one half if there is none.
    """
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (crc_remainder(F.col(key), folds) != 0))
    picked = sampled(marked.groupBy(key).agg(F.max(label).cast("int").alias("__label")), key, sample_docs, 9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                rows = [x.astype("<i4").tobytes() for x in features(raw_texts(part.column(1)))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(2), pa.array(rows, pa.binary())], names=["id", "label", "features"])

    made = docs.select(key, text).join(F.broadcast(picked), key).select(key, text, "__label").mapInArrow(run, "id string, label int, features binary")
    found = gathered(made, F.length("features"), sample_bytes, 9).sort_by([("id", "ascending"), ("features", "ascending")])
    examples = [(np.frombuffer(x, "<i4").astype(np.int64), y) for x, y in zip(found.column("features").to_pylist(), found.column("label").to_pylist(), strict=True)]
    seen = {y for _, y in examples}
    if len(seen) < 2:
        return SparseModel(0.0 if not seen else 4.0 * (2 * seen.pop() - 1), np.zeros(0, np.int64), np.zeros(0, np.float32))
    return ftrl(examples)


def toxicity(docs: DataFrame, model: SparseModel, folds: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, held_out, score, predicted.

    A text without words, or null, has the score of the bias alone. Whole texts are read; repeated rows give repeated
    rows; an empty table gives an empty one; columns other than key and text are not read. A score of exactly 0.5 counts
    as toxic.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[bytes]) -> list[list]:
        model = shared.value
        weights = model.__dict__.get("_dense")
        if weights is None:
            object.__setattr__(model, "_dense", weights := model.dense())
        scores = [probability(float(weights[x].sum()) + model.bias) for x in features(texts)]
        return [scores, [int(s >= 0.5) for s in scores]]

    made = map_texts(docs, [key], text, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], work)
    return made.select(key, (crc_remainder(F.col(key), folds) == 0).alias("held_out"), "score", "predicted")
