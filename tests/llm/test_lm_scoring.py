import math
import zlib
from collections import Counter

import numpy as np
import pytest

from rollbook.llm import lm_scoring as lm

ROWS = [(i, t) for i, t in enumerate(["the cat sat on the mat", "The cat ate", "a rat and a cat", "mat the rat", None, "", "zebra cat é", "the the the the"] * 3)] + [(None, "the cat")]


def slow_ppm(train: list[bytes], text: bytes, order: int) -> float:
    """PPM with escape D / (T + D) and symbol exclusion, context by context."""
    counts: dict[bytes, Counter] = {}
    for t in train:
        padded = bytes(order) + t.lower() + b"\0"
        for i in range(order, len(padded)):
            for k in range(order + 1):
                counts.setdefault(padded[i - k : i], Counter())[padded[i]] += 1
    total, padded = 0.0, bytes(order) + text.lower() + b"\0"
    for i in range(order, len(padded)):
        excluded: set[int] = set()
        p = 1.0
        for k in range(order, -1, -1):
            own = counts.get(padded[i - k : i])
            if own is None:
                continue
            left = {s: n for s, n in own.items() if s not in excluded}
            t, d = sum(left.values()), len(left)
            if padded[i] in left:
                p *= left[padded[i]] / (t + d)
                break
            if d:
                p *= d / (t + d)
            excluded |= set(own)
        else:
            p *= 1 / (256 - len(excluded))
        total += math.log10(p)
    return total


@pytest.mark.parametrize("order", [3, 4, 6])
def test_tables_equal_the_definition(order):
    train = [(t or "").encode() for _, t in ROWS[:5]]
    tests = [b"the cat", b"", b"\xc3\xa9xyz", b"a rat sat", b"the cat sat on the mat"]
    grams, n = np.unique(lm.laid_out(train, order).grams, return_counts=True)
    near, m = np.unique(grams & 0xFFFFFF, return_inverse=True)
    tables = lm.subtables(near, np.bincount(m, n), 0, lm.NEAR, None)
    tables += lm.subtables(grams, n, lm.NEAR + 1, order, tables[-1])
    laid = lm.laid_out(tests, order)
    sums = np.add.reduceat(lm.log10_chances(laid.grams, tables), laid.gram_bounds[:-1])
    assert sums == pytest.approx([slow_ppm(train, t, order) for t in tests], rel=1e-9)
    every = (grams[3] & ~0xFF) | np.arange(256)
    assert (10 ** lm.log10_chances(every, tables)).sum() == pytest.approx(1.0)
    assert lm.log10_chances(every, lm.subtables(np.zeros(0, np.int64), np.zeros(0), 0, order, None)) == pytest.approx(np.log10(1 / 256))


def test_scores_equal_the_definition(spark):
    """op2's score column on all rows, over several partitions, against a model written out context by context."""
    rows = [(i, t) for i, t in enumerate(["the cat sat on the mat", "The cat ate", "a rat and a cat", "mat the rat", None, "", "zebra cat \u00e9", "nul \x00 byte", "the " * 3000] * 4)] + [(None, "the cat"), (3, "mat the rat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id")
    train = [(t or "").encode() for d, t in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
    want = {t: slow_ppm(train, (t or "").encode(), lm.ORDER) for t in {t for _, t in rows}}
    text = dict(rows)
    got = lm.score_corpus(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.score == pytest.approx(want[text[r.doc_id]], rel=1e-5)


def test_other_partitions_are_refused(spark):
    df = spark.createDataFrame([(i, f"text {i} of its own {i * 7919}") for i in range(40)], "doc_id long, text string").repartition(4, "doc_id")
    honest = lm.read_part
    try:
        lm.read_part = lambda path, part, columns: honest(path, (part + 1) % 4, columns)
        with pytest.raises(Exception, match="other partitions"):
            lm.score_corpus(df).count()
    finally:
        lm.read_part = honest


def test_model_is_of_all_training_texts(spark):
    """A gram that occurs in a single training text of many is a context like any other."""
    rows = [(i, "plain words again and again") for i in range(300)] + [(1000, "qzxjkv qzxjkw"), (1001, "qzxjkv qzxjkw")]
    got = {r.doc_id: r.score for r in lm.score_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    once = [(i, t) for i, t in rows if i != 1001]
    alone = {r.doc_id: r.score for r in lm.score_corpus(spark.createDataFrame(once, "doc_id long, text string")).collect()}
    assert got[1000] > alone[1000]


def test_base_score_and_counts(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'x' as token", "'y' as score")
    got = lm.score_corpus(df).collect()
    rest = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7
    count: Counter = Counter()
    for d, t in ROWS:
        if rest(d) != 2:
            count.update((t or "").encode().lower().split())
            count[b""] += 1
    n, v = sum(count.values()), len(count)
    want = []
    for d, t in ROWS:
        words = [*(t or "").encode().lower().split(), b""]
        want.append((-1 if d is None else d, rest(d) == 2, len(words), sum(w in count for w in words), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), 6)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)
    assert lm.score_corpus(df.limit(0)).count() == 0
