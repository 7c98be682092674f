import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rollbook.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def slow(docs, items, k=10):
    """Every document's score for every item, by the definition."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        asked, scores = Counter(terms(text)), []
        for i, c in counted:
            if not c:
                continue
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            score = sum(f * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, f in asked.items() if t in c)
            scores.append((-score, i is None, i if i is not None else 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(x for x in scores if x[0])[:k], 1)]
    return sorted(out, key=repr)


def corpus(n):
    r = random.Random(3)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(900)]
    docs = [(i, " ".join(r.choice(common if r.random() < 0.7 else rare) for _ in range(r.choice((3, 20, 60))))) for i in range(n)]
    items = [(k, " ".join(r.choices(common, k=r.randint(0, 6)) + r.choices(rare, k=r.randint(0, 9)))) for k in range(30)]
    return docs, items


def got(spark, docs, items, **k):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return lexical.search(lexical.build_index(a.repartition(3)), b, **k)


def test_every_tier_gives_the_slow_versions_rows(spark):
    docs, items = corpus(700)
    r = random.Random(4)
    docs += [(1000 + i, " ".join(r.choices([f"d{j}" for j in range(250)], k=r.choice((55, 60, 70))))) for i in range(900)]  # no one of these words is rare, nor is it of high impact
    items += [(200 + i, " ".join(r.choices([f"d{j}" for j in range(250)] + ["c1", "c2"], k=25))) for i in range(12)]
    items += [(100, "c0"), (101, "c0 c1 c2 c3 c4 c5 c6 c7"), (102, " ".join(f"c{i}" for i in range(12)) + " r1 r2 r3 r4 r5 r6 r7 r8 r9")]
    out = got(spark, docs, items).toPandas()
    assert sorted(map(tuple, out[["item_id", "rank", "doc_id", "score"]].astype(object).values.tolist()), key=repr) == slow(docs, items)
    assert out.proved_by.nunique() > 1


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "  ...!"), (4, "Ä a"), (4, "Ä a"), (None, "ä a x"), (5, "B\0b-b"), (6, "long " * 50_000), (7, "A " * 3)]
    items = [(1, "Ä"), (1, "Ä"), (1, "ä A"), (None, "b"), (2, None), (3, ""), (4, "nowhere"), (5, "long long a")]
    out = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got(spark, docs, items).collect()]
    assert sorted(out, key=repr) == slow(docs, items)
    assert ("Ä" in terms("Ä")) and [x for x in out if x[0] == 1 and x[2] == 4]


def test_ties_go_to_the_least_keys_whatever_their_shards(spark):
    docs = [(i, "same words") for i in range(60, 0, -1)] + [(100 + i, "other") for i in range(60)]
    out = got(spark, docs, [(1, "same")], k=4).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in out) == [(1, 1), (2, 2), (3, 3), (4, 4)]


@pytest.mark.parametrize("docs", [[], [(1, None), (2, "--")]])
def test_nothing_to_find(spark, docs):
    assert got(spark, docs, [(1, "a")]).collect() == []
    assert got(spark, [(1, "a"), (2, "b")], []).collect() == []


def test_other_columns_and_keys(spark):
    docs = spark.createDataFrame([("x", "one two", 5, "q"), ("y", "two", 6, "r")], "name string, body string, term int, shard string")
    items = spark.createDataFrame([(7, "two", 1.5)], "item int, ask string, score double")
    out = lexical.search(lexical.build_index(docs, "name", "body"), items, "item", "ask")
    assert out.columns == ["item", "rank", "doc_id", "score", "proved_by"]
    assert [(r["rank"], r["doc_id"]) for r in out.orderBy("rank").collect()] == [(1, "y"), (2, "x")]


def test_a_shards_rows_hold_each_posting_once():
    words = [b"a b a".split(), [], b"b c".split()]
    flat = pa.chunked_array([pa.array([w for x in words for w in x], pa.binary())])
    tier, names, counts, top, postings = lexical.shard_rows(flat, np.array([3, 0, 2]), 2, 5)
    m = lexical.damping(np.array([3, 0, 2]), 2, 5)
    assert m.tolist() == [25 + 90, 25, 25 + 60]
    rows = {t: np.frombuffer(p, "<u4").reshape(-1, 2).tolist() for t, p in zip(names.to_pylist(), postings.to_pylist(), strict=True)}
    assert rows == {"a": [[0, 2 * 10**9 // (2000 + 8 * 115)]], "b": [[0, 10**9 // (1000 + 8 * 115)], [2, 10**9 // (1000 + 8 * 85)]], "c": [[2, 10**9 // (1000 + 8 * 85)]]}
    assert counts.tolist() == [1, 2, 1] and tier.tolist() == [0, 0, 0] and top.tolist() == [max(x[1] for x in rows[t]) for t in "abc"]
