import itertools
import random

import numpy as np
import xxhash

from rollbook.llm import simhash
from rollbook.llm.components import components


def slow_fingerprint(text: str, width: int = 4) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w.decode() for w in low.encode().split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps: list[int], radius: int) -> dict[int, int]:
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def clustered(seed: int, clusters: int, size: int) -> list[int]:
    r = random.Random(seed)
    out = set()
    for _ in range(clusters):
        at = r.getrandbits(64)
        for _ in range(size):
            at ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 6)))
            out.add(simhash.signed(at))
    return sorted(out)


def test_fingerprint_matches_its_definition():
    r = random.Random(1)
    for n in (0, 1, 3, 4, 5, 60):
        text = " \n".join(r.choice(["Alpha", "beta", "é", "x1,"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    got = spark.sql("select 'the quick é fox' as s").select(F.xxhash64("s")).first()[0]
    assert got == simhash.signed(xxhash.xxh64_intdigest("the quick é fox".encode(), 42))


def test_ball_sizes():
    assert simhash.ball(np.array([5]), 43, 1).shape == (1, 44)
    assert len(set(simhash.ball(np.array([5]), 22, 2)[0].tolist())) == 254


def test_parts_make_up_a_fingerprint():
    r = random.Random(9)
    for _ in range(200):
        x = r.getrandbits(64)
        for k, (at, size) in enumerate(simhash.PARTS):
            rest, own = (int(v[0]) for v in simhash.without(np.array([simhash.signed(x)], np.int64), k))
            assert own == x >> at & (1 << size) - 1
            assert rest >> at << (at + size) | own << at | rest & (1 << at) - 1 == x


def test_any_two_within_four_bits_meet():
    """Any 1 to 4 bits: some choice of two parts has at most 2 of them."""
    for bits in itertools.combinations(range(0, 64, 3), 4):
        assert min(sum(not at <= b < at + size for b in bits) for at, size in simhash.PARTS) <= 2


def check_links(spark, fps, direct):
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = simhash.links(df, direct=direct)
    for a, b in found.collect():
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 4
    got = {r.node: r.root for r in components(found, "a", "b").collect()}
    want = slow_components(fps, 4)
    assert {f: got.get(f, f) for f in fps} == want


def test_links_connect_what_all_pairs_connect(spark):
    check_links(spark, clustered(3, 12, 15), simhash.DIRECT)


def test_groups_over_the_limit_are_split_without_loss(spark):
    check_links(spark, clustered(4, 3, 25), 2)


def test_near_duplicates_edges(spark):
    rows = [(7, "a b c d e", "x"), (3, "a b c d e", None), (9, None, "y"), (8, "", "z"), (None, "a b c d e", "n"), (7, "a b c d e", "x"), (20, " \n ", "w"), (30, "quite another text with words", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert {c for (d, f), c in by.items() if d in (7, 3, None)} == {3}
    assert by[9, "0" * 16] == by[8, "0" * 16] == by[20, "0" * 16] == 8
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_one_of_each_keeps_columns_and_one_row(spark):
    rows = [(7, "a b c d e", "x"), (3, "a b c d e", "q"), (3, "a b c d e", "q"), (None, "a b c d e", "n"), (None, "wholly other words are here now", "n"), (None, "wholly other words are here now", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in got.collect()) == [(-1, "wholly other words are here now"), (3, "a b c d e")]


def test_one_of_each_keeps_unlike_texts_of_one_key(spark):
    rows = [(5, "a b c d e"), (5, "wholly other words are here now"), (5, "a third text of its own"), (2, "a b c d e"), (5, "a third text of its own"), (None, "a b c d e"), (9, None), (9, "")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == [(2, "a b c d e"), (5, "a third text of its own"), (5, "wholly other words are here now"), (9, "")]


def test_clashing_names(spark):
    rows = [(7, "a b c d e", 1), (3, "a b c d e", 2), (None, "wholly other words are here now", 3), (None, "wholly other words are here now", 4)]
    for names in (("doc_id", "text", "__turn"), ("doc_id", "text", "fp"), ("fp", "text", "key"), ("key", "hash", "row"), ("root", "fp", "component_id"), ("turn", "a.b", "head")):
        df = spark.createDataFrame(rows, f"`{names[0]}` long, `{names[1]}` string, `{names[2]}` long")
        text = f"`{names[1]}`"
        got = simhash.one_of_each(df, key=names[0], text=text)
        assert got.columns == list(names)
        assert sorted((r[0] or -1, r[1]) for r in got.collect()) == [(-1, "wholly other words are here now"), (3, "a b c d e")]
        assert simhash.near_duplicates(df, key=names[0], text=text).count() == 4


def test_components_of_hubs_and_paths(spark):
    """Stars over the limit, a long path and a clique: roots as by union-find, hot nodes and others alike."""
    links = [(0, k) for k in range(1, 3000)] + [(k, k + 1) for k in range(5000, 5100)] + [(a, b) for a in range(9000, 9012) for b in range(a)if b >= 9000] + [(2999, 20_000)] + [(20_000, k) for k in range(20_001, 22_500)] + [(4, 4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_query_matches_a_slow_version(spark):
    from rollbook.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: slow_fingerprint(r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    root = slow_components(sorted(set(rows.values())), 4)
    least: dict = {}
    for d in sorted(rows):
        least.setdefault(root[rows[d]], d)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, sf).collect()}
    assert got == {(d, f"{f:016x}", least[root[f]]) for d, f in rows.items()}


def test_very_long_texts(spark):
    text = " ".join(f"w{k % 70_000}" for k in range(120_000))
    df = spark.createDataFrame([(1, text), (2, text.upper()), (3, text + " more")], "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got[1] == got[2] and got[1][0] == f"{simhash.fingerprint(text.encode()):016x}" and got[3][1] == 1
