import random
import re

from rollbook.llm import decontamination as dc


def slow(docs, items):
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for d, t in docs:
        w = split(t)
        for i, x in items:
            own = split(x)
            if not own:
                continue
            n = min(dc.WINDOW, len(own))
            for diagonal in range(-len(own), len(w)):
                same = [0 <= j + diagonal < len(w) and own[j] == w[j + diagonal] for j in range(len(own))]
                if any(sum(same[s : s + n]) >= dc.needed(len(own)) for s in range(len(own) - n + 1)):
                    out.add((d, i))
    return out


def test_against_brute_force(spark):
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)] + ["the", "of"] * 10
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(make(n))) for k, n in enumerate([15, 20, 30, 40, 13, 14, 25, 60])]
    items += [(90, items[2][1]), (91, None), (92, ""), (93, "three little words")]
    docs = []
    for d in range(150):
        words = make(r.randint(0, 80))
        if d % 3 == 0:
            own = r.choice(items[:8])[1].split()
            for _ in range(r.randint(0, 5)):
                own[r.randrange(len(own))] = "changed"
            at = r.randint(0, len(words))
            words[at:at] = own[r.randint(0, 3) :]
        docs.append((d, r.choice([" ", ", ", "\n"]).join(words).upper() if d % 2 else " ".join(words)))
    docs += [(500, "Three little words, and more"), (501, None), (502, ""), (None, items[0][1]), (500, "Three little words, and more")]
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as words", "3 as diagonal"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id"))
    found = [(x.doc_id, x.item_id) for x in got.collect()]
    assert set(found) == slow(docs, items)
    assert len(found) == len(set(found))


def test_clean_documents_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(30)), "a"), (2, "nothing of it", "b"), (None, None, "c")], "doc_id long, text string, __hash string")
    bench = spark.createDataFrame([(1, " ".join(f"W{k}" for k in range(5, 25)))], "item_id long, text string")
    kept = dc.clean_documents(docs, bench)
    assert kept.columns == docs.columns and sorted(r["__hash"] for r in kept.collect()) == ["b", "c"]
    assert dc.contaminated(docs.limit(0), bench).count() == 0
    assert dc.contaminated(docs, bench.limit(0)).count() == 0


def test_masks_show_any_two_substitutions():
    from itertools import combinations

    for bad in combinations(range(dc.WINDOW), 2):
        assert any(not {o + x for x in m} & set(bad) for m in dc.MASKS for o in range(dc.WINDOW - m[-1]))


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = dc.contaminated(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_items_with_all_permitted_substitutions(spark):
    from itertools import combinations

    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(5, 13)]
    docs = []
    for n, text in items:
        for bad in range(n - dc.needed(n) + 2):
            for at in combinations(range(n), bad):
                words = [f"other{k}" if k in at else w for k, w in enumerate(text.split())]
                docs.append((len(docs), " ".join(["before", *words, "after"])))
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in got.collect()} == slow(docs, items)


def test_masks_of_every_short_length_are_lossless():
    from itertools import combinations

    for lengths in [*([n] for n in range(1, 13)), list(range(1, 13))]:
        masks = dc.masks_for(lengths)
        for n in lengths:
            own = [m for m in masks if m in dc.MASKS or n <= dc.longest_item(m)]
            assert all(any(dc.shows(m, n, set(bad)) for m in own) for bad in combinations(range(n), n - dc.needed(n)))


def test_very_long_documents_items_and_repeats(spark):
    r = random.Random(5)
    words = [f"v{r.randrange(5000)}" for _ in range(40_000)]
    passage = [f"p{k}" for k in range(20)]
    rows = [(1, " ".join(words[:20_000] + passage + words[20_000:])), (2, " ".join(words)), (3, " ".join(["same"] * 2000)), (None, None)]
    items = [(7, " ".join(passage)), (7, " ".join(passage)), (8, " ".join(["same"] * 30)), (None, " ".join(passage)), (9, "")]
    got = dc.contaminated(spark.createDataFrame(rows + rows[:1], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted({(x.doc_id, x.item_id or 0, x.matched) for x in got}) == [(1, 0, 20), (1, 7, 20), (3, 8, 30)]


def test_query_equals_its_sql(spark):
    import duckdb

    from rollbook.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, sf), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        order = sorted(got.columns)
        assert sorted(map(tuple, got.select(order).collect())) == sorted(want.select(*order).fetchall()), name
