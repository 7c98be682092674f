import math

import numpy as np
import pyarrow as pa
import pytest

from rollbook.llm import vector_graph as V

SHAPE = "vec_id long, embedding array<float>"


def slow(rows, threshold=0.9):
    """Every pair's cosine in double precision, and components by repeated passes."""
    ok = [i for i, (_, x) in enumerate(rows) if x and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    near = {i: [] for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    near[i].append(j)
    root = list(range(len(rows)))
    while True:
        new = [min([root[i], *(root[j] for j in near[i])]) for i in range(len(rows))]
        if new == root:
            break
        root = new
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root[i]] = min((k for k in (least.get(root[i]), key) if k is not None), default=None)
    return sorted([(key, len(near[i]), least[root[i]], key == least[root[i]]) for i, (key, _) in enumerate(rows)], key=repr)


def found(spark, rows, g=None):
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    return sorted(map(tuple, V.near_duplicate_vectors(df, g=g).collect()), key=repr)


def balls(sizes, dim=16, noise=0.06, alone=60, seed=4):
    r = np.random.default_rng(seed)
    rows = [r.normal(size=dim) for _ in range(alone)]
    for n in sizes:
        centre = V.unit(r.normal(size=(1, dim)))[0]
        rows += [centre + r.normal(size=dim) * noise for _ in range(n)]
    r.shuffle(rows)
    return [(i, np.asarray(x, np.float32).tolist()) for i, x in enumerate(rows)]


SMALL = V.Graph(shard_rows=64, pool=12, degree=10, beam=16, audited=200)


def test_all_links_over_many_shards(spark):
    rows = balls([70, 40, 9, 3, 2])
    assert found(spark, rows, SMALL) == slow(rows)


def test_odd_vectors(spark):
    x = [1.0, 2.0, 3.0]
    rows = [(1, x), (1, x), (2, [2.0, 4.0, 6.0]), (3, [-1.0, -2.0, -3.0]), (None, x), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 3.0]), (8, [float("nan"), 2.0, 3.0]), (9, [float("inf"), 2.0, 3.0]), (10, [1.0, 2.0]), (11, [1.0, 2.0]), (12, [0.0, -0.0, 5.0]), (13, [-0.0, 0.0, 5.0]), (14, [1e-30, 2e-30, 3e-30]), (None, None)]
    assert found(spark, rows) == slow(rows)


def test_a_third_of_all_rows_are_one_vector(spark):
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(400)] + [(1000 + i, x) for i, (_, x) in enumerate(balls([], dim=3, alone=30))]
    assert found(spark, rows) == slow(rows)


def test_links_at_the_threshold_are_judged_in_double_precision(spark):
    rows = [(1, [4.0, 3.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])]  # cosines 0.8 and 0.6 exactly
    assert found(spark, rows, V.Graph(threshold=0.8)) == slow(rows, 0.8)
    assert [r[1] for r in found(spark, rows, V.Graph(threshold=0.8))] == [1, 1, 0]
    assert [r[1] for r in found(spark, rows, V.Graph(threshold=0.8 + 1e-9))] == [0, 0, 0]


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [0.0])], [(3, [1.0, 1.0])]])
def test_nothing_to_link(spark, rows):
    assert found(spark, rows) == slow(rows)


def test_other_columns_and_types(spark):
    df = spark.createDataFrame([("a", [1.0, 1.0], 3, 9), ("b", [1.0, 1.01], 4, 8)], "name string, v array<double>, id long, n int")
    assert sorted(map(tuple, V.near_duplicate_vectors(df, "name", "v").collect())) == [("a", 1, "a", True), ("b", 1, "a", False)]


def test_audit_measures_recall(spark):
    rows = balls([30], alone=10)
    classes = spark.createDataFrame(pa.table({"id": [i for i, _ in rows], "raw": [np.array(x, "<f8").tobytes() for _, x in rows], "n": [1] * len(rows)}))
    true = {k: n for k, n, _, _ in slow(rows)}
    counts = spark.createDataFrame([(k, n // 2) for k, n in true.items()], "id long, n long")
    g = V.Graph(audited=1000)
    assert V.audit(classes, counts, g, len(rows)) == sum(n // 2 for n in true.values()) / sum(true.values())
    assert V.audit(classes, counts.where("n < 0"), g, len(rows)) == 0


def test_the_graph_is_pruned_and_joins_copies_to_the_rest():
    r = np.random.default_rng(1)
    x = V.unit(np.concatenate((np.repeat(r.normal(size=(1, 8)), 150, axis=0), r.normal(size=(150, 8)))))
    a, b = V.build(x, V.Graph(), 0)
    assert np.bincount(a).mean() <= 2 * V.Graph().degree + 2 and (a != b).all() and len(np.unique(b)) == len(x) and len(np.unique(a * 1000 + b)) == len(a)
    assert (V.forest(a, b, len(x)) == 0).all()
