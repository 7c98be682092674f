"""Connected components by alternating star contractions over a link table; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import stored

#: A key is hot from so many rows on, and from a thousandth of all: at most 1,000 keys are.
HOT_ROWS, HOT_SHARE = 1000, 1000


def join_to_one(rows: DataFrame, one: DataFrame, by: str, total: int) -> DataFrame:
    """rows joined to one, which has a row for each value of by, and how many rows it has in rows as __n.

    total: how many rows there are. The rows of hot values stay where they are: their one row each is broadcast, and
    they are at most HOT_SHARE. All other rows are shuffled, none of whose values has more than its share.
    """
    least = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(one.where(F.col("__n") > least).drop("__n"))
    cold = one.where(F.col("__n") <= least).drop("__n")
    rest = rows.join(hot.select(by), by, "left_anti").join(cold, by)
    return rows.join(hot, by).unionByName(rest)


def large_star(e: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours are linked to its least neighbour. e: (u, v) with u > v."""
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("__n"))
    return join_to_one(both.where("v > u"), least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def small_star(e: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n"))
    moved = join_to_one(e, least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with a link; root is the least node of its component. Links to itself are ignored.

    The rounds are about log2 of the longest path; each round's links are written to the shared folder. A node with very
    many links is a broadcast row, not a task of its own.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e, before = stored(e, "stars"), None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or not mark[0]:
            break
        before = tuple(mark)
        e = stored(small_star(stored(large_star(e, 2 * mark[0]), "stars"), mark[0]), "stars")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select("v", "v").distinct().toDF("node", "root"))
