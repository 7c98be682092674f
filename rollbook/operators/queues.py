"""Order, limits and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def catalogue_order(df: DataFrame, date: str = "release_date", ties: list[str] | None = None) -> DataFrame:
    """Newest first; equals in the order of ties, as Spark's sort is not stable."""
    return df.orderBy(F.col(date).desc_nulls_last(), *(ties or []))


def status_order(df: DataFrame, kind: str = "kind", ordinal: str = "ordinal", name: str = "name") -> DataFrame:
    """Sources in their registered order, then labels by name as a reader would order them; equal ones by their bytes."""
    return df.orderBy(F.when(F.col(kind) == "source", 0).otherwise(1), F.col(ordinal).asc_nulls_last(), F.collate(F.col(name), "UNICODE"), name)


def budget_queue(items: DataFrame, known: DataFrame, pending: DataFrame, key: str, date: str, budget: int, ties: list[str]) -> DataFrame:
    """What to look at next: rows neither known nor pending, newest first, then pending and not known ones; budget rows.

    is_pending tells which; a negative budget is none.
    """
    fresh = items.join(known.select(key), key, "left_anti")
    waiting = pending.select(F.col(key)).distinct().withColumn("__waits", F.lit(True))
    marked = fresh.join(waiting, key, "left").withColumn("is_pending", F.coalesce("__waits", F.lit(False))).drop("__waits")
    return marked.orderBy("is_pending", F.col(date).desc_nulls_last(), *ties).limit(max(0, budget))


def top_per_group(df: DataFrame, group: str, order: list, k: int = 1) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__place") <= k).drop("__place")
