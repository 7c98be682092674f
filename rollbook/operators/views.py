"""The read side: searchable listings, health by source, counts by month and label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.predicates import contains_query, is_live, source_state
from rollbook.functions.text import percent

ORDERS = {"title": lambda d, t: [F.col(t)], "oldest": lambda d, t: [F.col(d).asc_nulls_first()], "newest": lambda d, t: [F.col(d).desc_nulls_last()]}


def watchlist(items: DataFrame, label: str | None = None, q: str = "", sort: str = "newest", fields: tuple[str, ...] = ("title", "label", "performers"), label_id: str = "label_id", date: str = "release_date", title: str = "title", ties: tuple[str, ...] = ()) -> DataFrame:
    """Items of a label (or all) whose fields hold q, in one of ORDERS; metacharacters in q mean themselves."""
    rows = items if label is None else items.where(F.col(label_id) == label)
    if q:
        rows = rows.where(contains_query(q, *fields))
    return rows.orderBy(*ORDERS[sort](date, title), *ties)


def source_health(status: DataFrame, items: DataFrame, live: Column, key: str = "label_id", error: str = "error", refreshed: str = "last_refresh") -> DataFrame:
    """A row for each status row: state, items, items with a live link, their percent (null of none), last refresh.

    Items are counted before the join, so that what is shuffled is a row for each label and task.
    """
    counted = items.groupBy(key).agg(F.count("*").alias("item_count"), F.count_if(live).alias("live_count"))
    joined = status.join(counted, key, "left")
    n, k = F.coalesce("item_count", F.lit(0)), F.coalesce("live_count", F.lit(0))
    return joined.select(key, source_state(error).alias("state"), n.alias("item_count"), k.alias("live_count"), percent(k, n).alias("match_percent"), F.col(refreshed).alias("last_refresh"))


def has_live_link(links: str) -> Column:
    return F.coalesce(F.exists(links, is_live), F.lit(False))


def health_summary(health: DataFrame) -> DataFrame:
    """One row: failing and config sources, and a line that says so; the line is empty if all is well."""
    n = health.agg(F.count_if(F.col("state") == "failing").alias("failing"), F.count_if(F.col("state") == "config").alias("config"))
    part = lambda c, what: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {what}")))
    return n.withColumn("line", F.concat_ws(", ", part("failing", "failing"), part("config", "not configured")))


def month_counts(items: DataFrame, date: str) -> DataFrame:
    return items.groupBy(F.date_trunc("month", F.col(date)).cast("date").alias("month")).agg(F.count("*").alias("n"))


def label_counts(labels: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Every label with its number of items, 0 included."""
    counted = items.groupBy(key).agg(F.count("*").alias("__n"))
    return labels.join(counted, key, "left").withColumn("n", F.coalesce("__n", F.lit(0))).drop("__n")


def label_status(items: DataFrame, label_id: str = "label_id", label: str = "label", order: str = "ordinal") -> DataFrame:
    """Each label among the items with the name seen first."""
    return items.groupBy(label_id).agg(F.min_by(label, order).alias(label))
