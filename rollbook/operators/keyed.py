"""Keyed unions, lookups with a second key, anti and semi selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import bound


def fan_in(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts; a column that a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def last_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by order; a partial aggregate on each side of one shuffle."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*(F.col(key) if c == key else F.col(f"__row.{c}").alias(c) for c in df.columns))


def first_per_key_with_tags(df: DataFrame, key: str, order: list[str], tag: str, tags: str) -> DataFrame:
    """The first row of each key, and an array of its rows' distinct tags in the order first seen."""
    rest = [c for c in df.columns if c not in (key, tag)]
    seen = df.groupBy(key, tag).agg(F.min(F.struct(*order)).alias("__first"), F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    met = seen.groupBy(key).agg(F.min_by("__row", "__first").alias("__row"), F.transform(F.array_sort(F.collect_list(F.when(F.col(tag).isNotNull(), F.struct("__first", F.col(tag).alias("__tag"))))), lambda x: x["__tag"]).alias(tags))
    return met.select(key, *(F.col(f"__row.{c}").alias(c) for c in rest), tags)


def union_per_key(df: DataFrame, key: str, order: list[str], place: str = "place") -> DataFrame:
    """Of each key the last row by order, and as place the order of its first row: last value, first position."""
    rest = [c for c in df.columns if c != key]
    met = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"), F.min(F.struct(*order)).alias(place))
    return met.select(*(F.col(key) if c == key else F.col(f"__row.{c}").alias(c) for c in df.columns), place)


def known(df: DataFrame, among: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is among the known."""
    return df.join(among.select(key), key, "left_semi")


def lookup_with_fallback(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """left with value of the right row that has its first key, or else its second, and so on.

    Of equal keys on the right the last by order counts; null keys match nothing. Each key is one equi-join.
    """
    out = left
    for k, key in enumerate(keys):
        found = right.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"__key{k}")).agg(F.max_by(value, F.struct(*order)).alias(f"__value{k}"))
        out = out.join(found, out[key] == found[f"__key{k}"], "left").drop(f"__key{k}")
    return out.withColumn(name, F.coalesce(*(f"__value{k}" for k in range(len(keys))))).drop(*(f"__value{k}" for k in range(len(keys))))


def unknown(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not among the known."""
    return df.join(known.select(key), key, "left_anti")


def replace_lane(prior: DataFrame, lane: str, of: str, rows: DataFrame) -> DataFrame:
    """prior without the lane's rows, and the lane's new rows."""
    return fan_in([prior.where(~F.col(of).eqNullSafe(F.lit(lane))), rows])


def union_links(links: Column, legacy: Column, dead: Column) -> Column:
    """links and then legacy, without addresses in dead, the first of each (source, url)."""
    none = F.array().cast("array<string>")
    gone = F.coalesce(F.transform(dead, lambda d: d["url"]), none)
    every = F.filter(F.when(links.isNull(), legacy).when(legacy.isNull(), links).otherwise(F.concat(links, legacy)), lambda x: ~F.array_contains(gone, x["url"]))
    first = bound(every, lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, F.lit(1), i), lambda y: (y["source"] == x["source"]) & (y["url"] == x["url"]))))
    return bound(first, lambda a: F.when(F.size(a) > 0, a))


def preferred_link(links: Column, sources: list[str]) -> Column:
    """First link of the first source that has one."""
    of = lambda source: F.filter(links, lambda x: x["source"] == source)  # noqa: E731  (a second argument would be the place)
    return F.coalesce(*(F.get(of(s), F.lit(0)) for s in sources))
