"""Measurements of linkage: how precise rules are on judged pairs, what each test adds, and how much of a catalogue is linked."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import percent
from rollbook.operators.linkage import Gate, Sides, band_join


@dataclass(frozen=True)
class MatchRule:
    """Accepts a pair whose durations differ by tolerance at most and of which one of tests holds."""

    name: str
    tolerance: float
    tests: tuple[Gate, ...]

    def accepts(self, s: Sides) -> Column:
        near = F.abs(F.col(s.cand_duration).try_cast("double") - F.col(s.duration)) <= self.tolerance
        return F.coalesce(near & reduce(lambda a, b: a | b, (F.coalesce(t(s), F.lit(False)) for t in self.tests)), F.lit(False))


def compared(items: DataFrame, candidates: DataFrame, truth: DataFrame, s: Sides, tolerance: float, on: list[str] | None) -> DataFrame:
    """Pairs of like duration with is_true: whether truth (item, address) holds the pair. One join serves all rules."""
    pairs = band_join(items.where(F.col(s.duration) > 0), candidates, s.duration, s.cand_duration, tolerance, on)
    judged = truth.select(F.col(s.item), F.col(s.cand_url), F.lit(True).alias("__true")).distinct()
    return pairs.join(judged, [s.item, s.cand_url], "left").withColumn("is_true", F.coalesce("__true", F.lit(False))).drop("__true")


def rule_report(items: DataFrame, candidates: DataFrame, truth: DataFrame, rules: list[MatchRule], s: Sides = Sides(), on: list[str] | None = None) -> DataFrame:
    """A row for each rule: accepts, true_accepts, false_accepts, precision in percent (null without accepts), items_linked to a
    true candidate, and items that have a duration at all.

    All rules are judged on the pairs of the widest tolerance, in one pass; an item's accepts are counted before they meet
    another item's. Ambiguity is not resolved here: every accepted pair counts.
    """
    spark = items.sparkSession
    pairs = compared(items, candidates, truth, s, max(r.tolerance for r in rules), on)
    fired = F.filter(F.array(*(F.when(r.accepts(s), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())
    each = pairs.select(F.col(s.item).alias("__item"), "is_true", F.explode(fired).alias("rule"))
    by_item = each.groupBy("rule", "__item").agg(F.count("*").alias("n"), F.count_if("is_true").alias("good"))
    counted = by_item.groupBy("rule").agg(F.sum("n").alias("accepts"), F.sum("good").alias("true_accepts"), F.count_if(F.col("good") > 0).alias("items_linked"))
    able = items.where(F.col(s.duration) > 0).agg(F.count("*").alias("items"))
    named = spark.createDataFrame([(r.name,) for r in rules], "rule string")
    zero = lambda c: F.coalesce(c, F.lit(0))
    every = named.join(F.broadcast(able)).join(counted, "rule", "left")  # a row for each rule, and one count
    return every.select("rule", zero("accepts").alias("accepts"), zero("true_accepts").alias("true_accepts"), (zero("accepts") - zero("true_accepts")).alias("false_accepts"), percent(zero("true_accepts"), zero("accepts")).alias("precision"), zero("items_linked").alias("items_linked"), "items")


def disjunct_report(items: DataFrame, candidates: DataFrame, truth: DataFrame, tests: dict[str, Gate], tolerance: float, s: Sides = Sides(), on: list[str] | None = None) -> DataFrame:
    """A row for each test of a disjunction: how often it fires, how often on a true pair, and on how many true and false pairs
    it is the only one that does: what the disjunction would lose without it, and be spared."""
    spark = items.sparkSession
    pairs = compared(items, candidates, truth, s, tolerance, on)
    fired = F.filter(F.array(*(F.when(F.coalesce(t(s), F.lit(False)), F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())
    each = pairs.select("is_true", fired.alias("__fired")).select("is_true", (F.size("__fired") == 1).alias("alone"), F.explode("__fired").alias("test"))
    good, alone = F.col("is_true"), F.col("alone")
    counted = each.groupBy("test").agg(F.count("*").alias("fires"), F.count_if(good).alias("true_fires"), F.count_if(good & alone).alias("only_true"), F.count_if(~good & alone).alias("only_false"))
    named = spark.createDataFrame([(n,) for n in tests], "test string")
    return named.join(counted, "test", "left").na.fill(0)


def coverage(items: DataFrame, sources: list[str], label: str = "label_id", links: str = "links", duration: str = "duration_sec") -> DataFrame:
    """A row for each label, and one of label null for all: items, with_duration (no more can be linked by duration), the items
    that each source has a link for (dead ones are in a column of their own), linked (by any of them), and percent.

    What is counted are flags of one row each, so that a label of very many items is a partial aggregate.
    """
    of = lambda source: F.coalesce(F.exists(links, lambda x: x["source"] == source), F.lit(False))
    has = {n: of(n) for n in sources}
    flags = items.select(F.coalesce(F.col(label).cast("string"), F.lit("")).alias(label), (F.coalesce(F.col(duration), F.lit(0)) > 0).alias("__timed"), *(c.alias(f"by_{n}") for n, c in has.items()))
    any_of = reduce(lambda a, b: a | b, (F.col(f"by_{n}") for n in sources))
    out = flags.rollup(label).agg(F.count("*").alias("items"), F.count_if("__timed").alias("with_duration"), *(F.count_if(f"by_{n}").alias(f"by_{n}") for n in sources), F.count_if(any_of).alias("linked"))
    return out.withColumn("percent", percent(F.col("linked"), F.col("items")))
