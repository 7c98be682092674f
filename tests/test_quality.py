from pyspark.sql import functions as F

from rollbook.operators import linkage, quality

ITEMS = "item_id int, title string, performers array<string>, duration_sec int, release_date string"
CANDS = "cand_title string, duration string, url string, views int"


def data(spark):
    items = spark.createDataFrame([(1, "first film", ["Ann Lee"], 100, "2024-01-01"), (2, "second film", ["Bo"], 200, "2024-01-01"), (3, "untimed", ["Cy"], None, None), (4, "alone", [], 900, None)], ITEMS)
    cands = spark.createDataFrame([("ann lee a", "101", "a", 9), ("lee", "102", "b", 90), ("ann lee far", "125", "c", 9), ("bo", "200.0", "d", 9), ("bo again", "198", "e", 90), ("bo", "long", "f", 9), (None, None, "g", None)], CANDS)
    truth = spark.createDataFrame([(1, "a"), (1, "a"), (1, "c"), (2, "d"), (9, "z")], "item_id int, url string")
    return items, cands, truth


def popular(s):
    return F.col(s.cand_views) > 50


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rules_are_judged_on_one_join(spark):
    items, cands, truth = data(spark)
    rules = [quality.MatchRule("name 2", 2, (linkage.open_identity,)), quality.MatchRule("name 30", 30, (linkage.open_identity,)), quality.MatchRule("either", 2, (linkage.open_identity, popular)), quality.MatchRule("never", 2, (lambda s: F.lit(None).cast("boolean"),))]
    assert rows(quality.rule_report(items, cands, truth, rules)) == [("either", 4, 2, 2, 50, 2, 3), ("name 2", 3, 2, 1, 67, 2, 3), ("name 30", 4, 3, 1, 75, 2, 3), ("never", 0, 0, 0, None, 0, 3)]


def test_what_a_test_brings_alone(spark):
    items, cands, truth = data(spark)
    got = quality.disjunct_report(items, cands, truth, {"name": linkage.open_identity, "popular": popular, "never": lambda s: F.lit(False)}, 2)
    assert rows(got) == [("name", 3, 2, 2, 0), ("never", 0, 0, 0, 0), ("popular", 2, 0, 0, 1)]


def test_reports_of_nothing(spark):
    items, cands, truth = data(spark)
    rule = quality.MatchRule("r", 2, (linkage.open_identity,))
    assert rows(quality.rule_report(items.limit(0), cands, truth, [rule])) == [("r", 0, 0, 0, None, 0, 0)]
    assert rows(quality.rule_report(items, cands.limit(0), truth.limit(0), [rule])) == [("r", 0, 0, 0, None, 0, 3)]


def test_coverage_by_label_and_of_all(spark):
    link = "array<struct<source:string,url:string>>"
    items = spark.createDataFrame([("x", [("a", "u")], 5), ("x", [("a", "u"), ("b", "v"), ("b", "w")], 0), ("y", None, 7), (None, [], None)], f"label_id string, links {link}, duration_sec int")
    assert rows(quality.coverage(items, ["a", "b"])) == [("", 1, 0, 0, 0, 0, 0), ("x", 2, 1, 2, 1, 2, 100), ("y", 1, 1, 0, 0, 0, 0), (None, 4, 2, 2, 1, 2, 50)]
    assert rows(quality.coverage(items.limit(0), ["a", "b"]))[-1:] in ([], [(None, 0, 0, 0, 0, 0, None)])
