import unicodedata

import pytest
from pyspark.sql import functions as F

from rollbook.functions import text as X


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("value", ["Crème Brûlée 2", "ﬁne ½ Ｗｉｄｅ", "Straße Ørsted", None, "", "日本 x1", "İstanbul É", "K℃ ①"])
def test_tokens_exact_and_native(spark, value):
    import re

    form = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", value or ""))).lower()
    want = re.findall("[a-z0-9]+", form)
    assert one(spark, X.tokens(F.lit(value).cast("string"))) == want


def test_folding_is_exact_for_every_block(spark):
    import random
    import re

    r = random.Random(1)
    chars = [chr(c) for c in [*range(0x20, 0x3000), *range(0xF900, 0xFFFF), *range(0x1D400, 0x1F200)]] + list("abcXYZ0 é") * 300
    texts = ["".join(r.choice(chars) for _ in range(12)) for _ in range(4000)]
    want = [re.findall("[a-z0-9]+", re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", t))).lower()) for t in texts]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", X.tokens("t").alias("x")).collect()
    assert all(g.x == want[g.i] for g in got)


def test_words_and_titles(spark):
    assert one(spark, X.words(F.lit("camelCase Two"))) == ["camel", "case", "two"]
    assert one(spark, X.title_words(F.lit("The Long Red River Crossing featuring A Name"))) == ["long", "red", "river", "crossing"]
    assert one(spark, X.title_words(F.lit("The River featuring A Name"))) == ["river", "featuring", "name"]
    assert one(spark, X.title_score(F.lit("long red river crossing"), F.lit("A crossing of the long red river"))) == 1.0
    assert one(spark, X.title_score(F.lit("long red river"), F.lit("long red river"))) == 0.0
    assert one(spark, X.title_score(F.lit("long red river crossing now"), F.lit("long red river crossing"))) == pytest.approx(0.8)
    assert one(spark, X.performer_name(F.lit("AnnLee"))) == "ann lee"
    assert one(spark, X.performer_name(F.lit("Ann Lee ls"))) == "ann lee"


def test_stems(spark):
    stem = lambda t: one(spark, X.title_stem(F.lit(t)))
    assert stem("NEW! Watch Long River 2024-03-05 https://a.example/x #tag #b") == "long river"
    assert stem("{new} Long River {watch/download: here} 24.03.05") == "long river"
    assert stem(None) == ""


@pytest.mark.parametrize(("title", "want"), [("River 2012 24.03.05", "river 2012"), ("River 1900 24.12.31 x", "river 1900 x"), ("River 2012 2024-03-05", "river 2012"), ("River 2024 03.05", "river"), ("River 2024-03-05 12", "river 12"), ("River 2024-03-05-06", "river 06"), ("River 2024 24 03", "river"), ("River 24.03.05", "river")])
def test_stem_of_a_number_before_a_date(spark, title, want):
    assert one(spark, X.title_stem(F.lit(title))) == want


@pytest.mark.parametrize(("title", "date", "want"), [("River 0305", "2024-03-05", True), ("River 306", "2024-03-05", True), ("River 0307", "2024-03-05", False), ("River", "2024-03-05", True), ("River 0305", None, False), ("River 1999 0305 x", "2024-03-05", True), ("River 0101", "2023-12-31", True), ("River 9999", "2024-03-05", True)])
def test_month_day_codes(spark, title, date, want):
    assert one(spark, X.month_day_matches(F.lit(title), F.lit(date).cast("string"))) is want


@pytest.mark.parametrize(("value", "want"), [("PT1H2M3S", 3723), ("P1DT1S", 86401), ("P1D", None), ("1:02:03", 3723), ("02:03", 123), ("0:00", 0), ("1 hr 2 min", 3720), ("90", 90), ("1.5", 2), ("0", None), ("", None), (None, None), ("soon", None), ("2 seconds", 2), ("PT0S", None)])
def test_durations(spark, value, want):
    assert one(spark, X.parse_duration(F.lit(value).cast("string"))) == want


def test_durations_without_words(spark):
    assert one(spark, X.parse_duration(F.lit("1 hr"), worded=False)) is None


def test_entities_names_attributes(spark):
    assert one(spark, X.clean_text(F.lit(" a &amp; b &#39;c&#x27; &QUOT;d&quot; "))) == "a & b 'c' \"d\""
    assert one(spark, X.names(F.lit("Ann Lee, Bo &amp; Cy and Dee, Ann Lee"))) in (["Ann Lee", "Bo & Cy", "Dee"],)
    assert one(spark, X.attributes(F.lit("<meta Name=\"a\" content='x \"y\" z' name='b'>"))) == {"name": "b", "content": 'x "y" z'}
    df = spark.createDataFrame([("&#65;&#x42;&nbsp;&amp;&#39;",), (None,), ("&#1114112;&#xD800;&#128512;",), ("&amp;#65; &lt;&eacute;",)], "s string")
    assert [r[0] for r in df.select(X.decode_numeric_entities("s")).collect()] == ["AB&nbsp;&'", None, "&#1114112;&#xD800;\U0001f600", "&#65; <&eacute;"]
    assert one(spark, X.url_component(F.lit("a b&c"))) == "a%20b%26c"
    assert one(spark, X.search_slug(F.lit("Été à Paris!"))) == "ete-a-paris"
    assert one(spark, X.initials(F.lit("long red river"))) == "LR"
    assert one(spark, X.escape_html(F.lit("<a&'\">"))) == "&lt;a&amp;&#39;&quot;&gt;"


def test_glossary_is_longest_first(spark):
    got = one(spark, X.apply_glossary(F.lit("新作大河"), [("大", "big"), ("大河", "river"), ("新作", "new")]))
    assert (got.text, got.hits, got.residual, got.translated) == ("new river", 2, False, True)
    got = one(spark, X.apply_glossary(F.lit("大河 字"), [("大河", "river")]))
    assert (got.residual, got.translated) == (True, False)
    assert not one(spark, X.apply_glossary(F.lit("plain"), [("大", "big")])).translated


def test_search_queries(spark):
    people = F.array(F.lit("Ann Lee"), F.lit("Bo Ray"), F.lit("Cy Poe"), F.lit("Ann Lee"))
    assert one(spark, X.search_queries(F.lit("Ann Lee and the long red river crossing at night"), people, F.lit("rv12"), F.lit("Label"), F.lit(False))) == ["ann lee", "bo ray", "long red river crossing night", "rv12", "Label"]
    assert one(spark, X.search_queries(F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.lit("Label"), F.lit(True))) == []


def test_percent_and_code(spark):
    assert one(spark, X.percent(F.lit(1), F.lit(200))) == 1
    assert one(spark, X.percent(F.lit(0), F.lit(0))) is None
    assert one(spark, X.configured_code(F.lit("River RV-12 here"), F.lit("(?i)rv-\\d+"))) == "rv-12"
    assert one(spark, X.configured_code(F.lit("River"), F.lit("rv-\\d+"))) is None
