import json

from pyspark.sql import functions as F

from rollbook.functions import predicates as P
from rollbook.operators import extract as E
from rollbook.operators import views


def test_precedence(spark):
    ld = lambda x: f'<script type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>'
    deep = {"@graph": [{"@type": "WebPage", "duration": "PT9S"}, {"x": [{"@type": ["Clip", "Y"], "duration": "PT1M", "uploadDate": "2024-03-05T01:02", "actor": [{"name": "Ann &amp; Co"}, "Bo and Cy"]}]}]}
    meta = '<meta property="video:duration" content="90"><meta name="video:release_date" content="2024-01-02T00"><meta itemprop="actor" content="Dee, Eve">'
    pages = [(1, ld(deep) + meta, "https://x.example/1"), (2, ld("{broken") + meta, "https://x.example/2"), (3, "<b>Runs 2 min</b><i>Fay</i>", "https://r.example/3"), (4, "", ""), (5, None, None)]
    got = {r.id: (r.duration_sec, r.release_date, r.performers) for r in E.extract_metadata(spark.createDataFrame(pages, "id int, html string, url string"), recipes=(E.Recipe("r.example", r"Runs ([^<]*)", r"<i>([^<]*)</i>"),)).collect()}
    assert got == {1: (60, "2024-03-05", ["Ann & Co", "Bo", "Cy"]), 2: (90, "2024-01-02", ["Dee", "Eve"]), 3: (120, None, ["Fay"]), 4: (None, None, None), 5: (None, None, None)}


def test_records(spark):
    raw = [json.dumps({"_id": 7, "title": " River ", "date": "2024-03-05T00:00", "duration": "PT1M", "performers": [{"name": "Ann", "extras": {"gender": "Female"}}, {"name": "Bob", "gender": "male"}, {"name": "Ann"}]}), "{broken", json.dumps({"title": "no id"})]
    got = E.parse_records(spark.createDataFrame([(x,) for x in raw], "json string"), "Src", "https://s.example/", ("male",)).collect()
    assert (got[0].source_item_id, got[0].title, got[0].release_date, got[0].performers, got[0].duration_sec, got[0].release_url) == ("7", "River", "2024-03-05", ["Ann"], 60, "https://s.example/7")
    assert [r["_error"] for r in got] == [None, "unreadable record", "unreadable record"]


def test_listing_and_dates(spark):
    html = "<p>x</p><card><a href='/1'>One &amp; a</a><i>March 5, 2024</i><card><a href='/2'></a><i>soon</i>"
    df = spark.createDataFrame([(1, html)], "page int, html string")
    rows = E.parse_listing(df, "<card>", {"href": "href='([^']*)'", "title": "<a[^>]*>([^<]*)</a>", "date": "<i>([^<]*)</i>"})
    got = rows.withColumn("date", E.worded_date("date")).orderBy("card_ord").collect()
    assert [(r.href, r.title, r.date) for r in got] == [("/1", "One & a", "2024-03-05"), ("/2", None, None)]


def test_embedded_json_tags_routes(spark):
    df = spark.createDataFrame([('<div data-page="{&quot;a&quot;:{&quot;b&quot;:1}}">',), ("<p>",)], "html string")
    got = [r[0] for r in df.select(E.parsed(E.embedded_json("html", "data-page"), "struct<a:struct<b:int>>")["a"]["b"]).collect()]
    assert got == [1, None]
    tags = F.array(F.lit('"x"'), F.lit('{"name":"y","pivot":{"id":3}}'), F.lit('"x"'), F.lit("{}"))
    assert spark.range(1).select(E.normalised_tags(tags)).first()[0] == ["x", "y"]
    df = spark.createDataFrame([('var routes = {"a": "}{", "b": {"c": 1}}; x',), ("none",)], "s string")
    assert [r[0] for r in df.select(E.route_table("s", "routes")).collect()] == ['{"a": "}{", "b": {"c": 1}}', None]


def test_categories_and_gender(spark):
    posts = spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "id int, category_id int")
    cats = spark.createDataFrame([(10, "riv", "raw1"), (11, "zzz", "raw2")], "id int, slug string, name string")
    got = {r.id: (r.category, r.category_unmapped) for r in E.map_categories(posts, cats, {"riv": "River"}).collect()}
    assert got == {1: ("River", False), 2: ("raw2", True), 3: (None, False)}
    people = spark.createDataFrame([("1", "Ann"), ("2", "Bo"), ("3", "Cy"), ("4", "Dee")], "performer_id string, name string")
    t = lambda *r: spark.createDataFrame([(*x, k) for k, x in enumerate(r)], "performer_id string, name string, gender string, ordinal int")
    got = {r.name: r.gender for r in E.resolve_gender(people, t(("1", "Ann", "F"), ("1", "Ann", "G")), t(("2", "x", "H"), ("1", "x", "I")), t(("9", "CY", "J"))).collect()}
    assert got == {"Ann": "G", "Bo": "H", "Cy": "J", "Dee": "Unknown"}


def test_enrichment(spark):
    from rollbook.schema import ITEM

    row = lambda **v: tuple(v.get(n) for n in ITEM.fieldNames())
    items = spark.createDataFrame([row(id="1", release_url="u", release_date="2024-01-01"), row(id="2", release_url="v")], ITEM)
    pages = spark.createDataFrame([("u", 60, "2020-01-01", ["Ann"], 200)], "release_url string, duration_sec int, release_date string, performers array<string>, page_status int")
    got = {r.id: r for r in E.enrich_from_pages(items, pages).collect()}
    assert (got["1"].duration_sec, got["1"].release_date, got["1"].metadata_poor, got["1"].field_provenance) == (60, "2024-01-01", False, {"duration_sec": "page", "performers": "page"})
    assert got["2"].metadata_poor
    assert E.enrich_from_pages(items, pages, refresh=True).where("id = '1'").first().release_date == "2020-01-01"


def test_predicates(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    kind = P.LinkKind("a", ("a.example",), r"/v/\d+")
    for url, ok in (("https://a.example/v/1", True), ("http://a.example/v/1", False), ("https://a.example/v/1?x", False), ("https://u@a.example/v/1", False), ("https://axexample/v/1", False), (None, False)):
        assert one(kind.valid(F.lit(url).cast("string"))) is ok
    for host, private in (("10.0.0.1", True), ("172.16.0.1", True), ("172.32.0.1", False), ("localhost", True), ("a.example", False), ("[::1]", True), ("192.168.1.1", True), ("8.8.8.8", False), ("", True)):
        assert one(P.is_private_host(F.lit(host))) is private, host
    assert one(P.is_allowed_url(F.lit("https://A.example/x"), ["a.example"])) is True
    assert one(P.is_allowed_url(F.lit("ftp://a.example/x"), ["a.example"])) is False
    states = [one(P.source_state(F.lit(x).cast("string"))) for x in (None, "", "API key is missing", "HTTP 401", "HTTP 502")]
    assert states == ["ok", "ok", "config", "config", "failing"]
    assert [one(P.badge_state(F.lit(x).cast("string"), "no", "yes")) for x in ("no", "yes", None, "no yes", "maybe")] == ["clear", "barred", "pending", "mixed", "unrecognised"]
    assert [one(P.strikes(F.lit(x).cast("string"))) for x in ("2.7", "-1", "x", None)] == [2, 0, 0, 0]


def test_views(spark):
    items = spark.createDataFrame([("b 50% off", "l", ["Ann"], "2024-01-02", 1), ("a", "l", ["Bo"], None, 2), ("c", "m", None, "2024-01-01", 3)], "title string, label string, performers array<string>, release_date string, ord int").withColumn("label_id", F.col("label"))
    titles = lambda **k: [r.title[0] for r in views.watchlist(items, ties=("ord",), **k).collect()]
    assert titles() == ["b", "c", "a"] and titles(sort="title") == ["a", "b", "c"] and titles(sort="oldest") == ["a", "c", "b"]
    assert titles(q="50% O") == ["b"] and titles(q="5_") == [] and titles(q="ANN") == ["b"] and titles(label="m") == ["c"]
    status = spark.createDataFrame([("l", None, "t"), ("m", "HTTP 403", None), ("n", "boom", None)], "label_id string, error string, last_refresh string")
    health = views.source_health(status, items, F.col("ord") == 1)
    assert {r.label_id: (r.state, r.item_count, r.live_count, r.match_percent) for r in health.collect()} == {"l": ("ok", 2, 1, 50), "m": ("config", 1, 0, 0), "n": ("failing", 0, 0, None)}
    assert views.health_summary(health).first().line == "1 failing, 1 not configured"


def test_linked_listing(spark):
    data = {"@type": "ItemList", "itemListElement": [{"position": 1, "url": "/a", "name": "One &amp; a"}, {"item": {"url": "https://o.example/b", "name": "Two", "duration": "PT1M", "uploadDate": "2024-03-05T00"}}]}
    html = f'<script type="application/ld+json">{{broken</script><script type="application/ld+json">{json.dumps(data)}</script>'
    got = E.parse_linked_listing(spark.createDataFrame([("https://x.example/list?p=1", html), ("u", "")], "url string, html string")).orderBy("place").collect()
    assert [(r.link, r.title, r.duration_sec, r.date) for r in got] == [("https://x.example/a", "One & a", None, None), ("https://o.example/b", "Two", 60, "2024-03-05")]


def test_posts(spark):
    post = {"id": 5, "date": "2024-03-06T01", "date_gmt": "2024-03-05T17", "link": "l", "title": {"rendered": "A &#8211; b"}, "content": {"rendered": "<p><img class='x' src='i.jpg'>"}, "categories": [7, 8]}
    got = E.parse_posts(spark.createDataFrame([(json.dumps(post),), ("no",)], "json string"), "S").collect()
    assert (got[0].source_item_id, got[0].title, got[0].release_date, got[0].category_id, got[0].thumbnail_url) == ("5", "A – b", "2024-03-05", 7, "i.jpg")
    assert got[1]["_error"] == "unreadable post"


def test_page_rows_and_details(spark):
    import html as h

    page = lambda v: f'<div data-page="{h.escape(json.dumps(v))}">'
    rows = {"rows": [{"id": "1", "title": "One", "writer": {"slug": "", "id": "w1"}}, {"title": "no id"}], "next": "c2"}
    got = E.parse_listing_rows(spark.createDataFrame([("a", page(rows)), ("b", "<p>")], "url string, html string")).collect()
    assert sorted((r.url, r.item_id or "", r["group"] or "", r.next or "", r["_error"] or "") for r in got) == [("a", "1", "w1", "c2", ""), ("b", "", "", "", "no page data")]
    detail = {"id": "1", "tags": ["x", {"name": "y"}, "x"], "badge": "N"}
    got = E.parse_details(spark.createDataFrame([("a", page(detail)), ("b", "")], "url string, html string")).orderBy("url").collect()
    assert (got[0].item_id, got[0].tags, got[0].badge, got[0].removed) == ("1", ["x", "y"], "N", False)
    assert got[1]["_error"] == "no detail data"


def test_composed_sources(spark, tmp_path):
    from rollbook.operators import rules
    from rollbook.sources import specs

    page = '<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"item":{"url":"/v/7","name":"Seven","duration":"PT9M","uploadDate":"2024-03-05"}},{"url":"https://l.example/v/8","name":"%s"}]}</script>'
    spark.createDataFrame([("https://l.example/1", page % "Eight"), ("https://l.example/2", page % "Eight again")], "url string, html string").write.parquet(str(tmp_path / "lists"))
    got = specs.linked_listing_source("l", "L", "https://l.example").load(spark, str(tmp_path / "lists")).collect()
    assert sorted((r.source_item_id, r.title, r.duration_sec, r.release_date, r.release_url) for r in got) == [("7", "Seven", 540, "2024-03-05", "https://l.example/v/7"), ("8", "Eight again", None, None, "https://l.example/v/8")]

    cards = "<div><li class=c><a href='/s/1'>One</a><i>March 5, 2024</i><li class=c><b>no link</b>"
    spark.createDataFrame([("https://c.example/1", cards)], "url string, html string").write.parquet(str(tmp_path / "cards"))
    spec = specs.card_listing_source("c", "C", "https://c.example", "<li class=c>", {"link": "href='([^']+)'", "title": "'>([^<]+)</a>", "date": "<i>([^<]+)</i>"})
    assert [(r.source_item_id, r.title, r.release_date, r.release_url) for r in spec.load(spark, str(tmp_path / "cards")).collect()] == [("1", "One", "2024-03-05", "https://c.example/s/1")]

    post = '{"id":%d,"date_gmt":"2024-03-05T01:00:00","link":"https://p/%d","title":{"rendered":"%s"},"categories":[1]}'
    (tmp_path / "posts").mkdir()
    (tmp_path / "posts" / "a.json").write_text("\n".join([post % (1, 1, "red river"), post % (2, 2, "plain"), post % (1, 1, "red river again"), "{broken"]))
    table = rules.RuleTable((rules.Rule("topic", "keep", ("red",)),), default_verdict="drop")
    lane = specs.post_source("p", "P", "https://p", table, spark.createDataFrame([(1, "s", "raw")], "id long, slug string, name string"), {"s": "Shown"})
    assert not lane.matching
    rows = lane.load(spark, str(tmp_path / "posts")).collect()
    assert [(r.source_item_id, r.title, r.label, r.release_date) for r in rows] == [("1", "red river again", "Shown", "2024-03-05")]
    items = spark.createDataFrame([("1", ["Ann", "Bo", "Cy"])], "source_item_id string, performers array<string>")
    told = lambda rows: spark.createDataFrame(rows, "performer_id string, name string, gender string, ordinal int")
    out = specs.with_genders(items, told([("ann", "x", "female", 1)]), told([("bo", "x", "Male", 1)]), told([("x", "Cy", "male", 1)]), ("male",))
    assert out.first().performers == ["Ann"]
