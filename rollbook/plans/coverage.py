"""Queries that run one catalogue operator each over rows made from the driver's tables, with SQL that says what must come out.

Inputs that the tables lack (pages, landed JSON, links) are put together from their columns; the SQL works the answer out from
the same columns.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions import predicates as P
from rollbook.functions import text as X
from rollbook.operators import admission, extract, keyed, lifecycle, linkage, merge, quality, queues, rules, translate, views, window
from rollbook.plans import jobs
from rollbook.plans.harness import NOW, day_of, query, read
from rollbook.schema import DEAD_LINK, ITEM, LINK, STATUS, conformed
from rollbook.session import scratch
from rollbook.sources import specs, store
from rollbook.streaming import incremental

LINKS, DEAD_LINKS = f"array<{LINK.simpleString()}>", f"array<{DEAD_LINK.simpleString()}>"
#: Fixed values of the made-up links: hosts and paths of two sources.
KINDS = [P.LinkKind("primary", ("a.example", "www.a.example"), "/post/[a-z0-9]+\\.html"), P.LinkKind("secondary", ("b.example",), "/v-[a-z0-9]+")]
SCREEN = rules.Rule("screen", "exclude", ("#5",), ("title", "tags"))
OWN_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def orders(spark, sf) -> DataFrame:
    """Orders with short names: k (key), c (customer), m (key modulo 10, which picks a row's form), day."""
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), (F.col("o_orderkey") % 10).alias("m"), day_of().alias("day"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))


def put(*parts: Column | str) -> Column:
    """Texts and columns as one text."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def ld(*parts: Column | str) -> Column:
    return put('<html><script type="application/ld+json">', *parts, "</script></html>")


def k() -> Column:
    return F.col("k")


def c() -> Column:
    return F.col("c")


def m() -> Column:
    return F.col("m")


def link(source: Column | str, url: Column, verified: Column | None = None, failures: Column | None = None) -> Column:
    """A link as the catalogue has it."""
    source = F.lit(source) if isinstance(source, str) else source
    none = F.lit(None).cast("string")
    return F.struct(source.alias("source"), url.alias("url"), none.alias("embed_url"), (none if verified is None else verified).alias("verified_at"), (F.lit(None) if failures is None else failures).cast("int").alias("failures"))


def dead_link(source: str, url: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(source).alias("source"), url.alias("url"), none.alias("embed_url"), none.alias("verified_at"), none.alias("dead_at"), F.lit("gone").alias("dead_reason"))


def urls(links: str) -> Column:
    """Addresses of links as one text, empty for none."""
    return F.coalesce(F.array_join(F.transform(links, lambda x: x["url"]), ","), F.lit(""))


# --- sources and sinks


@query(f"select o_orderkey as id, {OWN_DAY} as day, o_orderpriority as title from orders")
def store_round_trip(spark, sf):
    """A snapshot written and published, then read by its pointer."""
    root = scratch(spark, "catalogue")
    rows = orders(spark, sf).select(k().cast("string").alias("id"), F.col("day").alias("release_date"), F.col("priority").alias("title"))
    store.write_catalogue(spark, root, rows, spark.createDataFrame([], STATUS), "now", None)
    items, _, _ = store.read_catalogue(spark, root)
    return items.select(F.col("id").cast("long").alias("id"), F.col("release_date").alias("day"), "title")


@query("select p_name as original, any_value('to ' || p_name) as title from part group by p_name")
def translation_cache(spark, sf):
    """The cache written and read back."""
    path = scratch(spark, "cache")
    cache = read(spark, sf, "part").select(F.col("p_name").alias("original")).distinct().select("original", put("to ", F.col("original")).alias("title"), F.lit("glossary").alias("provider"), F.lit(True).alias("translated"))
    store.write_translations(cache, path)
    return store.read_translations(spark, path).select("original", "title")


@query("select cast(n_nationkey as varchar) as n_nationkey, n_name from nation")
def csv_seed(spark, sf):
    path = scratch(spark, "seed")
    read(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("\ufeffn_nationkey"), "n_name").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return store.read_csv_seed(spark, path).select("n_nationkey", "n_name")


RECORD_ID = "case when o_orderkey % 10 < 7 then 'r' || o_orderkey else 's' || o_orderkey end"


@query(f"select {RECORD_ID} as id, o_orderpriority || ' ' || o_orderkey as title, {OWN_DAY} as day, case when o_orderkey % 10 = 9 then '' else 'C' || o_custkey end as people, case when o_orderkey % 10 < 5 then 'https://s.example/' || o_orderkey else 'https://s.example/' || {RECORD_ID} end as url from orders where o_orderkey % 10 <> 8")
def api_records(spark, sf):
    """Landed API answers through a registered source: ids, titles, performers but for an excluded gender, addresses."""
    path = scratch(spark, "records")
    ident = F.when(m() == 8, "").when(m() < 7, put('"id":"r', k(), '",')).otherwise(put('"slug":"s', k(), '",'))
    address = F.when(m() < 5, put('"url":"https://s.example/', k(), '",')).otherwise("")
    gender = F.when(m() == 9, "male").otherwise("female")
    rows = orders(spark, sf).select(put('{"data":[{', ident, address, '"title":" ', F.col("priority"), " ", k(), ' ","date":"', F.col("day"), 'T00:00:00","performers":[{"name":"C', c(), '","extras":{"gender":"', gender, '"}}]}]}').alias("value"))
    rows.write.mode("overwrite").text(path)
    registry = specs.Registry()
    spec = registry.add(specs.record_source("s", "S", "https://s.example", ("male",)))
    return spec.load(spark, path).select(F.col("source_item_id").alias("id"), "title", F.col("release_date").alias("day"), F.array_join("performers", ",").alias("people"), F.col("release_url").alias("url"))


@query("select n_nationkey from nation where lower(trim(n_name)) = (select lower(n_name) from nation where n_nationkey = 7) or n_nationkey = 3")
def site_lookup(spark, sf):
    """Sites by name or short name, whatever the case; nation 3 has nation 7's name as its short name."""
    sites = read(spark, sf, "nation").withColumnRenamed("n_name", "name")
    wanted = sites.where("n_nationkey = 7").first()["name"]
    named = sites.withColumn("name", put(" ", F.lower("name"))).withColumn("short_name", F.when(F.col("n_nationkey") == 3, wanted))
    return specs.sites_by_name(named, wanted.title()).select("n_nationkey")


@query("select o_orderkey as k, case o_orderkey % 10 when 0 then 'answer without data' when 1 then 'denied' else '' end as wrong, case when o_orderkey % 10 < 2 then 0 else 2 end as n from orders")
def envelopes(spark, sf):
    """Landed answers: what is wrong with each, and how many records it holds."""
    text = F.when(m() == 0, "[1").when(m() == 1, '{"error":"denied"}').otherwise('{"data":[{"a":1},{"a":2}]}')
    records, wrong = specs.envelope("json")
    return orders(spark, sf).withColumn("json", text).select("k", F.coalesce(wrong, F.lit("")).alias("wrong"), F.size(records).alias("n"))


# --- extraction

BRANCH = "case o_orderkey % 10 when 0 then 'ld' when 1 then 'ld' when 2 then 'ld' when 3 then 'meta' when 4 then 'meta' when 5 then 'recipe' else 'none' end"


@query(f"""
select k, case b when 'ld' then 60 * (c % 100) + 61 when 'meta' then c % 60 + 1 when 'recipe' then c % 50 + 2 else -1 end as seconds,
 case b when 'ld' then d when 'meta' then d else '' end as day, case b when 'ld' then 'A' || c || ',B' when 'meta' then 'M' || c || ',N' when 'recipe' then 'R' || c else '' end as people, b = 'none' as poor
from (select o_orderkey k, o_custkey c, {OWN_DAY} d, {BRANCH} b from orders)""")
def metadata_precedence(spark, sf):
    """Duration, date and performers of a page: linked data (nested, of several types) before meta tags before a host's recipe."""
    video = put('{"@type":["Thing","videoObject"],"duration":"PT', c() % 100, 'M61S","datePublished":"', F.col("day"), 'T10:00:00Z","actor":[{"name":" A', c(), ' "},{"name":"B"},{"name":"B"}]}')
    nested = F.when(m() == 0, video).when(m() == 1, put('{"@graph":[{"@type":"Person","duration":"PT9S"},', video, "]}")).otherwise(put('[{"a":{"b":[', video, "]}}]"))
    meta = put('<meta property="og:video:duration" content="', c() % 60 + 1, '"><meta content="', F.col("day"), '" name="release_date"><meta name="actor" content="M', c(), ' and N, N">')
    html = F.when(m() < 3, put('<script type="application/ld+json">{broken</script>', ld(nested), meta)).when(m() < 5, meta).when(m() == 5, put("<b>Length: ", c() % 50 + 2, " seconds</b><i>With: R", c(), "</i>")).otherwise("<p>nothing</p>")
    pages = orders(spark, sf).withColumn("html", html).withColumn("url", put("https://r.example/", k()))
    out = extract.extract_metadata(pages, recipes=(extract.Recipe("r.example", r"Length: ([^<]+)<", r"With: ([^<]+)<"),))
    poor = P.is_incomplete(F.col("duration_sec"), F.col("release_date"), F.col("performers"))
    return out.select("k", F.coalesce("duration_sec", F.lit(-1)).alias("seconds"), F.coalesce("release_date", F.lit("")).alias("day"), F.coalesce(F.array_join("performers", ","), F.lit("")).alias("people"), (poor & F.col("duration_sec").isNull()).alias("poor"))


@query("select o_orderkey as k, case o_orderkey % 10 when 0 then 'Ann ' || o_custkey || '|Bo|Cy' when 1 then 'A&B' else 'Sandy ' || o_custkey end as people from orders")
def person_names(spark, sf):
    """Names in running text."""
    text = F.when(m() == 0, put("Ann ", c(), ", Bo and Cy & Bo,, ")).when(m() == 1, "A&amp;B").otherwise(put(" Sandy ", c(), " "))
    return orders(spark, sf).select("k", F.array_join(X.names(text), "|").alias("people"))


@query("select o_orderkey as k, o_orderkey % 10 in (0, 1) as allowed, o_orderkey % 10 in (4, 5, 6, 7, 8) as private from orders")
def url_allowlist(spark, sf):
    """Addresses by scheme, host list and private networks."""
    host = F.when(m().isin(0, 1, 2), "a.example").when(m() == 3, "b.example").when(m() == 4, "127.0.0.1").when(m() == 5, put("10.", c() % 200, ".1.1")).when(m() == 6, "192.168.1.9").when(m() == 7, "172.20.0.1").when(m() == 8, "localhost").otherwise("8.8.8.8")
    scheme = F.when(m() == 2, "ftp").when(m() == 1, "http").otherwise("https")
    return orders(spark, sf).select("k", P.is_allowed_url(put(scheme, "://", host, "/x?y=", k()), ["a.example", "127.0.0.1", "localhost"]).alias("allowed"), P.is_private_host(host).alias("private"))


@query(f"""select o_orderkey as k, case when o_orderkey % 10 < 3 then 60 when o_orderkey % 10 < 6 then 30 else -1 end as seconds, {OWN_DAY} as day, case when o_orderkey % 10 < 6 then 'P' || o_custkey else '' end as people,
 case when o_orderkey % 10 < 3 then 'performers' when o_orderkey % 10 < 6 then 'duration_sec,performers' else '' end as filled, o_orderkey % 10 >= 6 as poor from orders""")
def page_enrichment(spark, sf):
    """Missing fields filled from landed pages, and where each came from; rows without a page stay poor."""
    o = orders(spark, sf)
    items = conformed(o.select(k().cast("string").alias("id"), F.col("day").alias("release_date"), F.when(m() < 3, 60).alias("duration_sec"), put("u", k()).alias("release_url")))
    pages = o.where(m() < 6).select(put("u", k()).alias("release_url"), F.lit(30).alias("duration_sec"), F.lit("1990-01-01").alias("release_date"), F.array(put("P", c())).alias("performers"), F.lit(200).alias("page_status"))
    out = extract.enrich_from_pages(items, pages)
    filled = F.array_join(F.array_sort(F.map_keys(F.coalesce("field_provenance", F.create_map().cast("map<string,string>")))), ",")
    return out.select(F.col("id").cast("long").alias("k"), F.coalesce("duration_sec", F.lit(-1)).alias("seconds"), F.col("release_date").alias("day"), F.coalesce(F.array_join("performers", ","), F.lit("")).alias("people"), filled.alias("filled"), F.col("metadata_poor").alias("poor"))


@query(f"select o_orderkey as k, place, case place when 0 then 'https://l.example/v/' || o_orderkey else 'https://m.example/' || o_custkey end as link, case place when 0 then 'T & ' || o_orderkey else 'Second' end as title, case place when 0 then 65 else -1 end as seconds, case place when 0 then {OWN_DAY} else '' end as day from orders, (select unnest([0, 1]) as place) where o_orderkey % 10 < 5")
def linked_listing(spark, sf):
    """Elements of listing pages' linked data, with absolute addresses; other blocks and broken ones are passed over."""
    block = put('{"@type":"ItemList","itemListElement":[{"item":{"url":"/v/', k(), '","name":"T &amp; ', k(), '","duration":"PT1M5S","uploadDate":"', F.col("day"), 'T01:00:00"}},{"url":"https://m.example/', c(), '","name":"Second"}]}')
    html = F.when(m() < 5, put('<script type="application/ld+json">{"@type":"Other"}</script><script type="application/ld+json">{no</script>', ld(block))).otherwise(ld('{"@type":"Other"}'))
    pages = orders(spark, sf).select("k", html.alias("html"), put("https://l.example/list?p=", k()).alias("url"))
    return extract.parse_linked_listing(pages).select("k", "place", "link", "title", F.coalesce("duration_sec", F.lit(-1)).alias("seconds"), F.coalesce("date", F.lit("")).alias("day"))


@query(f"select o_orderkey as k, case when o_orderkey % 10 = 1 then '' else o_orderkey || '' end as id, case when o_orderkey % 10 in (0, 2) then '' else 'Film ' || o_custkey end as title, case when o_orderkey % 10 = 0 then '' when o_orderkey % 10 = 3 then '2024-13-99' else {OWN_DAY} end as day, case when o_orderkey % 10 = 0 then '' else 'A,B' end as people, case when o_orderkey % 10 < 3 then 'required metadata missing' when o_orderkey % 10 = 3 then 'invalid release date' else '' end as error from orders")
def video_pages(spark, sf):
    """Items from detail pages, with an error where a required field is missing or the date is none."""
    video = put('{"@type":"VideoObject","name":"', F.when(m() == 2, " ").otherwise(put(" Film ", c())), '","datePublished":"', F.when(m() == 3, "2024-13-99").otherwise(F.col("day")), 'T00:00","actor":[{"name":"A "},{"name":""},{"name":"B"},{"name":"A"}]}')
    pages = orders(spark, sf).select("k", F.when(m() == 0, "<p>").otherwise(ld(video)).alias("html"), put("https://v.example/", F.when(m() == 1, "list/").otherwise("video/"), k(), "/x").alias("url"))
    full = lambda c: F.coalesce(c, F.lit(""))
    out = extract.parse_video_page(pages, "V", r"^https://v\.example/video/([^/?#]+)")
    return out.select("k", full("source_item_id").alias("id"), full("title").alias("title"), full("release_date").alias("day"), F.array_join("performers", ",").alias("people"), full("_error").alias("error"))


@query(f"select k, card_ord, 'Card ' || k || '-' || card_ord as title, '/c/' || k as link, case when card_ord = 0 then day else '' end as day from (select o_orderkey k, {OWN_DAY} as day from orders), (select unnest([0, 1]) as card_ord)")
def card_listing(spark, sf):
    """Cards of listing pages, with worded dates."""
    worded = F.date_format(F.to_date("day"), "MMMM d, yyyy")
    card = lambda n, date: put('<div class="card"><a href="/c/', k(), '"><h2> Card ', k(), f"-{n} </h2></a><span>", date, "</span></div>")
    pages = orders(spark, sf).select("k", put("<body>before", card(0, worded), card(1, F.lit("soon")), "</body>").alias("html"))
    rows = extract.parse_listing(pages, r'<div class="card">', {"title": r"(?s)<h2>(.*?)</h2>", "link": r'href="([^"]+)"', "date": r"<span>([^<]*)</span>"})
    return rows.select("k", "card_ord", "title", "link", F.coalesce(extract.worded_date("date"), F.lit("")).alias("day"))


@query("select o_orderkey as k, 'a' || chr(cast(65 + o_custkey % 26 as integer)) || chr(cast(228 + o_custkey % 20 as integer)) || '&<\">' || '&nbsp;&#1114112;' as decoded from orders")
def character_references(spark, sf):
    """Decimal and hexadecimal references and the named ones; numbers that are no character stay."""
    text = put("a&#", 65 + c() % 26, ";&#x", F.lower(F.hex(228 + c() % 20)), ";&amp;&lt;&quot;&gt;&nbsp;&#1114112;")
    return orders(spark, sf).select("k", X.decode_numeric_entities(text).alias("decoded"))


DISPLAY = {"slug1": "One", "slug2": "Two"}


@query(f"""select o_orderkey as id, 'Post & ' || o_orderkey as title, {OWN_DAY} as day, case o_custkey % 4 when 1 then 'One' when 2 then 'Two' when 3 then 'raw3' else '' end as category, o_custkey % 4 = 3 as unmapped, case when o_orderkey % 10 < 5 then 'https://i/' || o_orderkey else 'https://j/x.png' end as thumbnail from orders where o_orderkey % 10 <> 9""")
def posts(spark, sf):
    """Landed posts: decoded titles, UTC dates, thumbnails, the first category's display name; posts without an id are errors."""
    ident = F.when(m() == 9, "").otherwise(put('"id":', k(), ","))
    media = F.when(m() < 5, put('"featured_media_url":"https://i/', k(), '",')).otherwise("")
    json = put("{", ident, media, '"date":"2030-01-01T00:00:00","date_gmt":"', F.col("day"), 'T09:00:00","link":"https://p/', k(), '","title":{"rendered":"Post &#038; ', k(), '"},"content":{"rendered":"<p><img src=\\"https://j/x.png\\"></p>"},"categories":[', c() % 4, ",9]}")
    rows = extract.parse_posts(orders(spark, sf).select(json.alias("json")), "P").where("_error is null")
    categories = spark.createDataFrame([(1, "slug1", "raw1"), (2, "slug2", "raw2"), (3, "slug3", "raw3")], "id long, slug string, name string")
    named = extract.map_categories(rows, categories, DISPLAY)
    return named.select(F.col("source_item_id").cast("long").alias("id"), "title", F.col("release_date").alias("day"), F.coalesce("category", F.lit("")).alias("category"), F.col("category_unmapped").alias("unmapped"), F.col("thumbnail_url").alias("thumbnail"))


@query(f"select o_orderkey as k, case when o_orderkey % 10 = 0 then '' else 'i' || o_orderkey end as item, case when o_orderkey % 10 = 0 then '' else 'It''s ' || o_custkey end as title, case when o_orderkey % 10 = 0 then '' when o_orderkey % 10 < 4 then 'w' || o_custkey when o_orderkey % 10 < 7 then '' || o_custkey else 'W' end as grp, case when o_orderkey % 10 = 0 then 'no page data' else '' end as error from orders")
def embedded_rows(spark, sf):
    """Listed entries of pages that carry their data as escaped JSON; entries without an id are dropped."""
    writer = F.when(m() < 4, put('{"id":"1","slug":"w', c(), '","name":"W"}')).when(m() < 7, put('{"id":"', c(), '","slug":"","name":"W"}')).otherwise('{"name":"W"}')
    json = put('{"rows":[{"id":"i', k(), '","title":"It&#39;s ', c(), '","release_date":"', F.col("day"), '","writer":', writer, '},{"title":"no id"}],"next":"n"}')
    html = F.when(m() == 0, "<div>").otherwise(put('<div data-page="', X.escape_html(json), '"></div>'))
    full = lambda c: F.coalesce(c, F.lit(""))
    return extract.parse_listing_rows(orders(spark, sf).select("k", html.alias("html"))).select("k", full("item_id").alias("item"), full("title").alias("title"), full("group").alias("grp"), full("_error").alias("error"))


@query("select o_orderkey as k, case when o_orderkey % 10 = 0 then '' else '' || o_orderkey end as item, case when o_orderkey % 10 = 0 then '' else 'plain,obj' || o_custkey end as tags, case when o_orderkey % 10 in (0, 1) then '' else 'B' end as badge, o_orderkey % 10 = 2 as removed, case when o_orderkey % 10 = 0 then 'no detail data' else '' end as error from orders")
def detail_rows(spark, sf):
    """Detail pages: tags that are texts or objects, badge, removal, and an error for pages without data."""
    badge = F.when(m() == 1, "").otherwise('"badge":"B",')
    json = put('{"id":"', k(), '",', badge, '"removed":', F.when(m() == 2, "true").otherwise("false"), ',"tags":["plain",{"name":"obj', c(), '","pivot":{"id":1}},"plain"]}')
    html = F.when(m() == 0, "<div>").otherwise(put('<div data-page="', X.escape_html(json), '"></div>'))
    full = lambda c: F.coalesce(c, F.lit(""))
    return extract.parse_details(orders(spark, sf).select("k", html.alias("html"))).select("k", full("item_id").alias("item"), F.array_join("tags", ",").alias("tags"), full("badge").alias("badge"), "removed", full("_error").alias("error"))


@query("select o_orderkey as k, case when o_orderkey % 10 = 0 then '' else '{\"a\": {\"uri\": \"}\\\"' || o_custkey || '\"}}' end as routes from orders")
def route_tables(spark, sf):
    """The JSON object behind a marker in a script, by its braces, whatever stands in its strings."""
    text = F.when(m() == 0, "const Other = {}").otherwise(put('x(); const Ziggy = {"a": {"uri": "}\\"', c(), '"}}; more({})'))
    return orders(spark, sf).select("k", F.coalesce(extract.route_table(text, "const Ziggy ="), F.lit("")).alias("routes"))


@query("select o_orderkey as k, case when o_orderkey % 10 = 0 then '-|-' else 'to ' || o_custkey || '|-' end as aligned from orders")
def aligned_translations(spark, sf):
    """Translations in a reply with text around its JSON, aligned with the inputs."""
    reply = F.when(m() == 0, "sorry").otherwise(put('Here: {"t', c(), '": " to ', c(), ' ", "u": " "} done'))
    return orders(spark, sf).select("k", F.array_join(translate.parse_translations(reply, F.array(put("t", c()), F.lit("u"))), "|", "-").alias("aligned"))


@query("select o_orderkey as k, replace(o_orderpriority, ' ', '%20') || '%26' || o_custkey as encoded, case when o_orderkey % 10 < 5 then 1700000000 + o_custkey - 60 else 996624000 + 300 end as ends from orders")
def addresses(spark, sf):
    """Percent-encoding, and the second at which an address ends."""
    url = F.when(m() < 5, put("https://h/", 1_700_000_000 + c(), "/x")).otherwise("https://h/123/x")
    return orders(spark, sf).select("k", X.url_component(put(F.col("priority"), "&", c())).alias("encoded"), X.expiry(url, F.lit(NOW)).alias("ends"))


# --- validation and predicates


@query(f"select 'o:' || o_orderkey as id, 'o' as source_id, case when o_orderkey % 10 < 5 then 'l' else 'o' end as label_id, false as matching from orders where o_orderdate between timestamp '2001-08-01' - interval 90 day and timestamp '2001-08-01'")
def validated_source(spark, sf):
    """A source's rows in the window, checked and stamped."""
    rows = orders(spark, sf).select(k().alias("source_item_id"), F.col("priority").alias("title"), F.col("day").alias("release_date"), F.when(m() < 5, "l").otherwise("").alias("label_id"))
    return window.validated(window.rolling_window(rows, "release_date", NOW), "o", "O", matching=False).select("id", "source_id", "label_id", "matching")


GOOD_LINK = "o_orderkey % 10 in (0, 1, 2)"


@query(f"select o_orderkey as k, {GOOD_LINK} as valid, case when {GOOD_LINK} then '' else 'bad' end as shown from orders")
def link_validity(spark, sf):
    """Links by their source's host and path; no other scheme, port, user, query or fragment."""
    url = F.when(m() == 0, put("https://a.example/post/p", k(), ".html")).when(m() == 1, put("https://www.a.example/post/", k(), ".html")).when(m() == 2, put("https://b.example/v-", k())).when(m() == 3, put("http://a.example/post/", k(), ".html")).when(m() == 4, put("https://a.example:8/post/", k(), ".html")).when(m() == 5, put("https://a.example/post/", k(), ".html?x")).when(m() == 6, put("https://u@a.example/post/", k(), ".html")).when(m() == 7, put("https://c.example/post/", k(), ".html")).when(m() == 8, put("https://b.example/v-", k()))
    source = F.when(m() == 2, "secondary").when(m() == 8, "third").otherwise("primary")
    valid = P.valid_link(source, url, KINDS)
    return orders(spark, sf).select("k", valid.alias("valid"), F.when(valid, "").otherwise("bad").alias("shown"))


@query("select o_orderkey as k, o_orderkey % 10 in (1, 2) as live, case o_orderkey % 10 when 3 then 4 when 4 then 2 else 0 end as strikes, case when o_orderkey % 10 = 5 then '2024-01-02' else '' end as day from orders")
def coercions(spark, sf):
    """Live links, strike counts and dates of defective values."""
    gone = F.when(m() == 2, False).when(m() == 3, True)
    there = F.when(m().isin(1, 2, 3), F.struct(gone.alias("dead")))
    count = F.when(m() == 3, "4").when(m() == 4, "2.9").when(m() == 5, "-3").when(m() == 6, "many")
    date = F.when(m() == 5, "2024-01-02T10:00:00Z").when(m() == 6, "yesterday")
    return orders(spark, sf).select("k", P.is_live(there).alias("live"), P.strikes(count).alias("strikes"), F.coalesce(F.date_format(P.instant(date), "yyyy-MM-dd"), F.lit("")).alias("day"))


# --- text

NAMES_SQL = "case o_orderkey % 10 when 0 then 'café''s ﬁne Ⅷ ' || o_custkey when 1 then 'AnnLee ls' when 2 then 'ÅSA bo' else o_orderpriority end"


@query("select o_orderkey as k, case o_orderkey % 10 when 0 then 'cafe s fine viii ' || o_custkey when 1 then 'annlee ls' when 2 then 'asa bo' else trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')) end as norm, case o_orderkey % 10 when 0 then 'cafe s fine viii ' || o_custkey when 1 then 'ann lee' when 2 then 'asa bo' else trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')) end as person from orders")
def exact_tokens(spark, sf):
    """Normalised texts with marks, ligatures and Roman numerals, and performers' names."""
    text = F.when(m() == 0, put("cafe\u0301's \ufb01ne \u2167 ", c())).when(m() == 1, "AnnLee ls").when(m() == 2, "\u00c5SA bo").otherwise(F.col("priority"))
    return orders(spark, sf).select("k", X.normalized(text).alias("norm"), X.performer_name(text).alias("person"))


@query("select o_orderkey as k, 'river ' || o_custkey as stem from orders")
def title_stems(spark, sf):
    """Titles without addresses, tags, braces, dates and decoration."""
    tail = F.when(m() == 0, " https://x.example/y?z").when(m() == 1, " #tag #b_c").when(m() == 2, " {new: x}").when(m() == 3, put(" ", F.col("day"))).when(m() == 4, " 24.03.05").when(m() == 5, " download watch").otherwise("!")
    return orders(spark, sf).select("k", X.title_stem(put("New River ", c(), tail)).alias("stem"))


@query("select o_orderkey as k, case o_orderkey % 10 when 0 then true when 1 then true when 2 then true when 3 then false when 4 then false else true end as fits, case when o_orderkey % 10 < 5 then 'abc-' || o_custkey else '' end as code from orders")
def title_codes(spark, sf):
    """Month-day codes within a day of the release, and a label's own codes."""
    date = F.to_date("day")
    code = lambda n: F.date_format(F.date_add(date, n), "MMdd")
    title = F.when(m() == 0, put("x ", code(0))).when(m() == 1, put("x ", code(1), " y")).when(m() == 2, put("1999 9999 ", code(-1))).when(m() == 3, put("x ", code(5))).when(m() == 4, put("x ", code(0))).otherwise("no code")
    release = F.when(m() != 4, F.col("day"))
    return orders(spark, sf).select("k", X.month_day_matches(title, release).alias("fits"), F.coalesce(X.configured_code(F.when(m() < 5, put("see ABC-", c(), " now")).otherwise("none"), F.lit("(?i)abc-[0-9]+")), F.lit("")).alias("code"))


@query("select o_orderkey as k, case o_orderkey % 10 when 0 then 'up' when 1 then 'id' || o_custkey else '' end as uploader, case o_orderkey % 10 when 0 then 'slug' when 1 then '' || o_custkey when 2 then 'Name' else '' end as grp, '&lt;' || o_custkey || '&gt;' as escaped, 'O' || case when o_orderkey % 2 = 0 then 'B' else '' end as initials, '[\"' || o_custkey || '\"]' as naming from orders")
def small_keys(spark, sf):
    """Uploaders and groups by their first field that is not empty; escaping, initials, naming versions."""
    none = F.lit(None).cast("string")
    up = linkage.uploader_name(F.when(m() == 0, "UP").otherwise(""), F.when(m() == 1, put("ID", c())), none)
    writer = F.struct(F.when(m() == 0, "slug").otherwise("").alias("slug"), F.when(m() < 2, c().cast("string")).alias("id"), F.when(m() < 3, "Name").otherwise("").alias("name"))
    rows = orders(spark, sf).withColumn("writer", writer)
    group = F.coalesce(admission.group_key("writer"), F.lit(""))
    return rows.select("k", up.alias("uploader"), group.alias("grp"), X.escape_html(put("<", c(), ">")).alias("escaped"), X.initials(F.when(k() % 2 == 0, "one blue thing").otherwise(" one")).alias("initials"), merge.naming_version(F.array(c().cast("string"))).alias("naming"))


@query("select o_orderkey as k, 'ann ' || o_custkey || ';bo;long river t' || o_orderkey || ';c' || o_orderkey || case when o_orderkey % 10 < 5 then ';Label' else '' end as keys from orders")
def search_keys(spark, sf):
    """Blocking keys of an item."""
    made = X.search_queries(put("The long river of Ann t", k()), F.array(put("Ann ", c()), F.lit("Bo ls"), F.lit("Cy")), put("c", k()), F.lit("Label"), m() >= 5)
    return orders(spark, sf).select("k", F.array_join(made, ";").alias("keys"))


# --- linkage

CANDIDATES = """c as (select o_orderkey k, o_custkey c, 'Some p' || o_custkey || ' clip ' || (o_orderkey % 7) title, cast(cast(floor(o_totalprice) as bigint) % 3600 + o_orderkey % 5 - 2 as double) dur, o_orderkey % 3 = 0 undated,
 case when o_orderkey % 3 <> 0 then date_trunc('day', o_orderdate) + to_days(cast(o_orderkey % 11 - 5 as integer)) end added, o_custkey % 50 views, 'u' || (o_orderkey % 3) by_user, 'https://x/' || o_orderkey url, o_orderkey % 13 = 0 bad from orders)"""
ITEMS = "i as (select o_orderkey k, o_custkey c, cast(floor(o_totalprice) as bigint) % 3600 dur, date_trunc('day', o_orderdate) rel from orders where cast(floor(o_totalprice) as bigint) % 3600 > 0)"
ORDER = "abs(cd - dur), undated, case when not undated then abs(epoch(added) - epoch(rel)) end nulls first, views desc, added nulls last, case when undated then url end nulls first, ck"


def items_and_candidates(spark, sf) -> tuple[DataFrame, DataFrame]:
    o = orders(spark, sf)
    seconds = F.col("price").cast("long") % 3600
    items = o.select(k().alias("item_id"), put("order ", k(), " nowhere").alias("title"), F.array(put("p", c()), F.lit("")).alias("performers"), seconds.alias("duration_sec"), F.col("day").alias("release_date"), put("p", c()).alias("search"))
    added = F.when(k() % 3 != 0, F.date_format(F.date_add(F.to_date("day"), (k() % 11 - 5).cast("int")), "yyyy-MM-dd"))
    cands = o.select(put("Some p", c(), " clip ", k() % 7).alias("cand_title"), F.when(k() % 13 == 0, "long").otherwise((seconds + k() % 5 - 2).cast("string")).alias("duration"), added.alias("added"), (c() % 50).alias("views"), put("https://x/", k()).alias("url"), put("U", k() % 3).alias("uploader"), k().alias("ordinal"), put("p", c()).alias("search"))
    return items, cands


def picked_sql(gate: str, more: str = "") -> str:
    return f"""
with {ITEMS}, {CANDIDATES}, acc as (select i.k, i.dur, rel, c.k ck, c.dur cd, title, undated, added, views, by_user, url from i join c on c.dur between i.dur - 2 and i.dur + 2 and not c.bad and {gate} {more}),
best as (select * from (select *, row_number() over (partition by k, title order by {ORDER}) r from acc) where r = 1),
sure as (select * from (select *, count(*) over (partition by k) n, min(by_user) over (partition by k) a, max(by_user) over (partition by k) b from best) where n = 1 or a = b)
select k, url from (select *, row_number() over (partition by k order by {ORDER}) place from sure) where place = 1"""


@query(picked_sql("i.c = c.c"))
def pick_match(spark, sf):
    """Linkage with its real gate, rank, stems and refusal: durations within two seconds, a performer's tokens in the title."""
    items, cands = items_and_candidates(spark, sf)
    return linkage.pick_match(items, cands, on=["search"]).select(F.col("item_id").alias("k"), "url")


@query(picked_sql("i.c = c.c and c.k % 10 < 4"))
def staged_pools(spark, sf):
    """Pools in turn: the first holds nothing, the second could not be retrieved, the third is of listed accounts."""
    items, cands = items_and_candidates(spark, sf)
    some = cands.where(F.col("ordinal") % 10 < 4).withColumn("uploader", F.lower("uploader"))
    accounts = spark.createDataFrame([("U0",), ("U1",), ("U2",)], "account string")
    pool = linkage.trusted_pool(some, accounts)
    found = linkage.match_in_stages(items, [(cands.limit(0), linkage.open_identity), (None, linkage.open_identity), (pool, linkage.open_identity)], on=["search"])
    return found.select(F.col("item_id").alias("k"), "url")


@query("select o_orderkey as k, o_orderkey % 10 in (0, 1, 2, 4) as trusted, o_orderkey % 10 in (0, 5, 6) as phrase, o_orderkey % 10 in (0, 4) as open from orders")
def identity_gates(spark, sf):
    """Gates for trusted pools (name, first name, first name with digits, and a code that fits), phrases and open pools."""
    code = F.date_format(F.to_date("day"), "MMdd")
    title = F.when(m() == 0, "x Annabel Lee y").when(m() == 1, put("annabel ", code)).when(m() == 2, "annabel999 z").when(m() == 3, put("annabel ", F.date_format(F.date_add(F.to_date("day"), 9), "MMdd"))).when(m() == 4, "lee, annabel").when(m() == 5, "about annabelLee now").when(m() == 6, put("q ", "ZZ", k(), " w")).otherwise("annabelle leeds")
    rows = orders(spark, sf).withColumns({"cand_title": title, "performers": F.array(F.when(m() == 5, F.lit("annabelLee")).otherwise(F.lit("Annabel Lee"))), "title": F.lit("no such title"), "release_date": F.col("day"), "code": put("zz", k())})
    s = linkage.Sides()
    return rows.select("k", (linkage.trusted_identity(s) & (m() != 5)).alias("trusted"), (linkage.phrase_identity(s, "code") & (m() != 4)).alias("phrase"), (linkage.open_identity(s) & (m() != 5)).alias("open"))


@query("select o_orderkey as k, case when o_orderkey % 10 < 3 then 'u1,u2' when o_orderkey % 10 < 6 then 'u1' else '' end as urls from orders where o_orderkey % 10 < 6")
def verified_copies(spark, sf):
    """Copies of the pick, each checked on its detail page: native ones first, two at most."""
    o = orders(spark, sf)
    items = o.select(k().alias("item_id"), F.lit("the long red river crossing").alias("title"), F.array(put("p", k())).alias("performers"), (k() * 10 + 100).alias("duration_sec"), F.col("day").alias("release_date"), k().alias("search"))
    cand = lambda n, external: o.select(put("p", k(), " film").alias("cand_title"), (k() * 10 + 100).alias("duration"), F.lit(None).cast("string").alias("added"), F.lit(0).alias("views"), put("u", F.lit(n), "-", k()).alias("url"), F.lit("").alias("uploader"), F.lit(n).alias("ordinal"), F.lit(external).alias("is_external"), k().alias("search"))
    detail = lambda n, good: o.select(put("u", F.lit(n), "-", k()).alias("url"), F.when(good, put("p", k(), " in the long red river crossing")).otherwise("nobody").alias("detail_title"))
    cands, details = cand(1, False).unionByName(cand(2, True)).unionByName(cand(3, True)), detail(1, m() < 6).unionByName(detail(2, m() < 3)).unionByName(detail(3, m() < 0))
    found = linkage.expand_and_verify(items, cands, details, on=["search"])
    return found.groupBy(F.col("item_id").alias("k")).agg(F.array_join(F.array_sort(F.collect_list(F.substring_index("url", "-", 1))), ",").alias("urls"))


# --- measurements


def near_date(days: int) -> linkage.Gate:
    """Added within days of the release."""
    return lambda s: F.abs(F.datediff(F.to_date(s.cand_added), F.to_date(s.release))) <= days


def long_views(s: linkage.Sides) -> Column:
    return F.col(s.cand_views) >= 40


JUDGED = """j as (select i.k, abs(c.dur - i.dur) off, abs(date_diff('day', i.rel, c.added)) <= 3 near, views >= 40 seen, c.k = i.k good from i join c on i.c = c.c and not c.bad and abs(c.dur - i.dur) <= 30)"""


@query(f"""
with {ITEMS}, {CANDIDATES}, {JUDGED},
f as (select 'any at 2' as rule, * from j where off <= 2 union all select 'dated at 2', * from j where off <= 2 and near union all select 'dated at 30', * from j where near union all select 'dated or seen at 2', * from j where off <= 2 and (near or seen) union all select 'none', * from j where false),
n as (select rule, count(*) a, count(*) filter (where good) t, count(distinct case when good then k end) l from f group by rule), r as (select unnest(['any at 2', 'dated at 2', 'dated at 30', 'dated or seen at 2', 'none']) as rule)
select rule, coalesce(a, 0) as accepts, coalesce(t, 0) as true_accepts, coalesce(a - t, 0) as false_accepts, coalesce(cast(floor(100 * t / a + 0.5) as integer), -1) as precision, coalesce(l, 0) as items_linked, (select count(*) from i) as items from r left join n using (rule)""")
def rule_report(spark, sf):
    """Accepts, precision and reach of match rules on pairs whose truth is known: a candidate is true if it is the item's own order."""
    items, cands = items_and_candidates(spark, sf)
    truth = cands.select(F.col("ordinal").alias("item_id"), "url")
    rules_ = [quality.MatchRule("any at 2", 2, (linkage.open_identity,)), quality.MatchRule("dated at 2", 2, (near_date(3),)), quality.MatchRule("dated at 30", 30, (near_date(3),)), quality.MatchRule("dated or seen at 2", 2, (near_date(3), long_views)), quality.MatchRule("none", 2, (lambda s: F.lit(False),))]
    return quality.rule_report(items, cands, truth, rules_, on=["search"]).na.fill(-1, ["precision"])


@query(f"""
with {ITEMS}, {CANDIDATES}, {JUDGED}, d as (select * from j where off <= 5)
select 'dated' as test, count(*) filter (where near) as fires, count(*) filter (where near and good) as true_fires, count(*) filter (where near and good and not seen) as only_true, count(*) filter (where near and not good and not seen) as only_false from (select coalesce(near, false) near, seen, good from d)
union all select 'seen', count(*) filter (where seen), count(*) filter (where seen and good), count(*) filter (where seen and good and not near), count(*) filter (where seen and not good and not near) from (select coalesce(near, false) near, seen, good from d)""")
def disjunct_report(spark, sf):
    """What each test of a disjunction brings that no other does."""
    items, cands = items_and_candidates(spark, sf)
    return quality.disjunct_report(items, cands, cands.select(F.col("ordinal").alias("item_id"), "url"), {"dated": near_date(3), "seen": long_views}, 5, on=["search"])


@query("""
select coalesce('l' || (k % 4), 'all') as label, count(*) as items, count(*) filter (where m < 7) as with_duration, count(*) filter (where m in (0, 1)) as by_primary, count(*) filter (where m in (1, 2)) as by_secondary, count(*) filter (where m < 3) as linked,
 cast(floor(100 * count(*) filter (where m < 3) / count(*) + 0.5) as integer) as percent from (select o_orderkey k, o_orderkey % 10 m from orders) group by rollup ('l' || (k % 4))""")
def link_coverage(spark, sf):
    """How many items of each label, and of all, have a live link of each source, of any, and a duration."""
    one, two = link("primary", put("a", k())), link("secondary", put("b", k()))
    links = F.when(m() == 0, F.array(one)).when(m() == 1, F.array(one, two)).when(m() == 2, F.array(two))
    items = conformed(orders(spark, sf).select(put("l", k() % 4).alias("label_id"), links.alias("links"), F.when(m() < 7, 60).when(m() == 7, 0).alias("duration_sec")))
    return quality.coverage(items, ["primary", "secondary"]).withColumnRenamed("label_id", "label").withColumn("label", F.coalesce("label", F.lit("all")))


# --- unions, orders, carry-over


@query("select l_partkey as k, arg_max(l_orderkey, (l_orderkey, l_linenumber)) as last_order, min(l_orderkey) as first_order from lineitem group by l_partkey")
def union_last_first(spark, sf):
    """Of each key the last value at the place of the first."""
    rows = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), "l_orderkey", "l_linenumber")
    return keyed.union_per_key(rows, "k", ["l_orderkey", "l_linenumber"]).select("k", F.col("l_orderkey").alias("last_order"), F.col("place.l_orderkey").alias("first_order"))


@query("select o_orderkey as k, case o_orderkey % 10 when 0 then '' when 1 then 'a,c' else 'a,b,c' end as urls, case when o_orderkey % 10 = 0 then '' else 'a' end as top from orders")
def link_unions(spark, sf):
    """Links and older ones without dead and repeated ones, and the preferred of them."""
    one = lambda s, u: link(s, F.lit(u))
    o = orders(spark, sf).withColumns({"links": F.when(m() > 0, F.array(one("secondary", "b"), one("primary", "a"), one("primary", "a"))), "legacy": F.when(m() > 0, F.array(one("primary", "c"), one("secondary", "b"))), "dead": F.when(m() == 1, F.array(dead_link("secondary", F.lit("b"))))})
    made = o.withColumn("all", keyed.union_links(F.col("links"), F.col("legacy"), F.col("dead")))
    shown = F.array_join(F.array_sort(F.transform("all", lambda x: x["url"])), ",")
    return made.select("k", F.coalesce(shown, F.lit("")).alias("urls"), F.coalesce(keyed.preferred_link(F.col("all"), ["primary", "secondary"])["url"], F.lit("")).alias("top"))


@query(f"select o_orderkey as k, case when o_orderkey % 10 in (0, 1) then 'to ' || o_orderkey else 't' || o_orderkey end as title, o_orderkey % 10 in (0, 1) as translated from orders")
def carried_translations(spark, sf):
    """Translated titles carried over by id, or by the original title where the id has changed."""
    o = orders(spark, sf)
    items = conformed(o.select(k().cast("string").alias("id"), put("t", k()).alias("title")))
    prior = conformed(o.where(m() < 3).select(F.when(m() == 1, put("old", k())).otherwise(k().cast("string")).alias("id"), put("to ", k()).alias("title"), F.when(m() == 2, "other").otherwise(put("t", k())).alias("original_title"), (F.lit(True)).alias("title_translated"), k().alias("ordinal")))
    out = merge.carry_translations(items, prior)
    return out.select(F.col("id").cast("long").alias("k"), "title", F.coalesce("title_translated", F.lit(False)).alias("translated"))


@query("select o_orderkey as k, case o_orderkey % 10 when 0 then 'Female' when 1 then 'Male' when 2 then 'Other' else 'Unknown' end as gender from orders")
def genders(spark, sf):
    """A performer's gender from the record, else by id, else by name; of several the last."""
    o = orders(spark, sf)
    none = F.lit(None).cast("string")
    people = o.select("k", k().alias("performer_id"), put("N", k()).alias("name"))
    inline = o.where(m() == 0).select(k().alias("performer_id"), F.lit("Female").alias("gender"), F.lit(1).alias("ordinal")).unionByName(o.where(m() == 0).select(k().alias("performer_id"), F.lit("Male").alias("gender"), F.lit(0).alias("ordinal")))
    by_id = o.where(m() < 2).select(k().alias("performer_id"), F.lit("Male").alias("gender"), F.lit(1).alias("ordinal"))
    by_name = o.where(m() == 2).select(F.upper(put("n", k())).alias("name"), F.lit("Other").alias("gender"), F.lit(1).alias("ordinal"))
    return extract.resolve_gender(people, inline.withColumn("x", none).drop("x"), by_id, by_name).select("k", "gender")


@query("select row_number() over (order by case when n_nationkey % 5 = 0 then 0 else 1 end, case when n_nationkey % 5 = 0 then 100 - n_nationkey end nulls last, n_name) as place, n_name from nation")
def status_places(spark, sf):
    """Sources in their registered order, then labels by name: 25 rows, numbered as they come."""
    key = F.col("n_nationkey")
    rows = read(spark, sf, "nation").select(F.when(key % 5 == 0, "source").otherwise("label").alias("kind"), F.when(key % 5 == 0, 100 - key).alias("ordinal"), F.col("n_name").alias("name"))
    listed = [(i, r["name"]) for i, r in enumerate(queues.status_order(rows).collect(), 1)]  # as many as there are sources and labels
    return spark.createDataFrame(listed, "place long, n_name string")


# --- state


def two_states(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Items and their predecessors: same (0-3), moved to another id (4), retitled (5), never matched (6), new (7-9)."""
    o = orders(spark, sf)
    url = put("https://r/", k())
    items = conformed(o.select(k().cast("string").alias("id"), F.when(m() == 5, "another title of four words").otherwise("one title of four words").alias("title"), F.col("day").alias("release_date"), F.array(put("p", c())).alias("performers"), url.alias("release_url"), F.lit("l").alias("label_id"), (m() != 6).alias("matching"), k().alias("ordinal")))
    links = F.array(link("primary", put("a", k())), link("secondary", put("b", k())))
    prior = conformed(o.where(m() < 7).select(F.when(m() == 4, put("x", k())).otherwise(k().cast("string")).alias("id"), F.lit("one title of four words").alias("title"), F.col("day").alias("release_date"), F.array(put("p", c())).alias("performers"), url.alias("release_url"), F.lit("l").alias("label_id"), links.alias("links"), F.when(m() == 1, F.array(dead_link("primary", put("a", k())))).alias("dead_links"), F.when(m() == 2, F.array(put("c", k()))).alias("legacy_urls"), F.when(m() == 3, "2001-07-31T12:00:00Z").otherwise("2001-07-01T00:00:00Z").alias("checked_at"), k().alias("ordinal")))
    return items, prior


@query("""select k, case m when 0 then 'a' || k || ',b' || k when 1 then 'b' || k when 2 then 'a' || k || ',b' || k || ',c' || k when 3 then 'a' || k || ',b' || k when 4 then 'a' || k || ',b' || k when 6 then 'a' || k || ',b' || k when 9 then 'given' else '' end as urls,
 m = 1 as has_dead, not (m in (6, 9)) and not (m = 3) and d >= timestamp '2001-08-01' - interval 14 day as due from (select o_orderkey k, o_orderkey % 10 m, date_trunc('day', o_orderdate) d from orders)""")
def merged_state(spark, sf):
    """The merge of fresh rows with their predecessors: links, older links, dead links, overrides, and who needs a lookup."""
    items, prior = two_states(spark, sf)
    overrides = items.where(F.col("id").cast("long") % 10 == 9).select("id", F.array(link("primary", F.lit("given"))).alias("links"))
    out = merge.merge_state(items, prior, NOW, overrides)
    return out.select(F.col("id").cast("long").alias("k"), urls("links").alias("urls"), (F.coalesce(F.size("dead_links"), F.lit(0)) > 0).alias("has_dead"), F.col("needs_lookup").alias("due"))


@query("select o_orderkey as k, case when o_orderkey % 10 in (0, 1) then 'n' || o_orderkey || ',s' when o_orderkey % 10 = 2 then 's' else 's' end as urls, o_orderkey % 10 < 5 as checked from orders")
def applied_lookup(spark, sf):
    """Found links put before those of other sources, dead ones left out; rows that were due are marked as checked."""
    o = orders(spark, sf)
    rows = conformed(o.select(k().cast("string").alias("id"), F.array(link("secondary", F.lit("s"))).alias("links"), F.when(m() == 2, F.array(dead_link("primary", put("n", k())))).alias("dead_links"))).withColumn("needs_lookup", F.col("id").cast("long") % 10 < 5)
    found = o.where(m() < 3).select(k().cast("string").alias("id"), put("n", k()).alias("url"), F.lit(1).alias("place")).unionByName(o.where(m() == 7).select(k().cast("string").alias("id"), F.lit("late").alias("url"), F.lit(1).alias("place")))
    out = merge.apply_lookup(rows, found, NOW, "primary")
    return out.select(F.col("id").cast("long").alias("k"), urls("links").alias("urls"), F.col("checked_at").isNotNull().alias("checked"))


@query("""select o_orderkey as k, case o_orderkey % 10 when 1 then 'b' || o_orderkey when 3 then 'b' || o_orderkey else 'a' || o_orderkey || ',b' || o_orderkey end as live, case when o_orderkey % 10 in (1, 3) then 'a' || o_orderkey else '' end as dead,
 case o_orderkey % 10 when 2 then 1 when 0 then -1 when 4 then 1 else -1 end as strikes, case o_orderkey % 10 when 1 then 'HTTP 404' when 3 then 'Link not found' else '' end as reason from orders""")
def link_outcomes(spark, sf):
    """Outcomes applied to links: live clears failures, dead counts one, the second moves the link to the dead ones."""
    o = orders(spark, sf)
    failures = F.when(m().isin(0, 1, 3, 4), 1)
    items = conformed(o.select(k().cast("string").alias("id"), F.array(link("primary", put("a", k()), F.lit("2001-01-01"), failures), link("secondary", put("b", k()))).alias("links"), F.lit("2001-07-01").alias("checked_at")))
    status = F.when(m() == 0, "live").when(m().isin(1, 2, 3), "dead").otherwise("inconclusive")
    outcomes = o.select(k().cast("string").alias("id"), put("a", k()).alias("url"), status.alias("status"), F.when(m() == 1, "HTTP 404").alias("reason"))
    out = lifecycle.apply_outcomes(items, outcomes, NOW)
    first = F.get(F.filter("links", lambda x: x["source"] == "primary"), F.lit(0))
    return out.select(F.col("id").cast("long").alias("k"), urls("links").alias("live"), urls("dead_links").alias("dead"), F.coalesce(first["failures"], F.lit(-1)).alias("strikes"), F.coalesce(F.get("dead_links", F.lit(0))["dead_reason"], F.lit("")).alias("reason"))


@query("select o_orderkey as k, 'a' || o_orderkey as url from orders where o_orderkey % 10 < 5 order by case when o_orderkey % 10 = 0 then null else o_orderdate end nulls first, o_orderkey limit 25")
def stalest_links(spark, sf):
    """The valid links that were verified longest ago, never verified ones first: 25, as the job takes."""
    url = F.when(m() < 5, put("https://a.example/post/a", k(), ".html")).otherwise("http://bad")
    items = orders(spark, sf).select(k().cast("long").alias("id"), F.array(link("primary", url, F.when(m() != 0, F.col("day")))).alias("links"))
    return lifecycle.stalest_links(items, KINDS).select(F.col("id").alias("k"), F.regexp_extract("link.url", "post/(a[0-9]+)", 1).alias("url"))


@query("select o_orderkey as k, 's:' || o_orderkey as id, case when o_orderkey % 10 < 5 then 'own' else 'S' end as label from orders where o_orderkey % 2 = 0")
def retained_rows(spark, sf):
    """The last good rows of a source that failed, with ids and labels filled in."""
    prior = conformed(orders(spark, sf).select(F.when(m() < 4, k().cast("string")).alias("source_item_id"), put("s:", k()).alias("id"), F.when(k() % 2 == 0, "s").otherwise("s2").alias("source_id"), F.when(m() < 5, "own").alias("label"), k().alias("ordinal")))
    return merge.retained(prior, "s", "S").select(F.col("ordinal").alias("k"), "id", "label")


@query("select o_orderkey as k from orders where o_orderkey % 10 in (1, 2, 3)")
def changed_rows(spark, sf):
    """Rows that differ, appear or vanish between two states."""
    o = orders(spark, sf).select("k", "day", F.when(m() == 1, "x").alias("v"))
    before, after = o.where(k() % 10 != 2), orders(spark, sf).select("k", "day", F.lit(None).cast("string").alias("v")).where(k() % 10 != 3)
    return merge.changed(before, after, "k").select(F.col("k"))


# --- translation


@query("""select p_name as original, any_value(case when p_size % 4 = 0 and p_partkey is not null then p_name else p_name end) as kept, case when contains(p_name, 'green') then 'external' when contains(p_name, 'red') then 'cached' else 'none' end as provider from part group by p_name""")
def translated_titles(spark, sf):
    """Distinct titles: from the cache, as they are without Han or kana, and by a translator that some reach."""
    names = read(spark, sf, "part").select(F.col("p_name").alias("name"))
    mark = F.when(F.contains("name", F.lit("green")), put("\u5b57", F.col("name"))).otherwise(F.col("name"))
    titles = names.select(mark.alias("original"))
    cache = names.where(F.contains("name", F.lit("red")) & ~F.contains("name", F.lit("green"))).distinct().select(F.col("name").alias("original"), F.col("name").alias("title"), F.lit("cached").alias("provider"), F.lit(True).alias("translated"))
    made = translate.translate_titles(titles, cache, [], lambda xs: {x: x.lstrip("\u5b57") for x in xs})
    own = F.regexp_replace("original", "^\u5b57", "")
    return made.select(own.alias("original"), F.regexp_replace("title", "^\u5b57", "").alias("kept"), "provider")


@query("select o_orderkey as k, case when o_orderkey % 10 < 3 then 'to ' || o_orderkey else 'o' || o_orderkey end as title, case when o_orderkey % 10 < 5 then 'Press' else 'L' || (o_orderkey % 10) end as label from orders")
def applied_translations(spark, sf):
    """Translations put into titles, and renamed labels into rows."""
    o = orders(spark, sf)
    items = conformed(o.select(k().cast("string").alias("id"), put("o", k()).alias("title"), put("L", m()).alias("label"), put("l", m()).alias("label_id")))
    made = o.where(m() < 4).select(put("o", k()).alias("original"), put("to ", k()).alias("title"), F.lit("glossary").alias("provider"), (m() < 3).alias("translated"))
    status = conformed(o.select(put("l", m()).alias("label_id"), F.when(m() < 5, "\u5b57\u793e").otherwise(put("L", m())).alias("name")).distinct(), STATUS)
    names = translate.named_labels(status, lambda asked: dict.fromkeys(asked, " Press "))
    out, _ = translate.rename_labels(translate.apply_translations(items, made), status, names)
    return out.select(F.col("id").cast("long").alias("k"), "title", "label")


# --- jobs


def source_of(rows: DataFrame, name: str) -> specs.SourceSpec:
    return specs.SourceSpec(name, name.upper(), specs.Authority(name, f"https://{name}.example"), lambda spark, path: rows)


@query(f"""
with o as (select o_orderkey k, o_orderkey % 10 m, o_custkey c, {OWN_DAY} as day from orders where o_orderdate between timestamp '2001-08-01' - interval 90 day and timestamp '2001-08-01')
select 'a:' || k as id, day, case when m = 0 then 'due' else 'due' end as state from o where m < 5 and c % 5 <> 0""")
def refreshed(spark, sf):
    """A whole refresh: two sources, one of which fails, the window, the screen, the merge and the snapshot."""
    root = scratch(spark, "catalogue")
    rows = orders(spark, sf).where(m() < 5).select(k().alias("source_item_id"), F.when(c() % 5 == 0, "bad #5").otherwise("fine").alias("title"), F.col("day").alias("release_date"), F.array(put("p", c())).alias("performers"), F.lit(60).alias("duration_sec"))
    jobs.refresh(spark, root, [source_of(rows, "a"), source_of(rows.limit(0), "b")], lambda s: "", NOW, SCREEN)
    items, _, _ = store.read_catalogue(spark, root)
    return items.select("id", F.col("release_date").alias("day"), F.lit("due").alias("state"))


@query(f"select 'a:' || o_orderkey as id, case when o_orderkey % 10 in (0, 1) then 'https://a.example/post/' || o_orderkey || '.html' else '' end as urls, o_orderdate >= timestamp '2001-08-01' - interval 14 day as checked from orders where o_orderdate between timestamp '2001-08-01' - interval 90 day and timestamp '2001-08-01' and (o_orderkey % 10 > 1 or o_orderdate >= timestamp '2001-08-01' - interval 14 day)")
def linked_catalogue(spark, sf):
    """Verification and linkage over a stored catalogue: items of the last fourteen days get the links of a pool."""
    root = scratch(spark, "catalogue")
    recent = orders(spark, sf).where(F.to_timestamp("day") >= F.lit(NOW) - F.expr("interval 14 day"))
    rows = orders(spark, sf).where((m() > 1) | (F.to_timestamp("day") >= F.lit(NOW) - F.expr("interval 14 day"))).select(k().alias("source_item_id"), put("title ", k()).alias("title"), F.col("day").alias("release_date"), F.array(put("p", k())).alias("performers"), F.lit(60).alias("duration_sec"))
    jobs.refresh(spark, root, [source_of(rows, "a")], lambda s: "", NOW, SCREEN)
    cands = recent.where(m() < 2).select(put("p", k(), " film").alias("cand_title"), F.lit("61").alias("duration"), F.lit(None).cast("string").alias("added"), F.lit(1).alias("views"), put("https://a.example/post/", k(), ".html").alias("url"), F.lit("u").alias("uploader"), k().alias("cand_ordinal"))
    nothing = spark.createDataFrame([], "id string, url string, status string, reason string")
    jobs.enrich_links(spark, root, KINDS, nothing, [jobs.Pool("primary", None, linkage.open_identity), jobs.Pool("primary", cands, linkage.open_identity)], NOW)
    items, _, _ = store.read_catalogue(spark, root)
    return items.select("id", urls("links").alias("urls"), F.col("checked_at").isNotNull().alias("checked"))


@query("select o_orderkey as item_id, 'A' || case when o_orderkey % 3 = 0 then 'B' else '' end as tags, o_orderkey % 10 = 5 as is_pending, coalesce(case when o_orderkey % 2 = 0 then 'clear' end, '') as badge from orders where o_orderkey % 10 between 4 and 6 order by o_orderkey % 10 = 5, o_orderdate desc, o_orderkey limit 60")
def crawled(spark, sf):
    """A crawl from its walks, its queue and its details; error rows apart. The budget of 60 is the job's own."""
    o = orders(spark, sf)
    walk = lambda rows, tag, seq: rows.select(k().alias("item_id"), F.col("day").alias("release_date"), F.lit(tag).alias("tag"), F.lit(seq).alias("seq"))
    some = o.where((m() >= 4) & (m() <= 6))
    walks = walk(some, "A", 1).unionByName(walk(some.where(k() % 3 == 0), "B", 2)).unionByName(walk(some, "A", 3))
    keys = lambda rows: rows.select(k().alias("item_id"))
    details = o.where(k() % 2 == 0).select(k().alias("item_id"), F.lit("clear").alias("badge"), F.lit(None).cast("string").alias("_error"), F.lit(1).alias("fetched"))
    items, _ = jobs.crawl(walks, keys(o.where(m() < 4)), keys(o.where(m() == 5)), details, 60)
    return items.select("item_id", F.array_join("source_tags", "").alias("tags"), "is_pending", F.coalesce("badge", F.lit("")).alias("badge"))


@query("select 'x' as side, count(*) as n from orders where o_orderkey % 10 >= 5 union all select 'lane', count(*) from orders where o_orderkey % 10 < 3")
def backfilled(spark, sf):
    """One lane replaced by its whole history, the other rows kept."""
    root = scratch(spark, "catalogue")
    o = orders(spark, sf)
    prior = conformed(o.where(m() >= 3).select(k().cast("string").alias("id"), F.when(m() < 5, "lane").otherwise("x").alias("source_id"), F.col("priority").alias("title")))
    store.write_catalogue(spark, root, prior, spark.createDataFrame([], STATUS), "now", None)
    lane = specs.SourceSpec("lane", "Lane", specs.Authority("lane", "https://lane.example"), lambda sp, path: o.where(m() < 3).select(k().alias("source_item_id"), F.col("priority").alias("title"), F.col("day").alias("release_date")), matching=False)
    jobs.backfill(spark, root, lane, "", NOW, SCREEN)
    return store.read_catalogue(spark, root)[0].groupBy(F.col("source_id").alias("side")).agg(F.count("*").alias("n"))


# --- streams


def events(spark, sf) -> DataFrame:
    schema = read(spark, sf, "events").schema
    return incremental.landed(spark, f"{sf}/events*.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2")
def streamed_counts(spark, sf):
    """Rows by day and type, from a stream that has run to its end."""
    out = incremental.drained(incremental.counted(events(spark, sf), "ts", "event_type"), scratch(spark, "counts"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("select distinct user_id, event_type from events")
def streamed_unseen(spark, sf):
    """Each user and type once, however late: the watermark lags by more than the table covers."""
    out = incremental.drained(incremental.unseen(events(spark, sf), ["user_id", "event_type"], "ts", "400 days"), scratch(spark, "unseen"))
    return out.select("user_id", "event_type")


@query("""
with e as (select user_id, event_id, ts, case event_type when 'view' then 'live' when 'error' then 'dead' end s from events), k as (select * from e where s is not null),
i as (select *, sum(case when s = 'live' then 1 else 0 end) over (partition by user_id order by ts, event_id) island from k), g as (select user_id, island, count(*) filter (where s = 'dead') f, count(*) n from i group by user_id, island)
select cast(user_id as varchar) as key, cast(arg_max(f % 2, island) as integer) as strikes, cast(sum(f // 2) as bigint) as deaths, cast(sum(n) as bigint) as outcomes from g group by user_id""")
def streamed_strikes(spark, sf):
    """The strike counter over a stream of outcomes."""
    status = F.when(F.col("event_type") == "view", "live").when(F.col("event_type") == "error", "dead").otherwise("other")
    out = incremental.drained(incremental.strike_counter(events(spark, sf).withColumn("status", status), "user_id", "status", "ts"), scratch(spark, "strikes"), "update")
    last = out.groupBy("key").agg(F.max_by(F.struct("strikes", "deaths", "outcomes"), F.struct("outcomes", "__batch")).alias("x"))
    return last.select("key", "x.*").where("outcomes > 0")


@query("""
with e as (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts) as gap from events), s as (select user_id, ts, sum(case when gap is null or gap > interval 6 hours then 1 else 0 end) over (partition by user_id order by ts) as session from e)
select user_id, epoch_us(min(ts)) as start_us, count(*) as n from s group by user_id, session""")
def streamed_sessions(spark, sf):
    """Sessions of users with six hours of silence between them, from a stream that has run to its end."""
    out = incremental.drained(incremental.sessions(events(spark, sf), "ts", "user_id", "6 hours"), scratch(spark, "sessions"), "complete")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("""
with recursive e as (select cast(user_id as varchar) as key, ts, event_type = 'error' as waits, row_number() over (partition by user_id order by ts, event_type) as r from events where event_type in ('error', 'view')),
w as (select key, r, case when waits then ts end as since, null::timestamp as over, '' as how, waits as began from e where r = 1
 union all select e.key, e.r, case when e.waits then case when w.since is null or e.ts >= w.since + interval 7 days then e.ts else w.since end end,
  case when w.since is not null and (e.ts >= w.since + interval 7 days or not e.waits) then w.since end, case when w.since is null then '' when e.ts >= w.since + interval 7 days then 'expired' when not e.waits then 'resolved' else '' end,
  e.waits and (w.since is null or e.ts >= w.since + interval 7 days) from w join e on e.key = w.key and e.r = w.r + 1),
ends as (select key, since from (select *, row_number() over (partition by key order by r desc) z from w) where z = 1 and since + interval 7 days < (select max(ts) - interval 1 hour from events where event_type in ('error', 'view')))
select key, 'waiting' as state, epoch_us(since) as since_us from w where began union all select key, how, epoch_us(over) from w where how <> '' union all select key, 'expired', epoch_us(since) from ends""")
def streamed_waits(spark, sf):
    """Waits of seven days at most: an error begins one, a view resolves it; those that last end at the stream's own time."""
    rows = events(spark, sf).where("event_type in ('error', 'view')").withColumn("state", F.when(F.col("event_type") == "error", "pending").otherwise("clear"))
    out = incremental.drained(incremental.pending_queue(rows, "user_id", "state", "ts"), scratch(spark, "waits"))
    return out.select("key", "state", F.unix_micros("since").alias("since_us"))
