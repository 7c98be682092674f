"""Extraction from landed JSON and HTML. Built-in expressions, but for linked data, whose nesting has no fixed depth."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions import text as X
from rollbook.functions.text import text_of

# Types of linked-data entities that describe a video, and where their fields stand.
VIDEO_TYPES = {"videoobject", "mediaobject", "movie", "tvepisode", "clip"}
DATE_FIELDS = ("datePublished", "uploadDate", "releaseDate")
PEOPLE_FIELDS = ("actor", "actors", "performer", "performers", "author")
LINKED_DATA = r"(?is)<script\b[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
META_KEYS = {"duration": "duration", "date": "datepublished|release_date|published_time|uploaddate", "performers": "actor|performer|starring"}


@dataclass(frozen=True)
class Recipe:
    """Patterns, with one group, for the pages of a host."""

    host: str
    duration: str | None = None
    performers: str | None = None


def meta_tags(html: Column | str) -> Column:
    """Array of attribute maps of a page's meta tags, in order."""
    return F.transform(F.regexp_extract_all(text_of(html), F.lit(r"(?is)<meta(?![A-Za-z0-9_])[^>]*>"), F.lit(0)), X.attributes)


def meta_value(tags: Column, keys: str) -> Column:
    """Content of the first meta tag whose property, name or itemprop holds one of keys and that has any."""
    some = lambda m, *ks: F.coalesce(*(F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in ks), F.lit(""))
    fit = F.filter(tags, lambda m: F.lower(some(m, "property", "name", "itemprop")).rlike(f"(?:{keys})") & (some(m, "content", "value") != ""))
    return F.get(F.transform(F.slice(fit, 1, 1), lambda m: some(m, "content", "value")), F.lit(0))


def people(value) -> list[str]:
    out: list[str] = []
    for x in value if isinstance(value, list) else [value]:
        if isinstance(x, str):
            out += re.split(r",|\s+(?:and|&)\s+", x, flags=re.I)
        elif isinstance(x, dict) and x.get("name"):
            out.append(str(x["name"]))
    clean = [re.sub("&quot;", '"', re.sub("&#(?:39|x27);", "'", re.sub("&amp;", "&", x, flags=re.I), flags=re.I), flags=re.I).strip() for x in out]
    return list(dict.fromkeys(x for x in clean if x))


def entities(node):
    """Video entities of a linked-data value, depth first; an explicit stack, so that depth is no limit."""
    stack = [node]
    while stack:
        at = stack.pop()
        if isinstance(at, list):
            stack += reversed(at)
        elif isinstance(at, dict):
            types = at.get("@type")
            if any(str(t or "").lower() in VIDEO_TYPES for t in (types if isinstance(types, list) else [types])):
                yield at
            stack += [v for v in reversed(list(at.values())) if isinstance(v, (dict, list))]


LD = T.StructType([T.StructField("duration", T.StringType()), T.StructField("date", T.StringType()), T.StructField("performers", T.ArrayType(T.StringType()))])


@F.pandas_udf(LD)
def linked_data(blocks: pd.Series) -> pd.DataFrame:
    """Duration (as text), date and performers of the video entities in a page's blocks; malformed blocks count as absent."""
    rows = []
    for own in blocks:
        got = {"duration": None, "date": None, "performers": None}
        for block in own if own is not None else []:
            try:
                value = json.loads(block.strip())
            except (ValueError, RecursionError):
                continue
            for e in entities(value):
                got["duration"] = got["duration"] or (str(e["duration"]) if e.get("duration") else None)
                got["date"] = got["date"] or next((str(e[f]) for f in DATE_FIELDS if e.get(f)), None)
                got["performers"] = got["performers"] or people(next((e[f] for f in PEOPLE_FIELDS if e.get(f)), None)) or None
        rows.append(got)
    return pd.DataFrame(rows, columns=["duration", "date", "performers"])


def extract_metadata(pages: DataFrame, html: str = "html", url: str = "url", recipes: tuple[Recipe, ...] = ()) -> DataFrame:
    """pages with duration_sec, release_date (10 characters) and performers.

    For each field: linked data, else meta tags, else the host's recipe, else null. An empty list of performers is null.
    """
    page = text_of(html)
    tags = meta_tags(html)
    host = F.lower(F.coalesce(F.try_parse_url(text_of(url), F.lit("HOST")), F.lit("")))
    by_recipe = {"duration": F.lit(None).cast("string"), "performers": F.lit(None).cast("string")}
    for r in recipes:
        for f in by_recipe:
            if getattr(r, f):
                by_recipe[f] = F.when(host == r.host, F.nullif(F.regexp_extract(page, getattr(r, f), 1), F.lit(""))).otherwise(by_recipe[f])
    full = lambda a: F.when(F.size(a) > 0, a)
    told = X.bound(tags, lambda every: F.struct(*(meta_value(every, keys).alias(f) for f, keys in META_KEYS.items())))  # once for all fields
    out = pages.withColumn("__ld", linked_data(F.regexp_extract_all(page, F.lit(LINKED_DATA), F.lit(1)))).withColumn("__meta", told)
    seconds = lambda text: X.bound(text, lambda t: X.bound(X.parse_duration(t), lambda d: F.when(d != 0, d)))
    listed = lambda text: X.bound(X.names(text), full)
    return out.withColumns(
        {
            "duration_sec": F.coalesce(seconds(F.col("__ld.duration")), seconds(F.col("__meta.duration")), seconds(by_recipe["duration"])),
            "release_date": F.left(F.coalesce(F.nullif(F.col("__ld.date"), F.lit("")), F.col("__meta.date")), F.lit(10)),
            "performers": F.coalesce(full(F.col("__ld.performers")), listed(F.col("__meta.performers")), listed(by_recipe["performers"])),
        }
    ).drop("__ld", "__meta")


def enrich_from_pages(items: DataFrame, pages: DataFrame, refresh: bool = False) -> DataFrame:
    """Items whose missing fields (with refresh: all fields) come from their page's extract, with field_provenance.

    pages: release_url, duration_sec, release_date, performers, page_status. A page that is absent or failed marks the
    row as metadata_poor if it is still incomplete.
    """
    got = pages.groupBy("release_url").agg(F.max_by(F.struct("duration_sec", "release_date", "performers", "page_status"), F.struct("page_status")).alias("__page"))
    joined = items.join(got, "release_url", "left")
    fields = ("duration_sec", "release_date", "performers")
    missing = lambda f: {"duration_sec": F.coalesce(F.col(f), F.lit(0)) == 0, "release_date": F.coalesce(F.col(f).cast("string"), F.lit("")) == "", "performers": F.coalesce(F.size(f), F.lit(0)) <= 0}[f] if f else None
    takes = {f: F.col(f"__page.{f}").isNotNull() & (F.lit(refresh) | missing(f)) for f in fields}
    origin = F.map_from_entries(F.filter(F.array(*(F.when(takes[f], F.struct(F.lit(f).alias("k"), F.lit("page").alias("v"))) for f in fields)), lambda x: x.isNotNull()))
    marked = joined.withColumn("__origin", origin).withColumns({f"__new_{f}": F.when(takes[f], F.col(f"__page.{f}")).otherwise(F.col(f)) for f in fields})
    out = marked.withColumns({f: F.col(f"__new_{f}") for f in fields})
    before = F.coalesce(F.map_filter("field_provenance", lambda k, v: ~F.map_contains_key(F.col("__origin"), k)), F.create_map().cast("map<string,string>"))
    poor = missing("duration_sec") | missing("release_date") | missing("performers")
    return out.withColumns({"field_provenance": F.when((F.size("__origin") > 0) | F.col("field_provenance").isNotNull(), F.map_concat(before, "__origin")), "page_status": F.coalesce("__page.page_status", "page_status"), "metadata_poor": poor}).select(*items.columns)


def embedded_json(html: Column | str, marker: str) -> Column:
    """The value of an attribute that holds escaped JSON, decoded; null if the page has none."""
    return F.nullif(X.decode_named_entities(F.regexp_extract(text_of(html), rf"(?is){marker}=[\"']([^\"']*)[\"']", 1)), F.lit(""))


def parsed(value: Column, schema: str) -> Column:
    """from_json into schema; null for text that is no such JSON."""
    return F.from_json(value, schema)


def json_props(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """df with typed fields of a JSON text column; null where the text or the field is not so."""
    return df.withColumns({n: F.expr(f"try_variant_get(try_parse_json({column}), '$.{n}', '{t}')") for n, t in fields.items()})


def cards(html: Column | str, marker: str) -> Column:
    """The parts of a listing page after each marker."""
    return F.slice(F.split(text_of(html), marker), 2, 1_000_000)


def parse_listing(pages: DataFrame, marker: str, fields: dict[str, str], html: str = "html") -> DataFrame:
    """A row for each card of a page: its place and the first group of each field's pattern, cleaned, null if empty."""
    rows = pages.select(*(c for c in pages.columns if c != html), F.posexplode(cards(html, marker)).alias("card_ord", "__card"))
    return rows.select(*(c for c in rows.columns if c != "__card"), *(F.nullif(X.clean_text(F.regexp_extract("__card", p, 1)), F.lit("")).alias(n) for n, p in fields.items()))


def worded_date(value: Column | str) -> Column:
    """"March 5, 2024" as yyyy-MM-dd; null for anything else."""
    return F.date_format(F.try_to_date(F.trim(text_of(value)), "MMMM d, yyyy") if hasattr(F, "try_to_date") else F.try_to_timestamp(F.trim(text_of(value)), F.lit("MMMM d, yyyy")), "yyyy-MM-dd")


def html_links(html: Column | str) -> Column:
    """Addresses of a page's links, in order."""
    return F.regexp_extract_all(text_of(html), F.lit(r"(?i)<a\b[^>]*?href=[\"']([^\"']*)[\"']"), F.lit(1))


def page_title(html: Column | str, decoded: Callable[[Column], Column] = X.clean_text) -> Column:
    """Text of a page's first title; decoded tells which entities are read."""
    return decoded(F.regexp_extract(text_of(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_charset(html: Column | str) -> Column:
    """What the first meta tag that declares one has behind charset=, quoted or not, also inside a content type; else empty."""
    return F.lower(F.regexp_extract(text_of(html), r"(?i)<meta[^>]*charset=[\"']?([A-Za-z0-9-]+)", 1))


RECORD = "struct<id:string,_id:string,uuid:string,slug:string,title:string,date:string,url:string,image:string,duration:string,performers:array<struct<id:string,name:string,gender:string,extras:struct<gender:string>>>>"


def parse_records(raw: DataFrame, source: str, site: str, excluded_genders: tuple[str, ...] = (), column: str = "json") -> DataFrame:
    """Items from landed API records (one JSON object in column): coalesced id, trimmed title, filtered performers.

    Performers of an excluded gender are left out; rows whose JSON is broken, or without an id, go out with an _error.
    """
    r = F.from_json(F.col(column), RECORD, {"mode": "PERMISSIVE"})
    rows = raw.withColumn("__r", r)
    full = lambda c: F.nullif(F.trim(F.col(f"__r.{c}")), F.lit(""))
    ident = F.coalesce(full("id"), full("_id"), full("uuid"), full("slug"))
    gender = lambda p: F.lower(F.coalesce(p["gender"], p["extras"]["gender"], F.lit("unknown")))
    performers = F.array_distinct(F.transform(F.filter("__r.performers", lambda p: (F.coalesce(F.trim(p["name"]), F.lit("")) != "") & ~gender(p).isin(list(excluded_genders))), lambda p: F.trim(p["name"])))
    url = F.coalesce(full("url"), F.concat(F.lit(f"{site.rstrip('/')}/"), ident))
    return rows.select(ident.alias("source_item_id"), full("title").alias("title"), F.left(full("date"), F.lit(10)).alias("release_date"), performers.alias("performers"), X.parse_duration("__r.duration").alias("duration_sec"), F.coalesce(full("image"), F.lit("")).alias("thumbnail_url"), url.alias("release_url"), F.lit(source).alias("source"), F.struct(F.lit(source).alias("source"), F.lit(site).alias("source_url"), url.alias("record_url"), ident.alias("source_item_id")).alias("provenance"), F.when(F.col("__r").isNull() | ident.isNull(), "unreadable record").alias("_error"))


def map_categories(posts: DataFrame, categories: DataFrame, display: dict[str, str]) -> DataFrame:
    """posts (category_id) with category: the display name of its slug, else the raw name and category_unmapped."""
    named = categories.select(F.col("id").alias("category_id"), "slug", F.col("name").alias("__name")).dropDuplicates(["category_id"])
    shown = F.lit(None).cast("string")
    for slug, to in display.items():
        shown = F.when(F.col("slug") == slug, to).otherwise(shown)
    return posts.join(named, "category_id", "left").withColumn("category", F.coalesce(shown, "__name")).withColumn("category_unmapped", shown.isNull() & F.col("__name").isNotNull()).drop("slug", "__name")


def normalised_tags(tags: Column) -> Column:
    """Names of tags, each a JSON text of a string or of an object with a name."""
    v = lambda t: F.try_parse_json(t)
    name = lambda t: F.coalesce(F.try_variant_get(v(t), "$.name", "string"), F.try_variant_get(v(t), "$[0]", "string"), F.when(~F.startswith(F.ltrim(t), F.lit("{")), F.try_variant_get(v(t), "$", "string")))
    return F.array_distinct(F.filter(F.transform(tags, name), lambda x: F.coalesce(x, F.lit("")) != ""))


def route_table(text: Column | str, marker: str) -> Column:
    """The JSON object after a marker in a script, by its braces; strings and escapes are respected."""

    @F.pandas_udf(T.StringType())
    def scan(values: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            at = (x or "").find(marker)
            start = -1 if at < 0 else x.find("{", at + len(marker))
            if start < 0:
                return None
            try:
                return json.dumps(json.JSONDecoder().raw_decode(x, start)[0], sort_keys=True)
            except (ValueError, RecursionError):
                return None

        return values.map(one)

    return scan(text_of(text))


def resolve_gender(performers: DataFrame, inline: DataFrame, by_id: DataFrame, by_name: DataFrame) -> DataFrame:
    """performers (performer_id, name) with gender: inline, else by id, else by lower-case name, else Unknown; last wins."""
    out = performers
    for k, (table, key, own) in enumerate(((inline, "performer_id", F.col("performer_id")), (by_id, "performer_id", F.col("performer_id")), (by_name, "name", F.lower("name")))):
        got = table.groupBy((F.lower(key) if key == "name" else F.col(key)).alias(f"__k{k}")).agg(F.max_by("gender", "ordinal").alias(f"__g{k}"))
        out = out.join(got, own == F.col(f"__k{k}"), "left").drop(f"__k{k}")
    return out.withColumn("gender", F.coalesce(*(F.nullif(F.col(f"__g{k}"), F.lit("")) for k in range(3)), F.lit("Unknown"))).drop(*(f"__g{k}" for k in range(3)))


LISTED = "struct<`@type`:string,itemListElement:array<struct<position:int,url:string,name:string,item:struct<url:string,name:string,duration:string,uploadDate:string>>>>"


def parse_linked_listing(pages: DataFrame, kind: str = "ItemList", html: str = "html", url: str = "url") -> DataFrame:
    """A row for each element of the first linked-data block of a kind: place, link (absolute), title, duration_sec, date.

    Relative addresses are completed with the page's own origin; blocks that are no JSON are passed over.
    """
    blocks = F.transform(F.regexp_extract_all(text_of(html), F.lit(LINKED_DATA), F.lit(1)), lambda b: F.from_json(F.trim(b), LISTED))
    first = F.get(F.filter(blocks, lambda b: F.coalesce(b["@type"] == kind, F.lit(False))), F.lit(0))
    rows = pages.withColumn("__list", first).select(*(c for c in pages.columns if c != html), F.posexplode("__list.itemListElement").alias("place", "__e"))
    own = F.coalesce(F.col("__e.item.url"), F.col("__e.url"))
    origin = F.regexp_extract(text_of(url), r"^(https?://[^/?#]+)", 1)
    link = F.when(F.startswith(own, F.lit("/")), F.concat(origin, own)).otherwise(own)
    return rows.withColumns({"link": link, "title": F.nullif(X.clean_text(F.coalesce(F.col("__e.item.name"), F.col("__e.name"))), F.lit("")), "duration_sec": X.parse_duration("__e.item.duration"), "date": F.left(F.col("__e.item.uploadDate"), F.lit(10))}).drop("__e")


POST = "struct<id:bigint,date:string,date_gmt:string,link:string,slug:string,title:struct<rendered:string>,content:struct<rendered:string>,categories:array<bigint>,tags:array<string>,featured_media_url:string>"


def parse_posts(raw: DataFrame, source: str, column: str = "json") -> DataFrame:
    """Items from landed posts (a JSON object in column): decoded title, first category, UTC date before local, thumbnail.

    The thumbnail is the post's own or the first image of its content. Posts that are no JSON or have no id have an _error.
    """
    p = raw.withColumn("__p", F.from_json(column, POST)).withColumn("__title", X.clean_text(decode_all("__p.title.rendered")))
    date = F.coalesce(F.nullif(F.col("__p.date_gmt"), F.lit("")), F.col("__p.date"))
    image = F.nullif(F.regexp_extract(text_of("__p.content.rendered"), r"(?is)<img\b[^>]*?src=[\"']([^\"']+)", 1), F.lit(""))
    ident = F.col("__p.id").cast("string")
    return p.select(ident.alias("source_item_id"), F.col("__title").alias("title"), F.col("__title").alias("original_title"), F.left(date, F.lit(10)).alias("release_date"), F.get("__p.categories", F.lit(0)).alias("category_id"), F.coalesce(F.nullif(F.col("__p.featured_media_url"), F.lit("")), image, F.lit("")).alias("thumbnail_url"), F.col("__p.link").alias("release_url"), F.lit(source).alias("source"), F.struct(F.lit(source).alias("source"), F.col("__p.link").alias("record_url"), ident.alias("source_item_id"), F.col("__p.date").alias("date"), F.col("__p.date_gmt").alias("date_gmt"), F.get("__p.categories", F.lit(0)).cast("string").alias("category_id")).alias("provenance"), F.when(F.col("__p.id").isNull(), "unreadable post").alias("_error"))


def decode_all(value: Column | str) -> Column:
    """Numeric and common named character references of a text; null is empty."""
    return X.decode_numeric_entities(text_of(value))


VIDEO = "struct<`@type`:string,name:string,datePublished:string,uploadDate:string,duration:string,thumbnailUrl:string,actor:array<struct<name:string>>>"


def parse_video_page(pages: DataFrame, source: str, id_pattern: str, html: str = "html", url: str = "url") -> DataFrame:
    """An item from the first VideoObject block of each page: id from the address, title, date, performers, duration.

    Without a block, an id, a name or a date, and with a date that is none, the row has an _error. The date is cut to 10
    characters; names are trimmed, empty and repeated ones dropped. Blocks that are no JSON are passed over.
    """
    blocks = F.transform(F.regexp_extract_all(text_of(html), F.lit(LINKED_DATA), F.lit(1)), lambda b: F.from_json(F.trim(b), VIDEO))
    rows = pages.withColumn("__v", F.get(F.filter(blocks, lambda b: F.coalesce(b["@type"] == "VideoObject", F.lit(False))), F.lit(0)))
    ident = F.nullif(F.regexp_extract(text_of(url), id_pattern, 1), F.lit(""))
    title, date = F.nullif(F.trim("__v.name"), F.lit("")), F.left(F.coalesce(F.nullif(F.col("__v.datePublished"), F.lit("")), F.col("__v.uploadDate")), F.lit(10))
    real = date.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(date).isNotNull()
    names = F.array_distinct(F.filter(F.transform("__v.actor", lambda a: F.trim(a["name"])), lambda n: F.coalesce(n, F.lit("")) != ""))
    error = F.when(ident.isNull() | title.isNull() | date.isNull(), "required metadata missing").when(~F.coalesce(real, F.lit(False)), "invalid release date")
    kept = [c for c in pages.columns if c not in (html, url)]
    return rows.select(*kept, ident.alias("source_item_id"), title.alias("title"), date.alias("release_date"), F.coalesce(names, F.array().cast("array<string>")).alias("performers"), X.parse_duration("__v.duration").alias("duration_sec"), F.coalesce("__v.thumbnailUrl", F.lit("")).alias("thumbnail_url"), F.col(url).alias("release_url"), F.lit(source).alias("source"), error.alias("_error"))


ROW = "struct<id:string,title:string,release_date:string,writer:struct<id:string,slug:string,name:string>,tags:array<string>,badge:string,removed:boolean>"
PAGE = f"struct<rows:array<{ROW}>,next:string>"


def parse_listing_rows(pages: DataFrame, marker: str = "data-page", html: str = "html") -> DataFrame:
    """A row for each listed entry of pages that carry their data as JSON in an attribute: item_id, title, group, next.

    A page without such data gives one row with an _error; entries without an id are dropped.
    """
    page = pages.withColumn("__v", parsed(embedded_json(html, marker), PAGE))
    rows = page.select(*(c for c in pages.columns if c != html), F.col("__v.next").alias("next"), F.col("__v").isNull().alias("__bad"), F.posexplode_outer("__v.rows").alias("place", "__r"))
    w = "__r.writer"
    group = F.coalesce(*(F.nullif(F.col(f"{w}.{k}"), F.lit("")) for k in ("slug", "id", "name")))
    out = rows.withColumns({"item_id": F.col("__r.id"), "title": X.clean_text("__r.title"), "release_date": F.col("__r.release_date"), "group": group, "_error": F.when(F.col("__bad"), "no page data")})
    return out.where(F.col("item_id").isNotNull() | F.col("__bad")).drop("__r", "__bad")


def parse_details(pages: DataFrame, marker: str = "data-page", html: str = "html") -> DataFrame:
    """A row for each detail page: item_id, tags (names), badge, removed; without an id or data, an _error."""
    page = pages.withColumn("__v", parsed(embedded_json(html, marker), ROW))
    return page.withColumns({"item_id": F.col("__v.id"), "tags": normalised_tags(F.coalesce(F.transform("__v.tags", lambda t: F.when(F.startswith(F.ltrim(t), F.lit("{")), t).otherwise(F.to_json(F.array(t)))), F.array().cast("array<string>"))), "badge": F.col("__v.badge"), "removed": F.coalesce("__v.removed", F.lit(False)), "_error": F.when(F.col("__v.id").isNull(), "no detail data")}).drop("__v", html)
