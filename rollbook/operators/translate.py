"""Title translation: cache, then dictionary, then a pluggable batch translator, each for what the one before left."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import apply_glossary, has_cjk

#: Gets distinct titles, gives {original: translation}; titles that it leaves out stay untranslated.
Translator = Callable[[list[str]], dict[str, str]]
BATCH = 20


def translate_titles(titles: DataFrame, cache: DataFrame, glossary: list[tuple[str, str]], translator: Translator | None = None, name: str = "external") -> DataFrame:
    """original, title, provider, translated for each distinct title that is not blank.

    provider is cache's own, glossary, name, or untranslated; only the first two are known without the translator, which
    sees distinct titles in batches on the executors. A title without Han or kana is its own translation.
    """
    distinct = titles.select(F.col("original")).where(F.trim("original") != "").distinct()
    known = cache.groupBy("original").agg(F.max_by(F.struct("title", "provider", "translated"), F.struct("title")).alias("__cached"))
    looked = distinct.join(known, "original", "left").withColumn("__own", apply_glossary("original", glossary))
    made = looked.select(
        "original",
        F.when(F.col("__cached").isNotNull(), F.col("__cached.title")).when(~has_cjk("original"), F.col("original")).when(F.col("__own.translated"), F.col("__own.text")).otherwise(F.col("original")).alias("title"),
        F.when(F.col("__cached").isNotNull(), F.col("__cached.provider")).when(~has_cjk("original"), "none").when(F.col("__own.translated"), "glossary").otherwise("untranslated").alias("provider"),
        F.when(F.col("__cached").isNotNull(), F.col("__cached.translated")).when(~has_cjk("original"), False).otherwise(F.col("__own.translated")).alias("translated"),
    )
    if translator is None:
        return made

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for a in range(0, len(frame), BATCH):
                part = frame.iloc[a : a + BATCH].copy()
                try:
                    got = translator(part["original"].tolist())
                except Exception:  # a translator that fails must not fail the job: its titles stay as they are
                    got = {}
                text = part["original"].map(got)
                ok = text.notna() & (text != "")
                part.loc[ok, "title"], part.loc[ok, "provider"], part.loc[ok, "translated"] = text[ok], name, True
                yield part

    return made.where("provider <> 'untranslated'").unionByName(made.where("provider = 'untranslated'").mapInPandas(run, made.schema))


def grown_cache(cache: DataFrame, made: DataFrame) -> DataFrame:
    """The cache with what was newly found; titles that stayed untranslated or needed none are not kept."""
    columns = ["original", "title", "provider", "translated"]
    new = made.where(F.col("translated")).join(cache.select("original"), "original", "left_anti")
    return cache.select(*columns).unionByName(new.select(*columns))


def named_labels(status: DataFrame, namer: Translator) -> DataFrame:
    """label_id, name of labels whose name holds Han or kana, by one call of namer; none if it fails."""
    rows = [(r.label_id, r.name.strip()) for r in status.where(has_cjk("name")).select("label_id", "name").collect()]
    try:
        got = namer(list(dict.fromkeys(n for _, n in rows if n))) if rows else {}
    except Exception:  # names are an extra: without them the job goes on
        got = {}
    found = [(i, got[n].strip()) for i, n in rows if (got.get(n) or "").strip()]
    return status.sparkSession.createDataFrame(found, "label_id string, name string")


def apply_translations(items: DataFrame, translations: DataFrame) -> DataFrame:
    """Items with their original title's translation where they have none yet; the original is kept."""
    named = translations.select(F.col("original").alias("__original"), F.struct(F.col("title").alias("t"), F.col("provider").alias("p"), F.col("translated").alias("d")).alias("__got"))
    own = F.coalesce("original_title", "title")
    joined = items.withColumn("__own", own).join(named, F.col("__own") == F.col("__original"), "left")
    take = ~F.coalesce(F.col("title_translated"), F.lit(False)) & F.coalesce(F.col("__got.d"), F.lit(False))
    return joined.withColumns({"original_title": F.col("__own"), "title": F.when(take, F.col("__got.t")).otherwise(F.col("title")), "translation_provider": F.when(take, F.col("__got.p")).otherwise(F.coalesce(F.col("translation_provider"), F.col("__got.p"))), "title_translated": F.coalesce(F.col("title_translated"), F.lit(False)) | take}).select(*items.columns)


def rename_labels(items: DataFrame, status: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and status rows whose label has a translated name (label_id, name) shown under it."""
    known = names.groupBy("label_id").agg(F.max("name").alias("__name"))
    a = items.join(known, "label_id", "left").withColumn("label", F.coalesce("__name", "label")).select(*items.columns)
    b = status.join(known, "label_id", "left").withColumn("name", F.coalesce("__name", "name")).select(*status.columns)
    return a, b


def parse_translations(text, inputs):
    """Translations of the inputs, aligned with them, from a reply that holds a JSON object somewhere; null if absent."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    found = F.from_json(F.nullif(body, F.lit("")), "map<string,string>")
    return F.transform(inputs, lambda x: F.nullif(F.trim(F.try_element_at(found, x)), F.lit("")))
