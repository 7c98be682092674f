"""Benchmark decontamination (operator 6) by spaced-seed hashing, in DataFrame functions alone.

A mask picks six of eight or nine neighbouring words; the hash of the picked words is the same on both sides whatever
the words in between are. Test hashes are joined to training hashes, and each hit names a document, an item and a diagonal
(where the item would begin in the document). Along the diagonal the words are then compared one by one: a document
is contaminated if some WINDOW words in a row hold at least SHARE equal ones. The two masks were found by search to be
lossless: any 13 words with at most two substitutions show at least one of them whole. Items of fewer words get masks of
their own, found when they are searched, that are lossless for the substitutions that SHARE permits at their lengths.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import stored

#: Picked offsets of each mask.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
WINDOW, SHARE = 13, 0.8
#: What may be broadcast: so many numbers of seeds and their places, contaminated or suspected documents (16 bytes or so each).
MOST_SEEDS, MOST_ROWS = 2_000_000, 300_000


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words: runs of letters and digits, in lower case; null gives none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(words: str, picked: tuple[int, ...], number: int, most: int | None = None) -> Column:
    """Hashes of the picked words at every place where the mask fits, in order; with most, none of longer texts."""
    span = picked[-1] + 1
    at = ", ".join(f"{words}[i + {o}]" for o in picked)
    short = "" if most is None else f" and size({words}) <= {most}"
    return F.expr(f"case when size({words}) >= {span}{short} then transform(sequence(0, size({words}) - {span}), i -> xxhash64({at}, {number})) else array() end")


def masks_for(lengths: list[int], window: int = WINDOW, share: float = SHARE) -> list[tuple[int, ...]]:
    """MASKS, and more for items of lengths under window, so that each shows a mask whole whatever substitutions share permits.

    From the shortest length on, picks of words are added that cover most of the substitutions still open, until none is.
    """
    masks = list(MASKS)
    for n in sorted({n for n in lengths if 0 < n < window}):
        bad = n - needed(n, window, share)
        own = [m for m in masks if n <= longest_item(m, window, share)]
        todo = [p for p in map(set, combinations(range(n), bad)) if not any(shows(m, n, p) for m in own)]
        weight = min(6, n - bad)
        pool = [(0, *m) for m in combinations(range(1, n), weight - 1)] if todo else []
        while todo:
            best = max(pool, key=lambda m: sum(shows(m, n, p) for p in todo))
            masks.append(best)
            todo = [p for p in todo if not shows(best, n, p)]
    return masks


def longest_item(mask: tuple[int, ...], window: int = WINDOW, share: float = SHARE) -> int:
    """Words of the longest item under window that mask serves; one of under 4 words only items that leave no more."""
    return max((n for n in range(1, window) if min(4, needed(n, window, share)) <= len(mask)), default=0)


def shows(mask: tuple[int, ...], n: int, changed: set[int]) -> bool:
    """Whether mask fits somewhere in n words without picking a changed one."""
    return any(changed.isdisjoint(o + at for o in mask) for at in range(n - mask[-1]))


def seed_rows(table: DataFrame, keep: list[str], words: str, masks: list[tuple[int, ...]], most: list[int | None] | None = None) -> DataFrame:
    """keep columns, place and seed: a row for each place and mask; most: the longest texts that each mask is for."""
    most = most or [None] * len(masks)
    made = table.select(*keep, *(seeds(words, m, k, most[k]).alias(f"__seeds{k}") for k, m in enumerate(masks)))
    ends = [sum((F.size(f"__seeds{j}") for j in range(k)), F.lit(0)).alias(f"__end{k}") for k in range(len(masks))]
    laid = made.select(*keep, *ends, F.posexplode(F.concat(*(f"__seeds{k}" for k in range(len(masks))))).alias("__at", "seed"))
    begin = F.lit(0)
    for k in range(1, len(masks)):
        begin = F.when(F.col("__at") >= F.col(f"__end{k}"), F.col(f"__end{k}")).otherwise(begin)
    return laid.select(*keep, (F.col("__at") - begin).alias("place"), "seed")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each contaminated document and item: key, text_hash, item id, matched (equal words on the best diagonal).

    Null and wordless texts and items match nothing; an empty table on either side gives no rows. Items shorter than
    window must hold share of all their words, and are found with any substitutions that this permits.
    Items of equal words are searched once, then all named. Rows of one key and text give one row an item. A null key is
    a key like others. Whole texts are searched; columns other than those named are not read.
    """
    tests = stored(benchmark.select(F.col(item).alias("item"), word_hashes(F.col(item_text)).alias("words")).where("size(words) > 0"), "benchmark")
    classes = tests.groupBy("words").agg(F.count("*").alias("n")).select(F.xxhash64(F.to_json("words")).alias("class"), "words")
    lengths = [r[0] for r in classes.select(F.size("words")).distinct().where(f"size(words) < {window}").collect()]  # fewer than window rows
    masks = masks_for(lengths, window, share)
    most = [None if m in MASKS else longest_item(m, window, share) for m in masks]
    known = stored(seed_rows(classes, ["class"], "words", masks, most).groupBy("seed", "class").agg(F.collect_set("place").alias("places")), "seeds")
    if (known.agg(F.sum(F.size("places") + 2)).first()[0] or 0) <= MOST_SEEDS:
        known = F.broadcast(known)
    columns = docs.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), word_hashes(F.col(text)).alias("words"))
    found = seed_rows(columns, ["id", "text_hash"], "words", masks).join(known, "seed")
    spread = found.select("id", "text_hash", "class", "place", F.explode("places").alias("start"))
    hits = stored(spread.select("id", "text_hash", "class", (F.col("place") - F.col("start")).alias("diagonal")).distinct(), "hits")
    suspects = hits.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    if suspects.count() <= MOST_ROWS:
        suspects = F.broadcast(suspects)
    same_row = F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    texts = docs.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    again = stored(texts.join(suspects, same_row, "left_semi").dropDuplicates(["id", "text_hash"]).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), word_hashes(F.col("text")).alias("doc")), "suspects")
    pairs = hits.join(again, same_row).join(classes, "class")
    beside = F.expr("slice(doc, greatest(diagonal, 0) + 1, size(words))")  # of the document's words those that lie beside the item's
    along = pairs.select("id", "text_hash", "class", "words", F.expr("least(diagonal, 0)").alias("shift"), beside.alias("part"))
    along = along.select("id", "text_hash", "class", F.expr("transform(words, (w, j) -> cast(w <=> get(part, j + shift) as int))").alias("same"))
    n, need = f"least({window}, size(same))", f"ceil({share} * least({window}, size(same)))"
    full = along.where(F.expr(f"exists(sequence(0, size(same) - {n}), s -> aggregate(slice(same, s + 1, {n}), 0, (a, x) -> a + x) >= {need})"))
    best = full.groupBy("id", "text_hash", "class").agg(F.max(F.expr("aggregate(same, 0, (a, x) -> a + x)")).cast("long").alias("matched"))
    named = tests.select(F.col("item").alias(item), F.xxhash64(F.to_json("words")).alias("class"))
    return best.join(named, "class").select(F.col("id").alias(key), "text_hash", item, "matched")


def clean_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that share no passage with the benchmark, with all their columns."""
    out = stored(contaminated(docs, benchmark, key=key, text=text, **options).select(F.col(key).alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "contaminated")
    bad = F.broadcast(out) if out.count() <= MOST_ROWS else out
    own = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.join(bad, docs[key].eqNullSafe(bad["__id"]) & (own == bad["__hash"]), "left_anti")


def needed(length: int, window: int = WINDOW, share: float = SHARE) -> int:
    """Equal words that a window of an item of so many words must hold."""
    return math.ceil(share * min(window, length))
