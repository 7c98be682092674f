"""Text expressions: tokens, title words, stems, durations, names, entities, dictionary rewrites. All run in the JVM."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no identity in a title, and words that only decorate one.
STOP_WORDS = ["a", "an", "and", "at", "by", "for", "in", "into", "of", "on", "the", "to", "with"]
DECORATION_WORDS = ["new", "watch", "download"]
# Blocks of Han characters and kana.
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}]"


def text_of(value: Column | str) -> Column:
    """The value as a string, null as the empty one."""
    return F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit(""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out once, however often use looks at it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@cache
def folding() -> tuple[str, str, dict[str, str]]:
    """By rule, from compatibility forms without marks: characters that stand for one ASCII letter or digit, these, and a
    map of the characters that stand for several characters with such a one among them (ligatures, units, enclosed ones)."""
    pairs, several = [], {}
    for cp in range(0x80, 0x20000):
        if 0xD800 <= cp < 0xE000:
            continue
        form = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not 0x300 <= ord(c) <= 0x36F)
        if len(form) == 1 and form.isascii() and form.isalnum():
            pairs.append((chr(cp), form))
        elif len(form) > 1 and any(c.isascii() and c.isalnum() for c in form):
            several[chr(cp)] = form
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs), several


def character_class(chars: list[str]) -> str:
    """A regular expression's class of these characters, as ranges."""
    out, points = [], sorted(map(ord, chars))
    begin = last = points[0]
    for p in [*points[1:], None]:
        if p != last + 1 if p is not None else True:
            out.append(f"\\x{{{begin:X}}}-\\x{{{last:X}}}")
            begin = p
        last = p
    return "[" + "".join(out) + "]"


def fold(value: Column | str) -> Column:
    """Compatibility decomposition as far as it gives ASCII letters and digits, no combining marks U+0300 to U+036F, lower case.

    Plain ASCII takes the first branch; the table of characters that stand for several is only read for texts that hold one.
    """
    wide, plain, several = folding()
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")

    def folded(text: Column) -> Column:
        spelled = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
        spelled = F.when(text.rlike(character_class(list(several))), spelled).otherwise(text)
        return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(F.lower(F.regexp_replace(F.translate(spelled, wide, plain), r"[\x{0300}-\x{036F}]", "")))

    return folded(text_of(value)) if isinstance(value, str) else bound(text_of(value), folded)


def tokens(value: Column | str) -> Column:
    """Runs of a-z and 0-9 of the folded text, in order."""
    return F.regexp_extract_all(fold(value), F.lit("[a-z0-9]+"), F.lit(0))


def normalized(value: Column | str) -> Column:
    return F.array_join(tokens(value), " ")


def words(value: Column | str) -> Column:
    """Tokens after a cut between a small and a capital letter."""
    return tokens(F.regexp_replace(text_of(value), "([a-z])([A-Z])", "$1 $2"))


def without(items: Column, dropped: list[str]) -> Column:
    """items but for the dropped ones; what is left may repeat."""
    return F.filter(items, lambda x: ~x.isin(dropped))


def title_words(value: Column | str, marker: str = "featuring", stop: list[str] = STOP_WORDS) -> Column:
    """Words before the marker without stop words; of the whole title if fewer than four are left."""
    text = text_of(value)
    core = without(words(F.get(F.split(text, rf"(?i)(?<![A-Za-z0-9_]){marker}(?![A-Za-z0-9_])", 2), F.lit(0))), stop)
    return bound(core, lambda c: F.when(F.size(c) >= 4, c).otherwise(without(words(text), stop)))


def title_and_words(value: Column | str, marker: str = "featuring", stop: list[str] = STOP_WORDS) -> Column:
    """Struct of title, the distinct title_words, and words, the distinct words; a text without the marker is cut into words once."""
    text = text_of(value)
    marked = text.rlike(rf"(?i)(?<![A-Za-z0-9_]){marker}(?![A-Za-z0-9_])")
    both = lambda w: F.struct(F.array_distinct(F.when(marked, title_words(text, marker, stop)).otherwise(without(w, stop))).alias("title"), F.array_distinct(w).alias("words"))
    return bound(words(text), both)


def title_score(left: Column | str, right: Column | str, least: int = 4) -> Column:
    """Share of the left title's distinct words that the right one has; 0 unless at least least are shared."""

    def share(reference: Column) -> Column:
        shared = F.when(F.size(reference) >= least, F.size(F.array_intersect(reference, words(right)))).otherwise(0)
        return bound(shared, lambda n: F.when(n >= least, n / F.size(reference)).otherwise(0.0))

    return bound(F.array_distinct(title_words(left)), share)


def performer_name(value: Column | str, suffix: str = "ls") -> Column:
    """Words of a name joined by spaces, without a last word that is the suffix."""
    parts = words(value)
    cut = F.when(F.try_element_at(parts, F.lit(-1)) == suffix, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.array_join(cut, " ")


def title_stem(value: Column | str) -> Column:
    """Tokens of a title without addresses, brace and tag decorations, dates and decoration words.

    A number of four digits that looks like a year, before a short date with separators of another kind, is no part of a date.
    """
    text = text_of(value)
    short = r"\d{{2}}{0}(?:0?[1-9]|1[0-2]){1}(?:0?[1-9]|[12]\d|3[01])(?![A-Za-z0-9_])"
    # What is cut out, in order. Word boundaries are look-arounds, as Java's own follow Unicode letters.
    for pattern in (r"(?i)https?://\S+", r"(?i)\{(?:new|watch/?download:)[^}]*\}", r"(?:\s+#[\p{L}\p{N}_-]+)+\s*$", rf"(?<![A-Za-z0-9_])(?:19|20)\d{{2}}([-/. ])(?!{short.format(r'(?!\1)([-/. ])', r'\2')})\d{{1,2}}[-/. ]\d{{1,2}}(?![A-Za-z0-9_])", rf"(?<![A-Za-z0-9_]){short.format('[-/. ]', '[-/. ]')}"):
        text = F.regexp_replace(text, pattern, " ")
    return F.array_join(without(tokens(text), DECORATION_WORDS), " ")


def month_day_matches(title: Column | str, release: Column | str) -> Column:
    """Whether the last month-day code of three or four digits in a title is within a day of the release date.

    Without a code it is true; with one and no release date, false.
    """
    runs = F.regexp_extract_all(text_of(title), F.lit(r"(?:^|\D)(\d{3,4})(?=\D|$)"), F.lit(1))
    valid = F.filter(runs, lambda x: F.substring(x, F.lit(1), F.length(x) - 2).cast("int").between(1, 12) & F.right(x, F.lit(2)).cast("int").between(1, 31))
    code = F.lpad(F.try_element_at(valid, F.lit(-1)), 4, "0")
    date = F.to_date(F.try_to_timestamp(text_of(release)))
    near = F.array(*(F.date_format(F.date_add(date, k), "MMdd") for k in (-1, 0, 1)))
    return F.when(code.isNull(), True).when(date.isNull(), False).otherwise(F.array_contains(near, code))


def configured_code(title: Column | str, pattern: Column | str) -> Column:
    """First match of a label's own code pattern in a title, in lower case; null without pattern or match."""
    pattern = F.col(pattern) if isinstance(pattern, str) else pattern
    return F.nullif(F.lower(F.regexp_substr(text_of(title), pattern)), F.lit(""))


def has_cjk(value: Column | str) -> Column:
    return text_of(value).rlike(CJK)


def search_slug(value: Column | str) -> Column:
    """Tokens joined by hyphens, for an address."""
    return F.array_join(tokens(value), "-")


def url_component(value: Column | str) -> Column:
    """Percent-encoding in which a space is %20."""
    return F.replace(F.url_encode(text_of(value)), F.lit("+"), F.lit("%20"))


def clean_text(value: Column | str) -> Column:
    """Decodes the entities of ampersand, apostrophe and double quote, and trims."""
    text = text_of(value)
    for pattern, to in (("(?i)&amp;", "&"), ("(?i)&#(?:39|x27);", "'"), ("(?i)&quot;", '"')):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def decode_named_entities(value: Column | str) -> Column:
    """clean_text, and the entities of angle brackets and the no-break space."""
    text = text_of(value)
    for pattern, to in (("(?i)&nbsp;", " "), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&#0*39;|&#x0*27;|&apos;", "'"), ("(?i)&amp;", "&")):
        text = F.regexp_replace(text, pattern, to)
    return text


def decode_numeric_entities(value: Column | str) -> Column:
    """Decimal references, then hexadecimal ones, then six names (ampersand, quotes, apostrophe, angle brackets); null stays null.

    A number that is no character stays as it is written.
    """
    text = (F.col(value) if isinstance(value, str) else value).cast("string")

    def decoded(at: Column, pattern: str, base: int) -> Column:
        between, found = F.split(at, pattern, -1), F.regexp_extract_all(at, F.lit(pattern), F.lit(0))
        number = lambda r: F.conv(F.regexp_extract(r, "([0-9A-Fa-f]+);$", 1), base, 10).try_cast("long")
        real = lambda n: n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        shown = F.transform(found, lambda r: F.when(real(number(r)), F.decode(F.unhex(F.lpad(F.hex(number(r)), 8, "0")), "UTF-32")).otherwise(r))
        return F.when(at.rlike(pattern), F.array_join(F.flatten(F.transform(between, lambda x, i: F.array(x, F.coalesce(F.get(shown, i), F.lit(""))))), "")).otherwise(at)

    out = decoded(decoded(text, "&#[0-9]+;", 10), "&#[xX][0-9a-fA-F]+;", 16)
    # The names, in the order in which they are decoded.
    for pattern, to in (("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.regexp_replace(out, pattern, to)
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def names(value: Column | str) -> Column:
    """Distinct names of a list in running text: cut at commas, "and" and "&", cleaned, in order."""
    parts = F.split(text_of(value), r"(?i),|\s+(?:and|&)\s+")
    return F.array_distinct(F.filter(F.transform(parts, clean_text), lambda x: x != ""))


def named_entries(entries: Column) -> Column:
    """Distinct cleaned names of an array of structs with a name field."""
    return F.array_distinct(F.filter(F.transform(entries, lambda e: clean_text(e["name"])), lambda x: x != ""))


def attributes(tag: Column | str) -> Column:
    """Map of a tag's attributes by lower-case name; of a repeated name the last value."""
    text = text_of(tag)
    pattern = r"([:A-Za-z0-9_-]+)\s*=\s*([\"'])((?s:.*?))\2"
    keys, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 3))
    pairs = F.arrays_zip(F.transform(keys, F.lower).alias("k"), F.transform(values, clean_text).alias("v"))
    return bound(pairs, lambda every: F.map_from_entries(F.filter(every, lambda p, i: ~F.exists(F.slice(every, i + 2, F.size(every)), lambda q: q["k"] == p["k"]))))


def parse_duration(value: Column | str, worded: bool = True) -> Column:
    """Seconds of a number, an ISO 8601 duration with a T, a clock or (worded) "1 hr 2 min"; null if none or not positive.

    Numbers are rounded half up. A clock of zero is 0, as the form itself is taken at its word. The form is told once, and
    only its own numbers are then looked for.
    """
    text = F.trim(text_of(value))
    d, edge = r"(\d+(?:\.\d+)?)", r"(?![A-Za-z0-9_])"
    iso = r"(?i)^P(?:\d+(?:\.\d+)?D)?T(?:\d+(?:\.\d+)?H)?(?:\d+(?:\.\d+)?M)?(?:\d+(?:\.\d+)?S)?$"
    rounded = lambda x: F.when(x > 0, F.floor(x + 0.5).cast("int"))
    number = lambda pattern: F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("double"), F.lit(0.0))
    parts = F.split(text, ":")
    clock = F.aggregate(parts, F.lit(0).cast("long"), lambda total, x: total * 60 + F.coalesce(x.try_cast("long"), F.lit(0)))
    lettered = sum((number(rf"(?i){d}{unit}") * weight for unit, weight in (("D", 86400), ("H", 3600), ("M", 60), ("S", 1))), F.lit(0.0))
    # The worded units and their seconds.
    units = ((r"(?:hours?|hrs?|h)", 3600), (r"(?:minutes?|mins?|m)", 60), (r"(?:seconds?|secs?|s)", 1))
    spoken = sum((number(rf"(?i){d}\s*{u}{edge}") * w for u, w in units), F.lit(0.0))
    out = F.when(text.rlike(r"^\d+(?:\.\d+)?$"), rounded(text.try_cast("double"))).when(text.rlike(r"^(?:\d+:)?\d{1,2}:\d{2}$"), clock.cast("int")).when(text.rlike(iso), rounded(lettered))
    return out.otherwise(rounded(spoken)) if worded else out


def apply_glossary(value: Column | str, glossary: list[tuple[str, str]]) -> Column:
    """Struct of text, hits, residual and translated: dictionary terms replaced, longest first, one after the other.

    A replacement is set off by spaces, spaces are collapsed, residual tells Han or kana left over; translated = hits > 0
    and nothing residual. Order matters: a shorter term is only seen in what longer ones left.
    """
    ordered = sorted(glossary, key=lambda t: (-len(t[0]), t[0]))
    text, hits = text_of(value), F.lit(0)
    for term, english in ordered:
        hits = hits + ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")
        text = F.replace(text, F.lit(term), F.lit(f" {english} "))
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    residual = text.rlike(CJK)
    return F.struct(text.alias("text"), hits.alias("hits"), residual.alias("residual"), ((hits > 0) & ~residual).alias("translated"))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, half up; null of nothing."""
    return F.when(whole > 0, F.floor(100 * part / whole + 0.5).cast("int"))


def month_label(date: Column | str) -> Column:
    return F.date_format(date, "MMMM yyyy")


def initials(value: Column | str) -> Column:
    """First letters of the first two words."""
    return F.array_join(F.transform(F.slice(F.filter(F.split(text_of(value), r"\s+"), lambda x: x != ""), 1, 2), lambda w: F.upper(F.substring(w, 1, 1))), "")


def escape_html(value: Column | str) -> Column:
    text = text_of(value)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def search_queries(title: Column, performers: Column, code: Column, label: Column, is_creator: Column, most_names: int = 2, most_words: int = 5) -> Column:
    """Blocking keys of an item: up to two names, the title without them, its code, its label unless it is a creator's."""
    known = F.slice(F.filter(F.array_distinct(F.transform(F.coalesce(performers, F.array().cast("array<string>")), lambda p: performer_name(p))), lambda x: x != ""), 1, most_names)
    inside = F.flatten(F.transform(known, words))
    rest = F.array_join(F.slice(F.filter(title_words(title), lambda w: ~F.array_contains(inside, w)), 1, most_words), " ")
    more = F.array(rest, code, F.when(~F.coalesce(is_creator, F.lit(False)), label))
    return F.array_distinct(F.filter(F.concat(known, more), lambda x: x.isNotNull() & (x != "")))


def expiry(url: Column | str, now: Column, skew: int = 60, ttl: int = 300) -> Column:
    """Epoch second at which an address ends: a path part of ten digits less skew, else now and ttl."""
    part = F.get(F.filter(F.split(text_of(url), "/"), lambda x: x.rlike(r"^\d{10}$")), F.lit(0))
    return F.coalesce(part.cast("long") - skew, F.unix_timestamp(now) + ttl)
