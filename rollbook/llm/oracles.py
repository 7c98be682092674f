"""SQL for DuckDB of what SQL can say of the training-data operators, over the views documents and benchmark."""

#: Fixed value: the white space that separates words, as a class of a regular expression.
GAP = r"[ \t\n\x0b\x0c\r]"

#: op6: every pair of equal words names a diagonal; on a diagonal that holds enough equal words in some window, all count.
DECONTAMINATION = r"""
with doc_words as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from (
    select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents)),
item_words as (
  select item_id, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) as j from (
    select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark)),
same as (
  select doc_id, item_id, n, j, pos - j as diagonal,
    count(*) over (partition by doc_id, item_id, pos - j) as matched
  from doc_words join item_words using (word)),
windows as (
  select doc_id, item_id, n, matched,
    count(*) over (partition by doc_id, item_id, diagonal order by j range between current row and 12 following) as near
  from same where matched >= ceil(0.8 * least(13, n)))
select doc_id, item_id, max(matched) as matched from windows where near >= ceil(0.8 * least(13, n)) group by doc_id, item_id
"""


def crc32(value: str) -> str:
    """SQL of the CRC-32 of a short ASCII string."""
    byte = "list_reduce([{0}]::UBIGINT[] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, z: xor(c >> 1, (c & 1) * 3988292384::UBIGINT))"
    text = f"list_transform(string_split({value}, ''), lambda x: ascii(x)::UBIGINT)"
    return f"xor(list_reduce([4294967295]::UBIGINT[] || {text}, lambda a, b: {byte.format('xor(a, b)')}), 4294967295::UBIGINT)"


#: op2: the unigram of lower-cased words and ends, learned from the documents whose remainder is not 2.
LM_BASE = rf"""
with docs as (
  select doc_id, {crc32("coalesce(doc_id::varchar, '')")} % 7 = 2 as held_out,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{GAP}+'), lambda x: x <> '') || [''] as tokens
  from documents),
tokens as (select doc_id, held_out, unnest(tokens) as token from docs),
counts as (select token, count(*) as c from tokens where not held_out group by token),
totals as (select coalesce(sum(c), 0) as n, count(*) as v from counts)
select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, any_value(n)::bigint as train_tokens,
  round(sum(log10((coalesce(c, 0) + 1) / (n + 1 * (v + 1)))), 4) as base_score
from tokens left join counts using (token), totals group by doc_id, held_out
"""


def spans(kind: str, rank: int, pattern: str, good: str) -> str:
    """SQL of the matches of a pattern with their places: what lies between them and they themselves, in turn."""
    return f"""
  select doc_id, {rank} as rank, '{kind}' as kind, m, list_sum(list_transform(between[:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: len(x))), 0) as a from (
    select doc_id, found, between, unnest(found) as m, generate_subscripts(found, 1) as i from (
      select doc_id, regexp_extract_all(t, '{pattern}') as found, string_split_regex(t, '{pattern}') as between from texts))
  where {good}"""


_ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?"""

#: op4: the patterns' matches, their counts and the hash of their spans.
SECRET_BASE = rf"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
found as ({spans("assign", 0, _ASSIGN + "[A-Za-z0-9+/_.=-]+", f"len(regexp_replace(m, '^{_ASSIGN}', '')) >= 8")}
  union all {spans("access", 1, "AKIA[A-Z0-9]+", "len(m) >= 16")}
  union all {spans("hex", 2, "[0-9a-f]+", "len(m) >= 32")}),
listed as (
  select doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
    string_agg(kind || ':' || a::bigint || ':' || (a + len(m))::bigint, ',' order by a, rank) as spans
  from found group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256
from texts left join listed using (doc_id)
"""

#: op5: words, their characters, symbols, repeated lines and words in repeated windows of three.
RULE_BASE = rf"""
with docs as (
  select doc_id, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '{GAP}+'), lambda x: x <> '') as w from documents),
lines as (
  select doc_id, line, row_number() over (partition by doc_id, line order by pos) as turn from (
    select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as pos from docs)),
dup as (select doc_id, count(*) as n_dup_lines from lines where turn > 1 and regexp_matches(line, '[^ \t\n\x0b\x0c\r]') group by doc_id),
placed as (select doc_id, w, unnest(range(1, len(w) - 1)) as i from docs where len(w) >= 3),
windows as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from placed),
covered as (select doc_id, count(distinct i + k) as n_repeat_words from windows, (select unnest([0, 1, 2]) as k) where n > 1 group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::bigint as word_chars,
  len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  len(w) < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * len(w) as base_failed
from docs left join dup using (doc_id) left join covered using (doc_id)
"""

#: op13: every document's score for every item, the ten best of each.
LEXICAL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms FROM documents),
counted AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
damped AS (SELECT row, doc_id, terms, 25 + (75 * len(terms) * n) // total AS m FROM d, counted WHERE len(terms) > 0),
tf AS (SELECT row, doc_id, m, term, count(*) AS tf FROM (SELECT row, doc_id, m, unnest(terms) AS term FROM damped) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), counted),
items AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
scores AS (SELECT item_id, row, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM items JOIN weights USING (term) JOIN tf USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, row)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
