import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rollbook.llm import alignment
from rollbook.llm.tokens import byte_letters

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def tokens(text):
    """Ids and bytes of both sides, by the libraries alone; None if a side does not give the text back."""
    if not text:
        return None
    library, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    back = {c: b for b, c in byte_letters().items()}
    a = [(i, bytes(back[c] for c in library.id_to_token(i))) for i in library.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in model.encode(text):
        p = model.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else None


def groups(text):
    got = tokens(text)
    if got is None:
        return []
    ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in got]
    out, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        x, y = i, j
        while i < len(ends[0]) and ends[0][i] <= end:
            i += 1
        while j < len(ends[1]) and ends[1][j] <= end:
            j += 1
        out.append(([k for k, _ in got[0][x:i]], [k for k, _ in got[1][y:j]]))
    return out


def slow(docs):
    found = [(key, groups(text)) for key, text in docs]
    count = Counter(p for _, g in found for p in {(a, b) for left, right in g for a in left for b in right})
    highest = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    out = []
    for key, g in found:
        links = [(a, b) for left, right in g for a in left for b in right]
        said = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in g)
        out.append((key, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


TEXTS = ["the cat sat on the mat", "the cat  sat,   on \n\n the\tmat", "Straße café naïve", "日本語のテキスト 😀😀 x", "a▁b", "<|endoftext|> </s> <unk> <0x0A> x", "\x00\x01", " ", "    ", "  two", "end  ", "x" * 3000, "=" * 777 + " " * 555 + "ab" * 400, "  y", "don't WON'T 12345 3.14", None, ""]


def test_the_slow_versions_rows(spark):
    docs = [(k, t) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, "the cat"), (99, "the mat sat on the cat " * 200)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = alignment.align_corpus(rows, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == slow(docs)
    unfaithful = [r for r in got.collect() if r["doc_id"] == TEXTS.index("a▁b")]
    assert tuple(unfaithful[0])[1:] == (0, 0, 0, 0, 0, 0, "")


def test_wide_groups_count_like_narrow_ones(monkeypatch):
    texts = pa.array([t for t in TEXTS if t])
    narrow = alignment.align(texts, A, B)
    monkeypatch.setattr(alignment, "WIDE", 1)
    wide = alignment.align(texts, A, B)
    assert narrow.keys.tolist() == wide.keys.tolist() and narrow.times.tolist() == wide.times.tolist() and narrow.begins.tolist() == wide.begins.tolist()
    assert narrow.times.sum() == narrow.counts["n_links"].sum()


@pytest.mark.parametrize("docs", [[], [(1, None), (2, "")]])
def test_nothing_to_align(spark, docs):
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, alignment.align_corpus(rows, A, B).collect())) == [(k, 0, 0, 0, 0, 0, 0, "") for k, _ in docs]


def test_clashing_columns_and_other_keys(spark):
    rows = spark.createDataFrame([("k", "some text", 1, "p"), ("l", "more text", 2, "q")], "name string, body string, n_a int, pairs string")
    got = alignment.align_corpus(rows, A, B, "name", "body").collect()
    assert sorted(map(tuple, got)) == slow([("k", "some text"), ("l", "more text")])


def test_a_run_that_goes_on_over_batches_and_shards_in_order(spark):
    partial = spark.createDataFrame([((a << 32) | b, n) for n in (1, 2, 5) for a in range(40) for b in range(3)], "key long, n long").repartition(5)
    counts = alignment.sorted_counts(partial, 64)
    keys = np.array([(a << 32) | b for a in range(40) for b in range(3)])
    assert counts.of(keys).tolist() == [8] * 120 and counts.of(keys[5:7]).tolist() == [8, 8]
    assert counts.highest[:40].tolist() == [8] * 40 and not counts.highest[40:].any()
    assert alignment.run_lengths(np.array([1, 1, 4]), np.array([2, 3, 1]))[1].tolist() == [5, 1]
