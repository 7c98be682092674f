import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rollbook.llm import packing, token_files
from rollbook.llm.tokens import Encoder, blocks

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def texts(n: int) -> list[str]:
    r = random.Random(5)
    parts = ["a", "bé", "é", " ", " ", "\n", "'s", ".", "12", "\t", "Σ", "<|endoftext|>", "!!", "***", "token", "\x1c", "\u00a0", "'", "İ", "\u0301", "A", "字", "٣", "²", "-", "\r", "'LL", "\u200d"]
    plain = [p for p in parts if p not in ("<|endoftext|>", "\x1c", "\u00a0", "\u200d")]  # else nearly every text goes to the library whole
    return ["".join(r.choice(parts if k % 3 else plain) for _ in range(r.randint(0, 40))) for k in range(n)]


@pytest.mark.parametrize(("path", "kind"), [(WORDS, "words"), (BYTES, "bytes")])
def test_cached_ids_are_the_librarys(path, kind):
    library, fast = Tokenizer.from_file(path), Encoder(path, kind, most_pieces=50)
    all_texts = ["", " ", "x", " x", "x ", "it's DON'T", *texts(600)]
    for a in range(0, len(all_texts), 100):
        part = all_texts[a : a + 100]
        ids, begin = fast.encode(pa.array(part))
        assert [ids[x:y].tolist() for x, y in zip(begin, begin[1:], strict=False)] == [x.ids for x in library.encode_batch(part, add_special_tokens=False)]
    ids, begin = fast.encode(pa.array([None, "x", None, "a b", ""]).slice(1))
    assert [ids[x:y].tolist() for x, y in zip(begin, begin[1:], strict=False)] == [library.encode(t, add_special_tokens=False).ids for t in ("x", "", "a b", "")]
    assert fast.encode(pa.array([], pa.string()))[1].tolist() == [0]


def test_blocks_cover_a_column():
    column = pa.array(["a" * 5, None, "b" * 100, "", "c" * 3, "d" * 9])
    got = list(blocks(column, 10))
    assert [x for x, _ in got] == [0, *[y for _, y in got[:-1]]] and got[-1][1] == len(column) and (2, 3) in got


def test_packing_holds_every_id_once(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "x"]) for _ in range(r.choice([0, 3, 40, 700])))) for i in range(120)] + [(500, None), (None, "some words"), (7, "alpha"), (7, "alpha")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = packing.pack(df, WORDS, size=256, open_windows=4, least_piece=8).collect()
    library = Tokenizer.from_file(WORDS)
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append(library.encode(t or "", add_special_tokens=False).ids + [2])
    whole: dict = {}
    for p in got:
        assert p.length > 0
        whole.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.length, p.ids_crc32))
    for d, lists in ids.items():
        for x in lists:
            spans = sorted(whole[d, len(x)])
            copies = sum(len(y) == len(x) for y in lists)
            covered = sorted(k for s, n, _ in spans for k in range(s, s + n))
            assert covered == sorted(list(range(len(x))) * copies)
            for s, n, crc in spans:
                assert crc == zlib.crc32(np.array(x[s : s + n], "<u4").tobytes()) or copies > 1
    by: dict = {}
    for p in got:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    used = []
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 256
        used.append(at)
    assert sum(u < 256 - 8 for u in used) <= 1  # all but one are full but for less than the least piece


def test_packing_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string, ids string")
    assert packing.pack(df, WORDS).count() == 0
    clash = spark.createDataFrame([(1, "some words", "x", 5), (1, "some words", "x", 5), (None, None, None, None), (2, "long " * 60_000, "y", 1)], "doc_id long, text string, ids string, offset long")
    got = packing.pack(clash, WORDS).collect()
    assert sum(r.length for r in got) == 3 + 3 + 1 + 60_001 and {r.doc_tokens for r in got} == {3, 1, 60_001}


def keys_of(values: list, kind: pa.DataType | None = None) -> token_files.Keys:
    return token_files.Keys.of(pa.array(values, kind or pa.int64()))


def round_trip(keys: token_files.Keys) -> token_files.Index:
    n = len(keys.nth)
    index = token_files.Index.frombytes(token_files.Index.build(keys, np.arange(n) + 1, "<u2").tobytes())
    there, offsets, lengths = index.find(keys)
    assert there.all() and lengths.tolist() == list(range(1, n + 1))
    assert sorted(offsets.tolist()) == np.concatenate(([0], np.cumsum(np.arange(n) + 1)[:-1])).tolist()
    assert len(index.fingerprints) == n
    return index


def test_perfect_hash_is_minimal():
    for n in (1, 2, 3, 100, 5000):
        values = np.random.default_rng(n).choice(1 << 40, n, replace=False)
        index = round_trip(keys_of(values))
    assert index.find(keys_of(values + (1 << 41)))[0].sum() <= 1


def test_keys_that_met_in_one_hash():
    round_trip(keys_of([0, 0, 1 << 33]))
    round_trip(keys_of([None, None, -1, 0, (1 << 63) - 1, -(1 << 63)]))
    index = round_trip(keys_of(["", "", "a", None, "é", "x" * 9000], pa.string()))
    assert not index.find(keys_of(["b"], pa.string()))[0].any()


def test_equal_hashes_take_the_next_seed(monkeypatch):
    honest = token_files.Keys.hashes
    monkeypatch.setattr(token_files.Keys, "hashes", lambda self, seed: honest(self, seed) if seed >= 2 else np.zeros(len(self.nth), "<u8"))
    assert round_trip(keys_of([1, 2, 3])).seed == 2
    monkeypatch.setattr(token_files.Keys, "hashes", lambda self, seed: np.zeros(len(self.nth), "<u8"))
    with pytest.raises(ValueError, match="no perfect hash"):
        token_files.Index.build(keys_of([1, 2]), np.ones(2), "<u2")


def test_a_bucket_without_a_place_ends():
    assert token_files.perfect(np.array([7, 7], "<u8"), tries=100) is None


def test_index_of_a_million_documents():
    round_trip(keys_of(np.arange(1_000_000) * 3))


def test_token_files_round_trip(spark, monkeypatch):
    rows = [(9, "last words"), (1, "first words here"), (5, None), (5, "again five"), (None, "no key"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    got = token_files.token_files(df, BYTES).collect()
    library = Tokenizer.from_file(BYTES)
    want = sorted(((d, library.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in want]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((d or -1, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in want)
    assert token_files.token_files(df.limit(0), BYTES).count() == 0


def test_text_keys_and_lookup_by_key(spark, tmp_path):
    rows = [(f"k{i % 40:02d}", f"words of row {i}") for i in range(60)] + [(None, "no key"), ("", None)]
    df = spark.createDataFrame(rows, "name string, body string").repartition(3)
    folder, library = f"file://{tmp_path}/ids", Tokenizer.from_file(BYTES)
    manifest = token_files.write_token_files(df, BYTES, folder, key="name", text="body", shard_docs=7)
    got = token_files.read_token_files(spark, folder, manifest, df.schema["name"].dataType)
    assert sorted(r.doc_id or "" for r in got.collect()) == sorted(d or "" for d, _ in rows)
    for key in ("k03", "k30", ""):
        want = sorted(library.encode(t or "", add_special_tokens=False).ids + [0] for d, t in rows if d == key)
        assert sorted(x.tolist() for x in token_files.ids_of(folder, key)) == want
    assert token_files.ids_of(folder, "stranger") == []
    with pytest.raises(TypeError, match="integers or strings"):
        token_files.token_files(spark.range(2).selectExpr("id / 2 doc_id", "'' text"), BYTES)
