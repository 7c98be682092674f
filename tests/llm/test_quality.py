import itertools
import random
from collections import Counter

import numpy as np
import pytest

from rollbook.llm import queries
from rollbook.llm import quality_classifier as qc
from rollbook.llm import quality_rules as qr
from rollbook.llm.lines import FEATURES, measured


def slow_counts(text):
    words = [w.decode() for w in text.encode().split()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(x.encode().split()) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def slow_features(text):
    """Lines with a word: features by their definitions, and bytes in words."""
    rows, seen = [], set()
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    for i, line in enumerate(lines):
        words = line.split()
        solid = b"".join(words)
        n = len(solid)
        share = lambda f: sum(map(f, solid)) / n  # noqa: B023, E731
        up, low = sum(65 <= c <= 90 for c in solid), sum(97 <= c <= 122 for c in solid)
        rows.append((1, share(lambda c: c in b"#*$%&|<>"), up / max(1, up + low), share(lambda c: c in b"!|{}[]\\~^_=@"), share(lambda c: 48 <= c <= 57), len(words) < 3, line in seen, words[-1][-1:] in (b".", b"?", b":"), min(1.0, n / len(words) / 40), sum(x == y for x, y in zip(words, words[1:])) / len(words), i == 0, i == len(lines) - 1, np.log2(1 + len(words)) / 8))
        seen.add(line)
    return np.array(rows, float).reshape(-1, len(FEATURES)), [len(b"".join(x.split())) for x in lines]


def odd_texts(n):
    r = random.Random(6)
    return ["".join(r.choice(["a", "b", "é", " ", " ", "\n", "\n", "#", "|", "\t", "\x0b", "\u00a0", "B", "7", "a a a", "."]) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_counts_match_their_definition():
    texts = [*odd_texts(400), "", "\n", "a b c " * 900, "\n\n x \n\n"]
    got = measured([t.encode() for t in texts])
    for t, row in zip(texts, got.counts.tolist(), strict=True):
        assert tuple(row) == slow_counts(t)
    assert measured([]).counts.shape == (0, 5)
    many = " ".join(map(str, range(2100))) + " 1 2 3"
    assert tuple(measured([many.encode()]).counts[0].tolist()) == slow_counts(many)


def test_line_features_match_their_definition():
    texts = odd_texts(300)
    got = measured([t.encode() for t in texts])
    for t, a, b in zip(texts, got.bounds, got.bounds[1:], strict=False):
        x, sizes = slow_features(t)
        assert np.allclose(got.x[a:b], x, atol=1e-6) and got.sizes[a:b].tolist() == sizes


def test_viterbi_finds_the_best_path():
    r = np.random.default_rng(2)
    for n in (1, 2, 5):
        score, move = r.normal(size=n), tuple(map(tuple, r.normal(size=(2, 2))))
        value = lambda y: sum(score[i] for i in range(n) if y[i]) + sum(move[a][b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert value(qr.viterbi(score, move)) == max(map(value, itertools.product((0, 1), repeat=n)))
    assert qr.viterbi(np.zeros(0), ((0, 0), (0, 0))) == []


def lines_of(text):
    return measured([text.encode()])


def share(text, crf):
    return float(qr.content_shares(lines_of(text), crf)[0])


def test_crf_learns_lines():
    good, bad = "Some plain words stand here in a row.", "### *** | | $$$ BUY!! NOW!!"
    r = random.Random(1)
    sequences = []
    for _ in range(60):
        y = [int(r.random() < 0.4)] * 3 + [int(r.random() < 0.4)] * 3
        sequences.append((lines_of("\n".join(bad + str(i) if v else good + str(i) for i, v in enumerate(y))).x, np.array(y)))
    crf = qr.fit(sequences)
    assert share(good + "\n" + good + "!", crf) == 1.0
    assert share(bad + "\n" + bad + "!", crf) == 0.0


def test_gradient_sums_match_enumeration():
    r = np.random.default_rng(3)
    s, move = np.stack([np.zeros((1, 4)), r.normal(size=(1, 4))], 2), r.normal(size=(2, 2))
    s[0, 2, 0] = -1e6  # a labelled line
    p, moves = qr.sums(s, np.ones((1, 4), bool), move)
    paths = list(itertools.product((0, 1), repeat=4))
    w = np.exp([sum(s[0, i, v] for i, v in enumerate(y)) + sum(move[a, b] for a, b in zip(y, y[1:])) for y in paths])
    w /= w.sum()
    assert np.allclose(p[0], [sum(x for x, y in zip(w, paths) if y[i]) for i in range(4)])
    assert np.allclose(moves, [[sum(x * sum((a, b) == z for z in zip(y, y[1:])) for x, y in zip(w, paths)) for b in (0, 1)] for a in (0, 1)])


def mixed_document(r, bad_lines):
    """Prose with boilerplate lines in one block, and the label of each line."""
    words = ["river", "stone", "walks", "under", "a", "quiet", "green", "hill", "and", "they", "sing"]
    prose = [" ".join(r.choice(words) for _ in range(r.randint(9, 25))).capitalize() + "." for _ in range(8)]
    junk = [r.choice(["Home | Shop | Cart | Help | %d", "### $$$ *** %d &&&", "SIGN UP NOW!! TODAY!! %d", "more more more more more %d"]) % r.randint(0, 999) for _ in range(bad_lines)]
    at = r.randint(0, 8)
    return "\n".join(prose[:at] + junk + prose[at:]), [0] * at + [1] * bad_lines + [0] * (8 - at)


def test_planted_boilerplate_lines_are_found(spark):
    r = random.Random(8)
    made = [mixed_document(r, r.randint(0, 6)) for _ in range(120)] + [mixed_document(r, 40) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(sum(y) < 20)) for i, (_, y) in enumerate(made)], "doc_id long, quality int")
    crf = qr.learn_crf(docs, labels)
    fresh = [mixed_document(r, r.randint(1, 12)) for _ in range(100)]
    got = np.concatenate([qr.marks(lines_of(t), crf) for t, _ in fresh])
    want = np.concatenate([y for _, y in fresh])
    assert (got & want).sum() / got.sum() > 0.95 and (got & want).sum() / want.sum() > 0.95
    shares = [share(t, crf) for t, _ in fresh]
    assert sum(0 < x < 1 for x in shares) > 90
    kept = qr.content_documents(spark.createDataFrame([(1, fresh[0][0]), (2, None)], "doc_id long, text string"), crf).collect()
    assert kept[1].text is None and kept[0].text == "\n".join(x for x, y in zip(fresh[0][0].split("\n"), qr.marks(lines_of(fresh[0][0]), crf)) if not y)


def test_lines_that_repeat_over_documents_are_boilerplate():
    body = [[1000 + 10 * d + k for k in range(4)] for d in range(8)]
    copies = [[1, 2, 3, 4]] * 9  # of one document: not lines that repeat over documents
    spread = [[*b[:d % 4], 77, *b[d % 4 :]] for d, b in enumerate(body)]
    assert qr.common_lines([np.array(x, "<u8") for x in copies + spread]) == {77}
    assert qr.common_lines([]) == set()
    x = measured([b"Plain words here.\n### $$$ %%%\nMore plain words."]).x
    assert qr.weak_labels(x, np.array([False, False, True]), 1).tolist() == [0, 1, 1]
    assert qr.weak_labels(x, np.array([False, False, False]), 0).tolist() == [-1, 1, -1]


def test_query_matches_a_slow_version(spark):
    """op5 over all of sf0.001, line by line and with every rule by its definition."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    crf = qr.learn_crf(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = queries.op5_quality_rules(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        counts = slow_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        x, sizes = slow_features(texts[r.doc_id])
        best = [(0.0, ())]  # value and path by last label
        for i, row in enumerate(x.astype(np.float32) @ np.array(crf.emit)):
            best = [max((v + (crf.move[p[-1]][y] if i else 0) + y * row, (*p, y)) for v, p in best) for y in (0, 1)]
        path = max(best)[1] if len(x) else ()
        content = sum(n for n, y in zip(sizes, path) if not y) / max(1, sum(sizes))
        assert r.base_failed == failed and r.content_share == pytest.approx(content) and r.kept == (not failed and content >= 0.5)


def test_rules_edges(spark):
    long = " ".join(f"word{i}" for i in range(80)) + "."
    df = spark.createDataFrame([(1, long, "x"), (2, None, "x"), (3, "", "x"), (None, long, "x"), (1, long, "x")], "doc_id long, text string, kept string")
    got = [(r.doc_id, r.n_words, r.base_failed, r.kept) for r in qr.quality_rules(df, qr.UNTRAINED).collect()]
    assert sorted(got, key=str) == sorted([(1, 80, False, True), (2, 0, True, False), (3, 0, True, False), (None, 80, False, True), (1, 80, False, True)], key=str)
    assert qr.kept_documents(df, qr.UNTRAINED).count() == 3
    assert qr.quality_rules(df.limit(0), qr.UNTRAINED).count() == 0
    assert qr.learn_crf(df, spark.createDataFrame([], "doc_id long, quality int")) == qr.UNTRAINED


def test_weak_labels_recover_accuracies():
    r = np.random.default_rng(4)
    junk = r.random(4000) < 0.2
    acc = (0.95, 0.8, 0.9, 0.7)
    votes = np.stack([np.where(r.random(4000) < a, np.where(junk, -1, 1), np.where(junk, 1, -1)) * (r.random(4000) < 0.8) for a in acc], 1)
    patterns, at, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    table, share, q = qc.expectation_maximisation(patterns, n.astype(float))
    assert abs(share - 0.2) < 0.05
    assert np.allclose(table[:, 1, 0], acc, atol=0.08) and np.allclose(table[:, 0, 1], acc, atol=0.08)
    assert ((q[at.ravel()] > 0.5) == junk).mean() > 0.93


def test_classifier_agrees_with_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = qc.quality(docs, qc.learn_quality(docs)).join(labels, "doc_id").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.97
    assert got[got.quality == 1].kept.mean() > 0.98


def test_classifier_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "fine words here.", "z")], "doc_id long, text string, score string")
    model = qc.learn_quality(df)
    assert qc.quality(df, model).count() == 3
    assert qc.fine_documents(df, model).columns == df.columns
    empty = df.limit(0)
    assert qc.quality(empty, qc.learn_quality(empty)).count() == 0
    long = "ordinary words of a very long text, line by line.\n" * 20_000
    twice = spark.createDataFrame([(1, long, "x"), (1, long, "x"), (None, long, "y")], "doc_id long, text string, kept string")
    assert len({r.score for r in qc.quality(twice, model).collect()}) == 1 and qc.fine_documents(twice, model).columns == twice.columns


def test_crf_learns_from_whole_texts(spark):
    plain, junk = "an ordinary line of plain words, as they stand %d.\n", "## BUY | NOW ## CLICK | HERE ##\n"
    rows = [(1, "".join(plain % i for i in range(900)) + junk * 40), (2, junk * 30 + plain * 500), (3, plain * 10), (4, junk * 10), (4, junk * 10), (None, junk)]
    quality = [(1, 1), (2, 0), (3, 1), (4, 0), (4, 1), (None, 0), (9, None)]
    x = [(d, measured([t.encode()]).x) for d, t in rows if d]
    want = qr.fit([(f, qr.weak_labels(f, np.zeros(len(f), bool), int(d in (1, 3)))) for d, f in x])
    got = qr.learn_crf(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(quality, "doc_id long, quality int"))
    assert got.emit == pytest.approx(want.emit, abs=1e-3) and np.allclose(got.move, want.move, atol=1e-3)


def test_very_long_text(spark):
    text = "\n".join(f"line {i} of a very long text, with words." for i in range(60_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = qr.quality_rules(df, qr.UNTRAINED).first()
    assert (r.n_words, r.n_dup_lines, r.kept) == (9 * 60_000, 0, False) and r.n_repeat_words > 0


def slow_junk(scorer, raw):
    """The linear scorer feature by feature."""
    if len(raw) < 3:
        return 1 / (1 + np.exp(-scorer.bias))
    shape = [int(qc.SHAPE[b]) for b in raw]
    features = [(a * 1024 + b * 32 + c) % 0x7FFF for a, b, c in zip(shape, shape[1:], shape[2:])]
    features += [((((a << 8 | b) * 2654435761) & 0xFFFFFFFF) >> 17) + (1 << 15) for a, b in zip(raw, raw[1:])]
    words = raw.split()
    features += [qc.STUTTER] * 5 * sum(a == b for a, b in zip(words, words[1:]))
    x = scorer.bias + 40 / len(raw) * sum(float(scorer.weights[f]) for f in features)
    return 1 / (1 + np.exp(-min(35, max(-35, x))))


def test_classifier_query_matches_a_slow_version(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = qc.learn_quality(docs)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = queries.op3_quality(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        fine = 1 - slow_junk(model.scorer, texts[r.doc_id])
        assert abs(r.score - fine) < 1e-4 and r.kept == (r.score >= 0.5)


def test_repetition_is_judged_alike_at_any_length():
    r = random.Random(2)
    words = [f"word{k}" for k in range(300)]
    prose, junk = lambda n: " ".join(r.choice(words) for _ in range(n)), lambda n: " ".join(r.choice(words[:3]) for _ in range(n))
    at = qc.LABELLERS.index("repeats")
    for n in (60, 500, 5000, 50_000):
        assert qc.votes(junk(n).encode())[at] == -1 and qc.votes(prose(n).encode())[at] == 1
    a = ["x", "y", "x", "z"] * 40
    assert qc.repeats([w.encode() for w in a]) == pytest.approx(1 - (3 + 3 + 3) / 160)
    assert qc.repeats([]) == 0
