import zlib

import numpy as np

from rollbook.llm import language_id as li
from rollbook.llm import toxicity as tx


def test_gradients_are_the_differences():
    net = li.Network.random(["a", "b", "c"], 3)
    for n in net.NAMES:
        setattr(net, n, getattr(net, n).astype(np.float64))
    r = np.random.default_rng(0)
    codes, label = r.integers(97, 103, (9, 5)), np.array([0, 1, 2, 1, 0])

    def exact(d, codes, keep=None):
        return li.run_direction(net, d, codes, keep)

    loss, g = li.gradients(net, codes, label)
    for name in net.NAMES:
        w = getattr(net, name)
        at = (0, 98, 2) if name in ("gate", "cand") else tuple(0 for _ in w.shape)
        eps = 1e-2
        old = w[at]
        w[at] = old + eps
        up = li.gradients(net, codes, label)[0]
        w[at] = old - eps
        down = li.gradients(net, codes, label)[0]
        w[at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-3, name


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = li.identify(docs, li.learn_languages(docs, per_language=60)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_edges(spark):
    net = li.train([(b"the cat and the dog", "en"), (b"le chat et le chien", "fr")] * 3, steps=5)
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 34 !", "x"), (4, "the cat", "x"), (None, "日本", "x")], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r for r in li.identify(df, net).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[4].lang_pred in ("en", "fr") and got[None].lang_pred in ("en", "fr")
    assert li.identify(df.limit(0), net).count() == 0
    nothing = li.learn_languages(df.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in li.identify(df, nothing).collect()} == {"und"}


def test_ftrl_is_sparse_and_right():
    r = np.random.default_rng(1)
    examples = []
    for k in range(3000):
        y = int(k % 10 == 0)
        x = np.unique(np.concatenate((r.integers(1000, 1 << 20, 60), [7] if y else [11])))
        examples.append((x, y))
    model = tx.ftrl(examples)
    w = model.dense()
    assert w[7] > 0 and len(model.features) < 3000
    assert np.mean([(tx.probability(float(w[x].sum()) + model.bias) >= 0.5) == y for x, y in examples]) > 0.99


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = tx.toxicity(docs, tx.learn_toxicity(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert got[got.toxic == 0].predicted.mean() < 0.02
    assert got[got.toxic == 1].predicted.mean() > 0.6


def test_toxicity_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (2, "", "x")], "doc_id long, text string, score string")
    model = tx.learn_toxicity(df, spark.createDataFrame([], "doc_id long, toxic int"))
    got = tx.toxicity(df, model).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    assert tx.toxicity(df.limit(0), model).count() == 0


def slow_language(net, raw):
    """Mean class probabilities over a text's letters, byte by byte; each byte's window is read from its margin on."""
    width, totals, letters = li.WINDOW + 2 * li.MARGIN, np.zeros(len(net.languages)), 0
    padded = bytes(li.MARGIN) + raw + bytes(width)
    for a in range(0, len(raw), li.WINDOW):
        window, states = padded[a : a + width], [[None] * width, [None] * width]
        for d, order in ((0, range(width)), (1, reversed(range(width)))):
            h = np.zeros(li.HIDDEN)
            for t in order:
                z = np.clip((net.gate[d, window[t]] + h @ net.u_gate[d]) / 4 + 0.5, 0, 1)
                b = net.cand[d, window[t]] + h @ net.u_cand[d]
                h = h + z * (b / (1 + np.abs(b)) - h)
                states[d][t] = h
        for t in range(li.MARGIN, li.MARGIN + li.WINDOW):
            if li.LETTER[window[t]]:
                s = np.concatenate((states[0][t], states[1][t])) @ net.out + net.bias
                p = np.exp(s - s.max())
                totals += p / p.sum()
                letters += 1
    return totals / max(1, letters)


def test_language_query_matches_a_slow_version(spark):
    from rollbook.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = li.learn_languages(docs)
    texts = {r.doc_id: (r.text or "") for r in docs.collect()}
    got = queries.op1_language(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    compared = 0
    for r in got:
        t = texts[r.doc_id]
        if not any(map(str.isalpha, t)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif len(t) < 2500:  # the slow one takes long
            p = slow_language(net, t.encode())
            assert r.lang_pred == net.languages[p.argmax()] and abs(r.score - p.max()) < 1e-4
            compared += 1
    assert compared > 100


def test_windows_cover_long_texts():
    raw = bytes(np.random.default_rng(3).integers(97, 123, 1000).astype(np.uint8))
    w = li.windows(raw)
    assert w.shape == (8, li.WINDOW + 2 * li.MARGIN)
    assert w[:, li.MARGIN : li.MARGIN + li.WINDOW].tobytes().rstrip(b"\0") == raw
    assert w[3, : li.MARGIN].tobytes() == raw[3 * li.WINDOW - li.MARGIN : 3 * li.WINDOW]
    assert li.windows(b"").shape[0] == 0
    net = li.train([(b"the cat and the dog", "en"), (b"le chat et le chien", "fr")] * 3, steps=5)
    long = b"the cat and the dog sat here. " * 20_000
    got = li.document_scores(net, [long, b"", b"x"])
    assert abs(got[0].sum() - 1) < 1e-3 and got[1].sum() == 0
    assert np.allclose(li.document_scores(net, [long[:300]])[0], slow_language(net, long[:300]), atol=1e-5)


def slow_features(raw):
    """Hashed words, pairs and skip-pairs, with Python's integers."""
    from rollbook.llm import hashing as h

    most = (1 << 64) - 1

    def stirred(x):
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & most
        return x ^ x >> 32

    words, word = [], []
    for b in [*raw, 0]:
        if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 0x80:
            word.append(b + 32 if 65 <= b <= 90 else b)
        elif word:
            words.append(stirred(sum(int(h.VALUES[c]) * int(h.POWERS[i % 4096]) for i, c in enumerate(word)) & most))
            word = []
    pairs = [stirred((a * int(h.ODD) + b) & most) for a, b in zip(words, words[1:])]
    skips = [stirred((a * int(h.ODD) + 3 * b) & most) for a, b in zip(words, words[2:])]
    return {x >> 64 - tx.BITS for x in words + pairs + skips}


def test_toxicity_query_matches_a_slow_version(spark):
    from rollbook.llm import queries

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = tx.learn_toxicity(docs, labels)
    weights = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = queries.op9_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        x = model.bias + sum(weights.get(f, 0.0) for f in slow_features(texts[r.doc_id]))
        assert abs(r.score - tx.probability(x)) < 1e-5 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_very_long_and_repeated_texts(spark):
    long = "some ordinary words of a long text " * 30_000
    df = spark.createDataFrame([(1, long, 0), (1, long, 0), (2, "you fool", 1), (3, "fine words", 0)], "doc_id long, text string, toxic int")
    model = tx.learn_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = tx.toxicity(df, model).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id == 1}) == 1
    assert abs(got[0].score - got[1].score) == 0
