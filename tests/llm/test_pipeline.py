import corpus_pipeline
import __spark_entry__


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at, counts = docs, [docs.count()]
    from rollbook.llm.common import stored

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, at, sf), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        counts.append(out.count())
        at = out
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4]
    last = corpus_pipeline.STAGES[-1][1](spark, at, sf)
    assert last.select("doc_id").distinct().count() == counts[-1]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = at.join(labels, "doc_id")
    assert kept.where("quality = 0").count() <= 2


def test_pipeline_against_brute_force(spark):
    """run() keeps the documents that plain Python keeps, and packs exactly the ids of their redacted texts."""
    import re
    from collections import Counter

    import public_tokenizers
    from tokenizers import Tokenizer

    from rollbook.llm import decontamination, quality_classifier, secrets
    from tests.llm.test_simhash import slow_components, slow_fingerprint

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = quality_classifier.learn_quality(docs)
    rows = {r.doc_id: r.text for r in docs.collect() if 1 - model.scorer.junk((r.text or "").encode()) >= 0.5}
    fps = {d: slow_fingerprint(t or "") for d, t in rows.items()}
    root = slow_components(sorted(set(fps.values())), 4)
    least: dict = {}
    for d in sorted(rows):
        least.setdefault(root[fps[d]], d)
    rows = {d: rows[d] for d in least.values()}
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    def leaks(text: str) -> bool:
        words = split(text)
        at: dict = {}
        for k, w in enumerate(words):
            at.setdefault(w, []).append(k)
        for x in bench:
            own = split(x)
            n, need = min(decontamination.WINDOW, len(own)), decontamination.needed(len(own))
            for diagonal, hits in Counter(k - j for j, w in enumerate(own) for k in at.get(w, [])).items():
                if hits >= need:
                    same = [0 <= j + diagonal < len(words) and own[j] == words[j + diagonal] for j in range(len(own))]
                    if any(sum(same[s : s + n]) >= need for s in range(len(own) - n + 1)):
                        return True
        return False

    rows = {d: t for d, t in rows.items() if not leaks(t)}
    kept = spark.createDataFrame([(d, t) for d, t in rows.items()], "doc_id long, text string")
    formats = secrets.learn_formats(kept)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: len(library.encode(secrets.redact((t or "").encode(), secrets.scan([(t or "").encode()], formats)[0]).decode(), add_special_tokens=False).ids) + 1 for d, t in rows.items()}
    got = corpus_pipeline.run(spark, sf).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id: r["sum(length)"] for r in got} == want == {r.doc_id: r["max(doc_tokens)"] for r in got}
