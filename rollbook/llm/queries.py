"""The operators as queries over whole tables, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import alignment, decontamination, language_id, lexical, lm_scoring, oracles, packing, quality_classifier, quality_rules, secrets, simhash, token_files, toxicity, vector_graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn_languages(docs))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_corpus(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.quality(docs, quality_classifier.learn_quality(docs))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.secret_spans(docs, secrets.learn_formats(docs))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.learn_crf(docs, table(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels")))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_corpus(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    return lexical.search(index, table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def lm_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2: its counts and the unigram's score."""
    return op2_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def secret_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4: the pattern matches."""
    return op4_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def rule_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op5: the counted rules."""
    return op5_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The operators, and the columns of three of them that SQL can check.

    All read whole tables. Null texts count as empty, null keys are carried along, repeated rows are answered as often as
    they occur (op6: once), empty tables give empty results; ties and very long texts are the operators' affair, whose
    docstrings say what they do.
    """
    made = (op1_language, op2_lm_score, op3_quality, op4_secrets, op5_quality_rules, op6_decontamination, op7_packing, op8_simhash, op9_toxicity, op10_token_files, op11_embedding_graph, op12_alignment, op13_lexical_search, lm_base_columns, secret_base_columns, rule_base_columns)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": oracles.DECONTAMINATION, "op13_lexical_search": oracles.LEXICAL, "lm_base_columns": oracles.LM_BASE, "secret_base_columns": oracles.SECRET_BASE, "rule_base_columns": oracles.RULE_BASE}
