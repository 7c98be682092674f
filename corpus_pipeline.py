"""A training corpus from documents: quality, near-duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before it kept. A null text counts as an empty
one and stays null; null keys are keys like others; all columns of docs come through whatever their names, but for the last
stage, which returns pieces; an empty table gives an empty one. Equal rows get equal answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollbook.llm import decontamination, packing, quality_classifier, secrets, simhash
from rollbook.llm.common import stored
from rollbook.llm.queries import table, vocabulary


def keep_fine(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on weak labels of docs, does not reject; repeated rows stay repeated."""
    return quality_classifier.fine_documents(docs, quality_classifier.learn_quality(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least key; of repeated rows one."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark; an empty benchmark drops none."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found credentials replaced by their kind, n_chars counted anew."""
    return secrets.redacted_documents(docs, secrets.learn_formats(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence; an empty text is one piece, its end."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", keep_fine), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("packing", pack_sequences)]

#: No stage's decisions can be stated in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
