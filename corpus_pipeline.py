"""A training corpus from raw documents: quality, exact and near duplicates, source weights, token ids.

Every stage takes null ids, texts, languages and sources, empty and very long texts, repeated rows, an empty table and
extra columns of any name (which it leaves out): null texts count as empty, rows that are equal throughout are copies of
each other of which one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feria.llm import common, mixing, near_dedup, pieces, quality, stream_dedup

#: The columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject."""
    common.tune(spark)
    return quality.without_rejected(docs.select(*COLUMNS), quality.trusted_labels(spark, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents the one with the largest id."""
    return stream_dedup.distinct(docs.select(*COLUMNS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents the one with the least id."""
    common.tune(spark)
    return near_dedup.one_of_each(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that all sources weigh the same, in a random order."""
    return mixing.mix(docs.select(*COLUMNS)).select("doc.*")


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each document the number of its pieces, and checksums of its ids and of the text decoded from them."""
    return pieces.report(docs.select(*COLUMNS))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("source mixing", mixing_stage),
    ("SentencePiece", tokens_stage),
]
#: SQL cannot express the model or the signatures; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again. A stage's file goes when the next is written."""
    docs, last = common.load(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
        common.discard(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
