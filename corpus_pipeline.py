"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

language ID        documents without a letter, or whose text no learned language explains, go
exact dedup        of equal texts (A-Z lower-cased) the row with the largest doc_id stays
near dedup         of each component of near copies (5-word shingles, similarity 0.8) the smallest doc_id stays
decontamination    documents that hold a benchmark item go
mixing             the words each source gives to the training mix, a row for each reading, in the
                   order of training

Null texts and texts without a letter leave at the first stage, as do all documents where no row is
labelled (no language is learned then). Repeated rows leave as exact copies. Rows without an id pass
near dedup, link with nothing, and are kept. Extra columns are carried up to the last stage, under
whatever names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailtriage.llm import decontamination, exact_dedup, jaccard_join, language_id, mixing
from mailtriage.llm.common import discard, staged


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.readings(docs)


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: The language models and the similarity join have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table below sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
