"""The corpus pipeline: language, exact and near copies, mixture, packed sequences.

Every stage is a function of (spark, docs, sf_dir); all but the last return documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftspark.llm import exact_dedup, language, mixing, packing, simhash
from driftspark.llm.common import owned_tables, stored_at


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or between two, go: null and empty texts and those without
    a letter among them. Other columns pass as they are, equal rows alike."""
    return language.identified_documents(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that differ in the case of A-Z at most stays, the one with
    the largest doc_id (nulls smallest); null texts are empty ones."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id. Texts without a word
    are a group."""
    return simhash.distinct_documents(docs, width=simhash.SHINGLE, radius=simhash.RADIUS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weights: rows repeat up to three times, the one at a source's budget is
    cut there, those without a word go."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, in sequences of at most 2048 tokens; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Trained classifiers, XXH64 fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``.

    A stage's tables, and what it read, go when its result is written; those of the last stage
    stay, as its result is read from them.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with owned_tables(spark, *before):
            docs, path = stored_at(stage(spark, docs, sf_dir), f"stage-{name}")
        before = [path]
    packed = STAGES[-1][1](spark, docs, sf_dir)
    with owned_tables(spark, *before):
        return packed
