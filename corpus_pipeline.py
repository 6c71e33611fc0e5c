"""Corpus pipeline: five stages from raw documents to token files.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. All but the last keep the columns
of ``documents``. An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import decontaminate, mixing, quality_rules, simhash, token_files
from skein.plans.scratch import discard, materialise
from skein.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict don't reject."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies."""
    return simhash.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources repeated towards their target weights."""
    return mixing.keep_mixed(docs, max_repeat=2.0, cover=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document in the token files."""
    return token_files.round_trip(docs, token_files.default_tokenizer())


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture), ("tokens", tokens)]

#: SQL has neither the fingerprints' links nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        read, docs = docs, materialise(stage(spark, docs, sf_dir), "stage")
        discard(read)  # the next stage reads what this one kept
    return STAGES[-1][1](spark, docs, sf_dir)
