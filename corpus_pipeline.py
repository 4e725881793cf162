"""The corpus pipeline: documents in, digests of encoded training documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import bpe, exact_dedup, jaccard_join, language_id, mixing
from helixframe.llm.common import settle, workspace


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in no language go."""
    return language_id.keep_identified(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.keep_first(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays."""
    return jaccard_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents enter as often as their source's target asks for."""
    return mixing.mixture(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text."""
    return bpe.encode_decode(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("jaccard_join", jaccard_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: Prototypes, components and samples can't be expressed in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
