"""The registered queries of this subpackage: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import bpe, exact_dedup, jaccard_join, language_id, license_scan, mixing, quality_classifier, quality_rules, token_counts, url_filter
from helixframe.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).drop("text_md5", "component")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def base_of_op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 computes before the method's verdict."""
    return quality_rules.base_rules(table(spark, sf_dir, "documents")).drop("w")


def base_of_op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 computes before the method's verdict."""
    rows = url_filter.with_rule(url_filter.lexical(table(spark, sf_dir, "pages")), url_filter.RULES)
    return rows.select("page_id", "host", "path", "rule", "rule_verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_url_filter": op4_url_filter,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_license_scan": op6_license_scan,
    "op7_mixing": op7_mixing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_language_id": op9_language_id,
    "op10_exact_dedup": op10_exact_dedup,
    "base_of_op3": base_of_op3,
    "base_of_op4": base_of_op4,
}

ORACLES: dict[str, str] = {
    "base_of_op3": quality_rules.BASE_ORACLE,
    "base_of_op4": url_filter.RULES_ORACLE,
    "op5_jaccard_join": jaccard_join.ORACLE,
    "op6_license_scan": license_scan.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
