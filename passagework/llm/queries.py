"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import articles, collocations, fingerprints, jaccard, language, licenses, matroska, mixing, packing, pii, quality, secrets, turns
from .common import table


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.scan(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(table(spark, sf_dir, "documents")))


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digest(matroska.store(table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.digest(table(spark, sf_dir, "pages"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.digest(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.digest(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_license_scans, op2_multiset_fingerprints, op3_source_mixing, op4_secret_scans, op5_pii, op6_matroska,
        op7_language_id, op8_best_fit_packing, op9_jaccard_join, op10_quality_classifier,
        op11_html_extraction, op12_phrase_collocations, op13_conversation_repair,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The others have no SQL: models, parsers, hashes and searches; tests/llm holds each against
    brute force, a round trip or held-out accuracy."""
    return {"op12_phrase_collocations": collocations.SQL}
