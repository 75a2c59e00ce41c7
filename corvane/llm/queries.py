"""The registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate, jaccard_join, license_scan, mixing, oracle, pii, quality_model, quality_rules, sharding, token_counts, url_filter
from corvane.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_digest(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_model_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_digest(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as label:first word:last word:errors, comma-joined in the order found."""
    one = lambda s: F.concat_ws(":", s["label"], s["first_word"], s["last_word"], s["errors"])
    return license_scan.license_digest(table(spark, sf_dir, "documents")).withColumn("spans", F.array_join(F.transform("spans", one), ","))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_sharding": op2_sharding,
    "op3_mixing": op3_mixing,
    "op4_url_filter": op4_url_filter,
    "op5_quality_model": op5_quality_model,
    "op6_token_counts": op6_token_counts,
    "op7_quality_rules": op7_quality_rules,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontamination": op9_decontamination,
    "op10_license_scan": op10_license_scan,
    "pipeline": pipeline,
}
ORACLE_SQL: dict[str, str] = {
    "op1_pii": oracle.PII,
    "op7_quality_rules": oracle.QUALITY_RULES,
    "op8_jaccard_join": oracle.JACCARD_JOIN,
    "op9_decontamination": oracle.DECONTAMINATION,
}
