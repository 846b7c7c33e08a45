"""The registered queries of the training-data operators, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import conversation_repair, decontamination, filter_audit, hilbert_shards, license_scan, nbest_pieces, quality_classifier, quality_rules, secret_scan, simhash_dedup, substring_dedup, token_counts, url_filter
from panelspark.llm.common import small_batches, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    small_batches(spark)
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that stand in windows of 35 found more than once."""
    small_batches(spark)
    return substring_dedup.dedup_report(table(spark, sf_dir, "documents"), window=35)


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards along the curve."""
    return hilbert_shards.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license notices in all documents."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a classifier fitted on the labels that may be used."""
    small_batches(spark)
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the best and the four best segmentations."""
    small_batches(spark)
    return nbest_pieces.segment(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), n=4)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged by the standing rules."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by linked fingerprints of three-word shingles."""
    small_batches(spark)
    return simhash_dedup.group_documents(table(spark, sf_dir, "documents"), shingle=3, distance=2)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the base rules and their distance from their language."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the windows of 13 words that they share with the benchmark."""
    return decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return conversation_repair.repair_report(table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents, in every order."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, by the base patterns and by inferred formats."""
    small_batches(spark)
    return secret_scan.scan(table(spark, sf_dir, "documents")).drop("added")


OPERATORS = (op1_token_counts, op2_substring_dedup, op3_hilbert_shards, op4_license_scan, op5_quality_classifier, op6_nbest_pieces, op7_url_filter, op8_simhash_dedup, op9_quality_rules, op10_decontamination, op11_conversation_repair, op12_filter_audit, op13_secret_scan)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> function of (spark, sf_dir)."""
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL."""
    return {"op4_license_scan": license_scan.oracle(), "op7_url_filter": url_filter.oracle(), "op9_quality_rules": quality_rules.oracle(), "op10_decontamination": decontamination.oracle(), "op11_conversation_repair": conversation_repair.oracle(), "op12_filter_audit": filter_audit.oracle()}
