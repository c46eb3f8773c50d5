"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from termloom.llm import sql
from termloom.llm.byte_bpe import round_trip
from termloom.llm.common import table
from termloom.llm.decontamination import decontaminate
from termloom.llm.html_extraction import extract_main_text
from termloom.llm.jaccard_join import jaccard_components
from termloom.llm.pii import find_pii
from termloom.llm.quality_classifier import classify
from termloom.llm.quality_rules import quality_rules
from termloom.llm.secret_scans import scan_secrets
from termloom.llm.token_counts import token_counts
from termloom.llm.warc import archive_round_trip

#: The vocabularies that measure fertility.
VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), [public_tokenizers.path(name) for name in VOCABULARIES])


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_html_extraction, op2_quality_rules, op3_secret_scans, op4_ngram_jaccard_join, op5_token_counts, op6_pii, op7_benchmark_decontamination, op8_byte_bpe, op9_warc, op10_quality_classifier)}


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; the others are tested against libraries, brute force or held-out labels."""
    return sql.oracle_sql()
