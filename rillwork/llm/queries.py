"""Registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillwork.llm import oracles
from rillwork.llm.collocations import collocations
from rillwork.llm.common import read_table
from rillwork.llm.decontaminate import decontamination_report
from rillwork.llm.hard_negatives import hard_negatives_report
from rillwork.llm.html_extract import extract_text
from rillwork.llm.language import language_report
from rillwork.llm.line_dedup import line_dedup_report
from rillwork.llm.mixing import mixing_report
from rillwork.llm.near_dedup import near_dedup_report
from rillwork.llm.quality import quality_report
from rillwork.llm.quality_rules import rules_report
from rillwork.llm.substring_dedup import substring_dedup_report
from rillwork.llm.vector_search import top_k_report
from rillwork.llm.warc import archive_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing_report(read_table(spark, folder, "documents"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup_report(read_table(spark, folder, "documents"))


def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(read_table(spark, folder, "pages"))


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup_report(read_table(spark, folder, "documents"))


def op5_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k_report(read_table(spark, folder, "embeddings"))


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup_report(read_table(spark, folder, "documents"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_report(read_table(spark, folder, "documents"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archive_round_trip(read_table(spark, folder, "pages"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination_report(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_report(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules_report(read_table(spark, folder, "documents"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(read_table(spark, folder, "documents"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives_report(read_table(spark, folder, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_line_dedup, op3_html_extraction, op4_substring_dedup, op5_top_k, op6_near_dedup,
        op7_language_id, op8_warc, op9_decontamination, op10_quality, op11_quality_rules, op12_collocations,
        op13_hard_negatives,
    )
}
ORACLES: dict[str, str] = {
    "op1_mixing": oracles.MIXING,
    "op2_line_dedup": oracles.LINE_DEDUP,
    "op4_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op5_top_k": oracles.TOP_K,
    "op6_near_dedup": oracles.NEAR_DEDUP,
    "op8_warc": oracles.WARC,
    "op9_decontamination": oracles.DECONTAMINATION,
    "op11_quality_rules": oracles.QUALITY_RULES,
    "op12_collocations": oracles.COLLOCATIONS,
    "op13_hard_negatives": oracles.HARD_NEGATIVES,
}
