"""Queries over the test tables for the operators of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanmark.llm import history, language, mainbody, packing, personal, reading, residue, tokens, truncation
from gleanmark.sources.tables import table


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, folder, "documents"))


def p9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), table(spark, folder, "packing_limits"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return reading.demanding(table(spark, folder, "documents"), table(spark, folder, "reading_samples"))


def p10_levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading.reading_levels(table(spark, folder, "documents"), table(spark, folder, "reading_samples"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "content"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.mislabelled(table(spark, folder, "content")).distinct()


def p3_languages(spark: SparkSession, folder: str) -> DataFrame:
    return language.languages(table(spark, folder, "content")).distinct()


def p3_passages(spark: SparkSession, folder: str) -> DataFrame:
    return language.passages(table(spark, folder, "content")).distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return mainbody.boilerplate_lines(table(spark, folder, "content"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return history.repeats(table(spark, folder, "content"), table(spark, folder, "manifest"), table(spark, folder, "sites"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_values(table(spark, folder, "content"))


def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_shares(table(spark, folder, "content"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal.found(table(spark, folder, "content"))


def p7_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return personal.redacted(table(spark, folder, "content"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p3_languages": p3_languages,
    "p3_passages": p3_passages,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_shares": p6_shares,
    "p7_found": p7_found,
    "p7_redacted": p7_redacted,
    "p8_ids": p8_ids,
    "p9_packing": p9_packing,
    "p10_found": p10_found,
    "p10_levels": p10_levels,
}
SQL: dict[str, str] = {}
