"""Queries p8 to p10 on the documents table, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.leakage import template_leaks, verbatim_leaks
from tallyforge.llm.residue import find_residue
from tallyforge.llm.tokenize import decode_corpus, encode_corpus
from tallyforge.sources.tables import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text back from its ids."""
    return decode_corpus(p8_ids(spark, d), "doc_id", "ids")


def _both(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text"


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return verbatim_leaks(*_both(spark, d))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Verbatim and re-parameterised items in documents."""
    return template_leaks(*_both(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(table(spark, d, "documents"), "doc_id", "text").select("doc_id").distinct()


def p10_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What each document concerned holds, and how much of it."""
    return find_residue(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.array_join("kinds", ",").alias("kinds"), F.round("coverage", 4).alias("coverage"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_kinds": p10_kinds}

ORACLE: dict[str, str] = {"p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
