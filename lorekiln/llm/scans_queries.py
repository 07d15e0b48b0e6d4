"""Queries of problem 1 over the whole chunks table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekiln.llm import scans
from lorekiln.session import spread, table


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "chunks").select("id", "file_path", "chunk_index", "text"), "id")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of scanning noise by line."""
    return scans.defects(chunks(spark, sf))


def p1_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Scanned chunks as continuous paragraphs."""
    return scans.repaired(chunks(spark, sf))


QUERIES = {f.__name__: f for f in (p1_found, p1_repaired)}
ORACLE_SQL: dict[str, str] = {}
