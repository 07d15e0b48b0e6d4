"""Queries of problem 2 over all chunks of bilingual works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm import bitext
from lorekiln.session import table


def glossary(spark: SparkSession, sf: str) -> list[tuple[str, str]]:
    """Known pairs of terms, from tables of fixed size: the concept bridge, and entities with their Spanish aliases."""
    bridge = table(spark, sf, "concept_bridge").select("term_en", "term_es")
    names = table(spark, sf, "entities").select(F.col("id").alias("entity_id"), "name").join(table(spark, sf, "entity_aliases").where("language = 'es'"), "entity_id").select("name", "alias")
    return [(r[0], r[1]) for r in bridge.union(names).collect()]


def p2_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence pairs with their similarity."""
    pairs = bitext.alignment(table(spark, sf, "chunks"), table(spark, sf, "document_parallels"), glossary(spark, sf))
    return pairs.withColumn("similarity", F.round("similarity", 4))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence pairs that translate each other wholly or in part."""
    return p2_alignment(spark, sf).drop("similarity")


QUERIES = {f.__name__: f for f in (p2_found, p2_alignment)}
ORACLE_SQL: dict[str, str] = {}
