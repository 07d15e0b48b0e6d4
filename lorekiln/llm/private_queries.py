"""Queries of problem 8 over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm import private
from lorekiln.session import spread, table


def secret(spark: SparkSession) -> str:
    """The key of the surrogates, from the session; a deployment must set its own. Only test data are read without one."""
    return spark.conf.get("spark.lorekiln.surrogateKey", "key of the test data")


def public_names(spark: SparkSession, sf: str) -> list[str]:
    """Names of entities and aliases: tables of fixed size."""
    names = table(spark, sf, "entities").select("name").union(table(spark, sf, "entity_aliases").select("alias"))
    return [r[0] for r in names.where("name is not null").distinct().collect()]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of personal information, as their surrogates replace them."""
    return private.replacements(documents(spark, sf), public_names(spark, sf), secret(spark)).select("doc_id", "kind", "start_char").distinct()


def p8_masked(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with placeholders, and with surrogates."""
    return private.masked(documents(spark, sf), public_names(spark, sf), secret(spark))


def p8_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """For each document: whether a text without finds is as it was, and one with finds has their number of placeholders, none of
    which its surrogate form shows."""
    rows = p8_masked(spark, sf).join(documents(spark, sf).groupBy("doc_id").agg(F.max("text").alias("old")), "doc_id")
    marks = F.regexp_count("text", F.lit(r"\[(?:EMAIL|PHONE|ID|ADDRESS|NAME)\]"))
    same = F.col("text").eqNullSafe(F.col("old")) & F.col("surrogate_text").eqNullSafe(F.col("old"))
    kept = F.when(F.col("n_found") == 0, same).otherwise((marks >= F.col("n_found")) & (F.col("surrogate_text") != F.col("old")))
    return rows.select("doc_id", kept.alias("replaced"))


QUERIES = {f.__name__: f for f in (p8_found, p8_masked, p8_invariants)}
ORACLE_SQL: dict[str, str] = {"p8_invariants": "SELECT doc_id, true AS replaced FROM documents"}
