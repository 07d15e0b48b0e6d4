"""Queries of problem 5 over the whole table of chunk embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm import neighbours
from lorekiln.session import table


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunk_embeddings").select("chunk_id", "embedding", "model_version")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of which one is among the other's 5 most similar, with a cosine of 0.90 or more."""
    near = neighbours.nearest(vectors(spark, sf), k=5, floor=0.90, target=0.99)
    return near.select(F.least("id", "other").alias("chunk_id_a"), F.greatest("id", "other").alias("chunk_id_b")).distinct()


def p5_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 most similar of every vector whose id is divisible by 100, against all vectors."""
    near = neighbours.nearest(vectors(spark, sf), k=10, target=0.95, is_query="id % 100 = 0")
    return near.select("model", F.col("id").alias("chunk_id"), "rank", F.col("other").alias("neighbour_id"), F.round("cos", 6).alias("cosine"))


def p5_recall(spark: SparkSession, sf: str) -> DataFrame:
    """One row: how many queries p5_nearest has, how many neighbours they have by brute force against all vectors, and whether it
    finds at least nine tenths of them."""
    near = p5_nearest(spark, sf).select("model", "chunk_id", "neighbour_id")
    true = neighbours.brute_force(vectors(spark, sf), k=10, is_query="id % 100 = 0").select("model", F.col("id").alias("chunk_id"), F.col("other").alias("neighbour_id"))
    both = true.join(near.withColumn("hit", F.lit(1)), ["model", "chunk_id", "neighbour_id"], "left")
    return both.agg(F.countDistinct("model", "chunk_id").alias("queries"), F.count("*").alias("neighbours"), (F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.count("*")).alias("recall_reached"))


#: Usable vectors as TESTDATA.md has them, one row for each id of a model.
_USABLE = """SELECT DISTINCT chunk_id, model_version FROM chunk_embeddings WHERE chunk_id IS NOT NULL AND model_version IS NOT NULL AND len(embedding) = 384
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"""

QUERIES = {f.__name__: f for f in (p5_found, p5_nearest, p5_recall)}
ORACLE_SQL: dict[str, str] = {
    "p5_recall": f"""WITH v AS ({_USABLE}), n AS (SELECT model_version, count(*) AS n FROM v GROUP BY 1)
SELECT count(*) AS queries, CAST(sum(least(10, n - 1)) AS BIGINT) AS neighbours, true AS recall_reached FROM v JOIN n USING (model_version) WHERE chunk_id % 100 = 0 AND n > 1""",
}
