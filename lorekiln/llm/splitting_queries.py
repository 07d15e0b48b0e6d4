"""Queries of problem 4 over the whole chunks table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm import splitting
from lorekiln.session import spread, table


def limits(spark: SparkSession, sf: str) -> tuple[int, int]:
    r = table(spark, sf, "size_limits").where("limit_name = 'chunk_text'").first()
    return r["max_size"], r["overlap_size"]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Where natural units begin in the chunks beyond the limit, as the extraction of their pieces meets them."""
    most, overlap = limits(spark, sf)
    chunks = spread(table(spark, sf, "chunks").select("id", "text").where(F.length("text") > most), "id")
    cut = chunks.select(F.col("id").alias("chunk_id"), F.explode_outer(splitting.pieces(F.col("text"), most, overlap)).alias("p"))
    return cut.select("chunk_id", F.explode("p.unit_starts").alias("boundary_char")).distinct()


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk as pieces within the limit."""
    chunks = table(spark, sf, "chunks").select("id", "file_path", "chunk_index", "start_char", "text")
    return splitting.split_chunks(spread(chunks, "id"), *limits(spark, sf))


def p4_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """For each chunk with a text: its length, as its pieces cover it; whether all keep to the limit; and whether the overlaps do."""
    most, overlap = limits(spark, sf)
    chunks = table(spark, sf, "chunks").where("text is not null").select("id", "start_char", "text")
    one = chunks.select(F.col("id").alias("chunk_id"), F.length("text").alias("n"), splitting.pieces(F.col("text"), most, overlap, False).alias("p"))
    sizes = F.transform("p", lambda q: q["piece_end"] - q["piece_start"])
    gaps = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.when(i == 1, F.lit(0)).otherwise(F.get("p", i - 2)["piece_end"] - F.get("p", i - 1)["piece_start"]))
    covered = F.aggregate(F.zip_with(sizes, gaps, lambda s, g: s - g), F.lit(0), lambda a, x: a + x)
    return one.select("chunk_id", covered.alias("characters"), F.forall(sizes, lambda s: s <= most).alias("within_limit"), F.forall(gaps, lambda g: (g >= 0) & (g <= overlap)).alias("overlap_kept"))


def p4_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """For each file how many pieces of different chunks it has, and whether they are numbered from 0 without a gap."""
    p = p4_pieces(spark, sf).groupBy("file_path").agg(F.countDistinct("chunk_index").alias("n"), F.min("chunk_index").alias("lo"), F.max("chunk_index").alias("hi"))
    return p.select("file_path", ((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)).alias("numbered"))


QUERIES = {f.__name__: f for f in (p4_found, p4_pieces, p4_invariants, p4_numbers)}
ORACLE_SQL: dict[str, str] = {
    "p4_invariants": "SELECT id AS chunk_id, CAST(length(text) AS INT) AS characters, true AS within_limit, true AS overlap_kept FROM chunks WHERE text IS NOT NULL",
    "p4_numbers": "SELECT DISTINCT file_path, true AS numbered FROM chunks WHERE text IS NOT NULL",
}
