"""Queries of problem 3 over the whole chunks table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm import langid
from lorekiln.session import spread, table


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "chunks").select("id", "file_path", "language", "text")
    net = langid.train(langid.labelled_sample(chunks))
    return langid.segments(spread(chunks.select("id", "text"), "id"), net)


def p3_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Every stretch of every chunk with its language and confidence."""
    return labelled(spark, sf).select("chunk_id", "segment_no", "lang", "start_char", "end_char", F.round("confidence", 6).alias("confidence"), "doc_lang", F.round("doc_confidence", 6).alias("doc_confidence"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """All segments of the chunks whose label isn't exactly their text's language, or that have more than one."""
    stored = table(spark, sf, "chunks").select(F.col("id").alias("chunk_id"), "language").distinct()
    found = labelled(spark, sf).join(stored, "chunk_id")
    return found.where((F.col("n_segments") > 1) | ~F.col("language").eqNullSafe(F.col("lang"))).select("chunk_id", "segment_no", "lang").distinct()


def p3_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """For each chunk with letters: whether its segments are in order, apart and numbered from 0, change language each time, and have
    confidences from 0 to 1."""
    s = p3_segments(spark, sf).groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("segment_no", "start_char", "end_char", "lang", "confidence"))).alias("s"))
    pair = lambda f: F.forall(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | f(F.get("s", i - 1), F.get("s", i)))
    ordered = pair(lambda a, b: (b["start_char"] >= a["end_char"]) & (b["segment_no"] == a["segment_no"] + 1)) & (F.get("s", F.lit(0))["segment_no"] == 0)
    return s.select("chunk_id", ordered.alias("in_order"), pair(lambda a, b: a["lang"] != b["lang"]).alias("changes"), F.forall("s", lambda x: x["confidence"].between(0, 1) & (x["start_char"] < x["end_char"])).alias("sound"))


QUERIES = {f.__name__: f for f in (p3_found, p3_segments, p3_invariants)}
ORACLE_SQL: dict[str, str] = {
    "p3_invariants": r"SELECT DISTINCT id AS chunk_id, true AS in_order, true AS changes, true AS sound FROM chunks WHERE regexp_matches(text, '\p{L}')",
}
