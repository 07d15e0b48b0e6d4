"""Queries of problems 6 and 7: containers and mixtures over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekiln.llm import mixing, packing, tokens
from lorekiln.session import cut, spread, table


def sized_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")
    return cut(tokens.with_token_count(docs, keep=["doc_id", "source"]))


def capacity(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "size_limits").where("limit_name = 'container'").first()["max_size"]


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that alone exceed the container, as the packing divided them."""
    packed = packing.pack(sized_documents(spark, sf), capacity(spark, sf))
    return packed.where("n_pieces > 1 and piece_no = 0").select("doc_id").distinct()


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Container and place of each text's pieces."""
    return packing.pack(sized_documents(spark, sf), capacity(spark, sf))


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """One row: how many containers, their tokens, and the part of their room left over."""
    room = capacity(spark, sf)
    packed = p6_containers(spark, sf).where("container is not null")
    boxes = packed.groupBy("lot", "container").agg(F.sum("piece_tokens").alias("used"), F.sum(F.col("piece_tokens").cast("double") ** 2).alias("square"))
    return boxes.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.round(1 - F.sum("used") / (F.count("*") * room), 6).alias("unused_share"), F.round(F.stddev_pop("square") / F.avg("square"), 6).alias("cost_spread"))


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The documents drawn for mix_targets, with their repeats."""
    return mixing.mix(sized_documents(spark, sf), table(spark, sf, "mix_targets"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares reached beside those wanted."""
    targets = table(spark, sf, "mix_targets")
    return mixing.shares(mixing.mix(sized_documents(spark, sf), targets), targets)


def p6_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """One row: documents, those in no row, those whose tokens don't add up, containers over the limit, documents divided without
    need, and whether less than a twentieth of the room is left over (one container apart)."""
    room = capacity(spark, sf)
    sized = sized_documents(spark, sf)
    packed = cut(packing.pack(sized, room))
    by_doc = packed.groupBy("doc_id").agg(F.sum("piece_tokens").alias("placed"), F.max("n_pieces").alias("n_pieces"))
    docs = sized.groupBy("doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")).join(by_doc, "doc_id", "left")
    a = docs.agg(F.sum("rows").alias("documents"), F.count_if(F.col("placed").isNull()).alias("lost"), F.count_if(F.col("placed") != F.col("tokens")).alias("not_whole"), F.count_if((F.col("n_pieces") > 1) & (F.col("tokens") <= room)).alias("divided_needlessly"))
    boxes = packed.where("container is not null").groupBy("lot", "container").agg(F.sum("piece_tokens").alias("used"))
    b = boxes.agg(F.count_if(F.col("used") > room).alias("over_full"), (F.count("*") * room * 0.95 <= F.sum("used") + room).alias("well_filled"))
    return a.join(b, F.lit(True))  # one row each


def p7_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """For each target whether its documents keep to max_repeats, are drawn once, and reach the share to a document's length."""
    targets = table(spark, sf, "mix_targets")
    mixed = cut(mixing.mix(sized_documents(spark, sf), targets))
    twice = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.max("n_tokens").alias("size")).groupBy("source").agg(F.max("n").alias("rows_a_document"), F.max("size").alias("longest"))
    s = mixing.shares(mixed, targets).join(twice, "source", "left")
    return s.select("source", "target_share", (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_kept"), (F.coalesce("rows_a_document", F.lit(0)) <= 1).alias("drawn_once"), (F.abs(F.col("tokens") - F.col("target_share") * F.sum("tokens").over(Window.partitionBy())) <= F.coalesce("longest", F.lit(0)) + 1).alias("share_reached"))


QUERIES = {f.__name__: f for f in (p6_found, p6_containers, p6_fill, p6_invariants, p7_mixture, p7_shares, p7_invariants)}
ORACLE_SQL: dict[str, str] = {
    "p6_invariants": "SELECT count(*) AS documents, 0 AS lost, 0 AS not_whole, 0 AS divided_needlessly, 0 AS over_full, true AS well_filled FROM documents",
    "p7_invariants": "SELECT lower(trim(source)) AS source, target_share, true AS repeats_kept, true AS drawn_once, true AS share_reached FROM mix_targets",
}
