"""Snapshot algebra: every change is (old, delta) -> new, which the caller writes to another place and swaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.functions.text import ranked


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: list[str] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key (nulls equal), others stay. Columns in ``keep_old`` keep the old
    value where the new one is null."""
    values = [c for c in old.columns if c not in keys]
    o = old.select(*[F.col(c).alias("o_" + c) for c in old.columns], F.lit(True).alias("has_o"))
    n = new.select(*[F.col(c).alias("n_" + c) for c in old.columns], F.lit(True).alias("has_n"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col("o_" + k).eqNullSafe(F.col("n_" + k))
    both = o.join(n, cond, "full")
    pick = lambda c: F.when(F.col("has_n").isNull(), F.col("o_" + c)).when(F.lit(c in keep_old) & F.col("n_" + c).isNull(), F.col("o_" + c)).otherwise(F.col("n_" + c))
    return both.select(*[F.when(F.col("has_n"), F.col("n_" + k)).otherwise(F.col("o_" + k)).alias(k) for k in keys], *[pick(c).alias(c) for c in values])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks; of several new rows of a key the first by ``order``."""
    from lorekiln.operators.graph import first_by

    fresh = first_by(new, keys, order).select(*old.columns)
    cond = F.lit(True)
    have = old.select(*[F.col(k).alias("h_" + k) for k in keys]).distinct()
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col("h_" + k))
    return old.unionByName(fresh.join(have, cond, "left_anti"))


def difference(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): new, changed, deleted or unchanged, by content hash (null-safe)."""
    o, n = old.select(key, F.col(digest).alias("o"), F.lit(1).alias("ho")), new.select(key, F.col(digest).alias("n"), F.lit(1).alias("hn"))
    change = F.when(F.col("ho").isNull(), "new").when(F.col("hn").isNull(), "deleted").when(F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("changed")
    return o.join(n, key, "full").select(key, change.alias("change"))


def cascade_delete(gone: DataFrame, key: str, *dependents: tuple[DataFrame, str]) -> list[DataFrame]:
    """Each dependent table without the rows that refer to a deleted key."""
    g = gone.select(F.col(key).alias("_gone")).distinct()
    return [d.join(g, d[c] == g["_gone"], "left_anti") for d, c in dependents]


def merge_plan(entities: DataFrame, canonical: Column) -> DataFrame:
    """(id, winner): entities that share a canonical name and type with others, and the one that stays: its name is the
    canonical one, else the smallest id."""
    from pyspark.sql.window import Window

    e = entities.select("id", "name", "entity_type", canonical.alias("canonical")).where(F.col("canonical") != "")
    w = Window.partitionBy("canonical", "entity_type").orderBy(F.when(F.lower("name") == F.col("canonical"), 0).otherwise(1), "id")
    e = e.withColumn("winner", F.first("id").over(w)).withColumn("n", F.count("*").over(Window.partitionBy("canonical", "entity_type")))
    return e.where("n > 1").select("id", "winner")


def merge_apply(edges: DataFrame, plan: DataFrame, order: list | None = None) -> DataFrame:
    """Edges with merged ends rewritten, without loops that this makes and without repeated (src, dst, rel_type).

    Of edges that become the same the first by ``order`` stays with its confidence: the order in which they were recorded, where the
    table has one; without it, the surest tier.
    """
    from lorekiln.operators.graph import TIERS, first_by

    p = plan.where("id <> winner")
    e = edges
    for end in ("src", "dst"):
        e = e.join(p.select(F.col("id").alias(end), F.col("winner").alias("w_" + end)), end, "left").withColumn(end, F.coalesce("w_" + end, end)).drop("w_" + end)
    rank = ranked(F.col("confidence"), TIERS)
    return first_by(e.where("src <> dst"), ["src", "dst", "rel_type"], order or [rank, F.col("confidence")]).select("src", "dst", "rel_type", "confidence")
