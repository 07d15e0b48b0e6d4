"""Ranked retrieval: full text, exact nearest neighbours, rank fusion, boosts and expansions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekiln.functions import text as T
from lorekiln.functions.arrays import let
from lorekiln.session import spread


def match_all(docs: DataFrame, key: str, text: str, terms: list[str], without: list[str] = ()) -> DataFrame:
    """(key, hits): documents that hold all terms and none of ``without``.

    Terms are looked up in the array of a document's words, so a query never explodes the corpus: only the scan and a filter.
    """
    words = F.split(T.normalised(F.col(text)), " ")
    d = docs.select(key, words.alias("w"))
    for t in terms:
        d = d.where(F.array_contains("w", t))
    for t in without:
        d = d.where(~F.array_contains("w", t))
    return d.select(key, F.size(F.filter("w", lambda x: x.isin(*terms))).alias("hits"))


def cover_rank(docs: DataFrame, key: str, text: str, terms: list[str], token=None) -> DataFrame:
    """(key, score): cover density. A cover is a shortest stretch that holds all terms; each scores 0.1 / (1 + words in it that are no
    hits). A single term's covers are its occurrences. Documents that lack a term have no row.

    One fold over a document's own hits from the right: it holds the next occurrence of each term, which together end the cover
    that begins here; a cover counts unless the one to its right ends at the same place. ``token`` turns words into the terms'
    form (a stemmer, say).
    """
    words = F.split(T.normalised(F.col(text)), " ")
    return cover_words(docs.select(key, (words if token is None else F.transform(words, token)).alias("_w")), key, "_w", terms, token)


def cover_words(docs: DataFrame, key: str, words: str, terms: list[str], token=None) -> DataFrame:
    """``cover_rank`` over an array of words that is there already."""
    terms = list(dict.fromkeys(terms))
    at = F.array(*[F.lit(t) if token is None else token(F.lit(t)) for t in terms])
    hits = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("p"), F.array_position(at, w).cast("int").alias("t"))), lambda s: s["t"] > 0)
    n = len(terms)
    none = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("p"))
    start = F.struct(F.array_repeat(none, F.lit(n)).alias("next"), F.lit(-1).alias("end"), F.lit(0.0).alias("score"))

    def step(a: Column, x: Column) -> Column:
        now = F.transform(a["next"], lambda o, k: F.when(k + 1 == x["t"], F.struct(x["i"].alias("i"), x["p"].alias("p"))).otherwise(o))
        return let(now, lambda nx: let(F.when(F.forall(nx, lambda o: o["i"] >= 0), F.array_max(nx)), lambda e: F.struct(
            nx.alias("next"), F.coalesce(e["i"], F.lit(-1)).alias("end"),
            (a["score"] + F.when(e.isNotNull() & (e["i"] != a["end"]), F.lit(0.1) / (1 + (e["p"] - x["p"]) - (e["i"] - x["i"]))).otherwise(0.0)).alias("score"))))

    d = docs.select(key, hits.alias("h")).where(F.size(F.array_distinct(F.transform("h", lambda s: s["t"]))) == n)
    placed = F.reverse(F.transform("h", lambda s, i: F.struct(i.cast("int").alias("i"), s["p"].cast("int").alias("p"), s["t"].alias("t"))))
    return d.select(key, F.round(F.aggregate(placed, start, step, lambda a: a["score"]), 6).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit(v: Column) -> Column:
    """A vector of doubles at length 1; null, empty and zero vectors give null."""
    x = F.transform(v, lambda e: e.cast("double"))
    return let(x, lambda y: let(F.sqrt(F.aggregate(y, F.lit(0.0), lambda s, e: s + e * e)), lambda n: F.when(n > 0, F.transform(y, lambda e: e / n))))


#: Up to so many numbers of query vectors go with the function to every task; beyond, queries and rows meet in blocks.
QUERY_NUMBERS = 2_000_000


def _closest(qid: np.ndarray, qg: np.ndarray, y: np.ndarray, ids: np.ndarray, g: np.ndarray, x: np.ndarray, k: int, key: str) -> pa.RecordBatch:
    """The k best rows of each query among these, by cosine to six digits, then by id."""
    out: list[tuple] = []
    if len(ids) and len(qid):
        with np.errstate(all="ignore"):
            s = np.round((y @ x.T) / (np.linalg.norm(y, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]), 6)
        for q, own, row in zip(qid.tolist(), qg, s):
            ok = np.flatnonzero(np.isfinite(row) & (g == own))
            if len(ok) > k:
                ok = ok[np.lexsort((ids[ok], -row[ok]))[:k]]
            out += [(q, int(ids[j]), float(row[j])) for j in ok]
    return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.float64()))], names=["query", key, "score"])


def _matrix(column: pa.ChunkedArray, at: np.ndarray, dim: int) -> np.ndarray:
    return pc.list_flatten(column.take(pa.array(at))).to_numpy().reshape(-1, dim)


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, same: Column | None = None, block: int = 256) -> DataFrame:
    """(query, key, score, rank): the exact k nearest of a stated set of queries, each against all vectors.

    Rows are multiplied with the queries as matrices, in Arrow batches, and each task keeps k a query before anything is shuffled. Few queries
    (measured) go with the function; many are dealt into blocks, and rows are sent once a block. Rows whose group (``same``, held
    against the queries' ``grp``) differs don't meet, nor do vectors of different lengths.
    """
    grp = F.lit("0") if same is None else same.cast("string")
    rows = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), grp.alias("g"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") > 0)
    qgrp = F.lit("0") if same is None else F.col("grp").cast("string")
    asked = queries.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), qgrp.alias("g"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") > 0)
    n, numbers = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    schema = f"query long, {key} long, score double"

    def sized(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        sizes = pc.list_value_length(t.column("v")).to_numpy()
        for dim in np.unique(sizes):
            yield int(dim), np.flatnonzero(sizes == dim)

    plain = lambda t, at: (t.column("id").to_numpy()[at], np.array(t.column("g").to_pylist(), dtype=object)[at])
    if numbers <= QUERY_NUMBERS:
        own: dict[int, tuple] = {}
        got = asked.collect()
        for dim in {len(r.v) for r in got}:
            some = [r for r in got if len(r.v) == dim]
            own[dim] = np.array([r.id for r in some]), np.array([r.g for r in some], dtype=object), np.array([r.v for r in some])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                t = pa.Table.from_batches([batch])
                for dim, at in sized(t):
                    if dim in own:
                        yield _closest(*own[dim], *plain(t, at), _matrix(t.column("v"), at, dim), k, key)

        scored = spread(rows, "id").mapInArrow(run, schema)
    else:
        blocks, parts = -(-n // block), vectors.sparkSession.sparkContext.defaultParallelism
        left = asked.select("*", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("p"), F.lit(True).alias("asks"))
        right = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("p"), F.lit(False).alias("asks"))

        def meet(t: pa.Table) -> pa.Table:
            asks = t.column("asks").to_numpy()
            out = []
            for dim, at in sized(t):
                q, r = at[asks[at]], at[~asks[at]]
                out.append(_closest(*plain(t, q), _matrix(t.column("v"), q, dim), *plain(t, r), _matrix(t.column("v"), r, dim), k, key))
            return pa.Table.from_batches(out)

        scored = left.unionByName(right).groupBy("b", "p").applyInArrow(meet, schema)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))).where(F.col("rank") <= k)


def fuse(left: DataFrame, right: DataFrame, key: str, weights: tuple[float, float] = (0.4, 0.6), constant: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of two lists (key, rank from 1): (key, left_rank, right_rank, fused)."""
    both = left.select(key, F.col("rank").alias("left_rank")).join(right.select(key, F.col("rank").alias("right_rank")), key, "full")
    part = lambda w, c: F.coalesce(F.lit(w) / (constant + F.col(c)), F.lit(0.0))
    return both.withColumn("fused", F.round(part(weights[0], "left_rank") + part(weights[1], "right_rank"), 8))


def top(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best rows with their rank; ties go to the smaller key. Spark takes them per task first."""
    best = df.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(score), key)))


def within_edits(df: DataFrame, text: str, k: int) -> DataFrame:
    """(a, b, distance): different texts of at most k edits (insertions, deletions, replacements), ``a`` before ``b``.

    Exact: k edits leave one of the k + 1 pieces of a text whole, shifted by at most k, so pairs that share no piece of theirs are
    never compared. Pieces are cut by length, and a text looks for those of every length within k of its own. Nulls are left
    out, repeated texts count once; texts shorter than k + 1 have empty pieces and meet all of about their length.
    """
    n = df.select(F.col(text).alias("a")).where("a is not null").distinct().withColumn("n", F.length("a"))
    start = lambda i, n: F.floor(n * i / (k + 1)).cast("int")
    pieces = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k)))).withColumn("s", start(F.col("i"), F.col("n")))
    pieces = pieces.select(F.col("a").alias("b"), F.col("n").alias("m"), "i", F.substring("a", F.col("s") + 1, start(F.col("i") + 1, F.col("n")) - F.col("s")).alias("piece"))
    # a text no shorter than the one that is cut
    seen = n.withColumn("m", F.explode(F.sequence(F.greatest(F.lit(0), F.col("n") - k), F.col("n")))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k))))
    seen = seen.withColumn("s", start(F.col("i"), F.col("m"))).withColumn("size", start(F.col("i") + 1, F.col("m")) - F.col("s"))
    seen = seen.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("s") - k), F.greatest(F.lit(0), F.least(F.col("s") + k, F.col("n") - F.col("size"))))))
    seen = seen.select("a", "n", "m", "i", F.substring("a", F.col("at") + 1, F.col("size")).alias("piece")).distinct()
    pairs = seen.join(pieces, ["m", "i", "piece"]).where("n > m or a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= k)


def index_percentiles(df: DataFrame, group: str, value: str, at: dict[str, float]) -> DataFrame:
    """(group, a column for each of ``at``): the value at place floor(p n) of a group's sorted values; nulls don't count.

    Values are counted first; counts are summed within ranges of values and over the ranges, so that a group with most of the rows is
    spread over as many tasks as it has ranges. Ranges are cut at quantiles of all values.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    cuts = df.approxQuantile(value, [i / 64 for i in range(1, 64)], 0.001)
    bucket = F.aggregate(F.array(*[F.lit(c) for c in sorted(set(cuts))] or [F.lit(0.0)]), F.lit(0), lambda a, c: a + (F.col(value) > c).cast("int"))
    n = n.withColumn("bucket", bucket)
    per = n.groupBy(group, "bucket").agg(F.sum("n").alias("s"))
    w = Window.partitionBy(group)
    per = per.withColumn("base", F.coalesce(F.sum("s").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("s").over(w))
    upto = F.sum("n").over(Window.partitionBy(group, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col(f"a.{group}").eqNullSafe(F.col(f"b.{group}")) & (F.col("a.bucket") == F.col("b.bucket"))
    rows = n.withColumn("upto", upto).alias("a").join(per.alias("b"), same).select(f"a.{group}", f"a.{value}", (F.col("b.base") + F.col("a.upto")).alias("upto"), "b.total")
    # the first value of which more than floor(p n) rows are no greater
    return rows.groupBy(group).agg(*[F.min(F.when(F.col("upto") > F.floor(F.lit(p) * F.col("total")), F.col(value))).alias(name) for name, p in at.items()])
