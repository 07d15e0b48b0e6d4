"""Graph queries over entities(id, name, entity_type) and edges(src, dst, rel_type, confidence)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekiln.functions import text as T
from lorekiln.functions.arrays import small
from lorekiln.session import cut

#: Tiers of confidence from the surest on; others rank after them.
TIERS = ["curated", "metadata", "llm_high", "llm_low", "ner", "co_occurrence"]


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: (a, b, rel_type, confidence, outgoing). An equi-join on ``a`` replaces a join on src or dst."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel_type", "confidence", F.lit(True).alias("outgoing"))
    return out.unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel_type", "confidence", F.lit(False).alias("outgoing")))


def neighbours(entities: DataFrame, edges: DataFrame, ids: list[int], floor: str | None = None, rel_types: list[str] | None = None) -> DataFrame:
    """Typed relations of the given entities in both directions; ``floor`` keeps the tiers down to it (unknown: all)."""
    e = edges
    if floor in TIERS:
        e = e.where(F.col("confidence").isin(TIERS[: TIERS.index(floor) + 1]))
    if rel_types:
        e = e.where(F.col("rel_type").isin(rel_types))
    hit = both_ways(e).where(F.col("a").isin(ids))
    named = entities.select(F.col("id").alias("b"), F.col("name").alias("other"), F.col("entity_type").alias("other_type"))
    return hit.join(named, "b").withColumn("tier", T.ranked(F.col("confidence"), TIERS))


def _steps(edges: DataFrame, front: DataFrame) -> DataFrame:
    """(from, b): undirected steps from the nodes of ``front`` (id). The front meets each end of the edges before anything is made
    distinct or doubled; while it is small it is broadcast, so the edges aren't shuffled."""
    f = small(front.select(F.col("id").alias("from")))
    out = edges.select(F.col("src").alias("from"), F.col("dst").alias("b")).join(f, "from")
    return out.unionByName(edges.select(F.col("dst").alias("from"), F.col("src").alias("b")).join(f, "from"))


def within_hops(edges: DataFrame, ids: list[int], depth: int) -> DataFrame:
    """(id, hops): nodes at most ``depth`` undirected steps away, each once, at its least distance; the seeds have 0.

    A loop of joins with an anti join on what was seen: polynomial where enumerating paths would explode.
    """
    spark = edges.sparkSession
    seen = spark.createDataFrame([(i, 0) for i in dict.fromkeys(ids)], "id long, hops int")
    front = seen
    for d in range(1, depth + 1):
        step = _steps(edges, front).select(F.col("b").alias("id")).distinct()
        front = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(d)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def shortest_path(edges: DataFrame, start: int, goal: int, most: int = 12) -> DataFrame:
    """(hops, path): one shortest undirected path, of equal ones the one whose ids are least; none gives no row."""
    spark = edges.sparkSession
    front = spark.createDataFrame([(start, [start])], "id long, path array<long>")
    seen = front.select("id")
    for hops in range(most + 1):
        hit = front.where(F.col("id") == goal)
        if not hit.isEmpty():
            return hit.select(F.lit(hops).alias("hops"), F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))
        step = _steps(edges, front).distinct().join(front, F.col("from") == front["id"]).select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        front = cut(step.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front.select("id")))
    return spark.createDataFrame([], "hops int, path string")


def descendants(edges: DataFrame, root: int, depth: int) -> DataFrame:
    """(id, level, path) of a tree of parent edges (src is the child): every path downwards, at most ``depth`` (1 to 10) levels."""
    spark = edges.sparkSession
    depth = min(10, max(1, depth))
    level = spark.createDataFrame([(root, 0, str(root))], "id long, level int, path string")
    out = [level]
    for d in range(1, depth + 1):
        step = level.join(edges.select("src", "dst"), F.col("dst") == F.col("id")).where(~F.concat(F.lit(","), "path", F.lit(",")).contains(F.concat(F.lit(","), F.col("src").cast("string"), F.lit(","))))
        level = cut(step.select(F.col("src").alias("id"), F.lit(d).alias("level"), F.concat_ws(",", "path", F.col("src").cast("string")).alias("path")))
        if level.isEmpty():
            break
        out.append(level)
    return reduce(DataFrame.unionByName, out)


#: Subgraphs of so many nodes and edges at most are iterated over in one task; larger ones by a join a step.
ONE_TASK = 1_000_000


def _power_iteration(core: DataFrame, sub: DataFrame, seeds: list[int], alpha: float, steps: int, tolerance: float) -> DataFrame:
    """The steps of ``pagerank`` on a subgraph of bounded size, in one task: (id, score)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf.a.to_numpy())
        e = pdf[pdf.b.notna()]
        a, b = np.searchsorted(ids, e.a.to_numpy()), np.searchsorted(ids, e.b.to_numpy().astype("int64"))
        weight = 1.0 / e.deg.to_numpy()
        restart = np.isin(ids, seeds) / len(seeds)
        alone = np.bincount(b, minlength=len(ids)) == 0
        score = np.full(len(ids), 1.0 / len(ids))
        for _ in range(steps):
            got = np.where(alone, score.sum() / len(ids), np.bincount(b, weights=score[a] * weight, minlength=len(ids)))
            new = alpha * restart + (1 - alpha) * got
            moved, score = np.abs(new - score).sum(), new
            if moved < tolerance:
                break
        return pd.DataFrame({"id": ids, "score": score})

    rows = sub.select("a", "b", "deg").unionByName(core.select(F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(1).cast("long").alias("deg")))
    return rows.groupBy(F.lit(1).alias("one")).applyInPandas(run, "id long, score double")


def pagerank(edges: DataFrame, seeds: list[int], alpha: float = 0.5, steps: int = 20, tolerance: float = 1e-6, k: int | None = None) -> DataFrame:
    """(id, score): personalised PageRank on the subgraph of the seeds and their neighbours, the ``k`` best if given.

    alpha is the weight of the restart, which is spread over all seeds; mass starts evenly. An edge counts once in each direction,
    whatever its types; a loop counts twice at its node. A node without edges takes an even share of the whole mass. Steps end
    as soon as the scores differ by less than ``tolerance`` in all, at the latest after ``steps``. Seeds that no edge has give
    no row, unless another seed has one.
    """
    seeds = list(dict.fromkeys(seeds))
    mine = edges.where(F.col("src").isin(seeds) | F.col("dst").isin(seeds))
    core = cut(mine.select(F.col("src").alias("id")).union(mine.select("dst")).distinct())
    n = core.count()
    if n == 0:
        return core.withColumn("score", F.lit(0.0))
    ends = small(core)
    inner = edges.select("src", "dst").join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    inner = inner.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    sub = inner.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(inner.select(F.col("y").alias("a"), F.col("x").alias("b")))
    sub = cut(sub.join(sub.groupBy("a").agg(F.count("*").alias("deg")), "a"))
    if n + sub.count() <= ONE_TASK:
        score = _power_iteration(core, sub, seeds, alpha, steps, tolerance)
        return score.orderBy(F.desc("score"), "id").limit(k) if k else score
    restart = F.when(F.col("id").isin(seeds), F.lit(1.0 / len(seeds))).otherwise(0.0)
    score, total = core.withColumn("score", F.lit(1.0 / n)), 1.0
    for _ in range(steps):
        got = sub.join(score, sub["a"] == score["id"]).groupBy("b").agg(F.sum(F.col("score") / F.col("deg")).alias("got"))
        both = score.join(got, score["id"] == got["b"], "left").select("id", F.col("score").alias("before"), "got")
        both = cut(both.select("id", "before", (alpha * restart + (1 - alpha) * F.coalesce("got", F.lit(total / n))).alias("score")))
        total, moved = both.agg(F.sum("score"), F.sum(F.abs(F.col("score") - F.col("before")))).first()
        score = both.select("id", "score")
        if moved < tolerance:
            break
    return score.orderBy(F.desc("score"), "id").limit(k) if k else score


def closure(facts: DataFrame, symmetric: list[str], siblings: str, parent: str) -> DataFrame:
    """(src, rel_type, dst, reason) at the fixpoint: symmetric relations hold both ways (but not with oneself), and siblings share
    the parents recorded under ``parent`` (src is the parent). Given facts have reason null; the first reason found is kept."""
    known = cut(facts.select("src", "rel_type", "dst").distinct().withColumn("reason", F.lit(None).cast("string")))
    while True:
        turned = known.where(F.col("rel_type").isin(symmetric) & (F.col("src") != F.col("dst"))).select(F.col("dst").alias("src"), "rel_type", F.col("src").alias("dst"), F.lit("symmetry").alias("reason"))
        sib = known.where(F.col("rel_type") == siblings).select(F.col("src").alias("x"), F.col("dst").alias("y"))
        par = known.where(F.col("rel_type") == parent).select(F.col("src").alias("p"), F.col("dst").alias("x"))
        shared = sib.join(par, "x").where("p <> y").select(F.col("p").alias("src"), F.lit(parent).alias("rel_type"), F.col("y").alias("dst"), F.lit("shared_parent").alias("reason"))
        new = turned.unionByName(shared).groupBy("src", "rel_type", "dst").agg(F.min("reason").alias("reason"))
        new = cut(new.join(known, ["src", "rel_type", "dst"], "left_anti"))
        if new.isEmpty():
            return known
        known = cut(known.unionByName(new))


def find(entities: DataFrame, aliases: DataFrame, needle: str, k: int = 20, entity_type: str | None = None) -> DataFrame:
    """(id, name, entity_type, score): entities whose name or an alias contains the needle without regard to case, most similar first,
    ties by id. The score is the greatest trigram similarity of the name and of the aliases that were found (all of them
    where the name was). A blank needle finds nothing."""
    if not needle.strip():
        return entities.select("id", "name", "entity_type", F.lit(0.0).alias("score")).where("false")
    probe, low = T.trigrams(F.lit(needle)), F.lit(needle.lower())
    e = entities if entity_type is None else entities.where(F.col("entity_type") == entity_type)
    e = e.select("id", "name", "entity_type", F.lower("name").contains(low).alias("named"))
    both = e.join(aliases.select(F.col("entity_id").alias("id"), "alias"), "id", "left").where(F.col("named") | F.lower("alias").contains(low))
    own = F.round(T.similarity(T.trigrams(F.col("name")), probe), 6)
    other = F.max(F.when(F.col("alias").isNotNull(), F.round(T.similarity(T.trigrams(F.col("alias")), probe), 6)))
    return both.groupBy("id", "name", "entity_type").agg(F.greatest(F.max(own), F.coalesce(other, F.lit(0.0))).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def degrees(edges: DataFrame) -> DataFrame:
    """One row: average, least and greatest number of outgoing edges of nodes that have any."""
    d = edges.groupBy("src").agg(F.count("*").alias("d"))
    return d.agg(F.round(F.avg("d"), 6).alias("avg_degree"), F.min("d").alias("min_degree"), F.max("d").alias("max_degree"), F.count("*").alias("nodes"))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def files_of(names: DataFrame, entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(name, files): the files of each name asked for, in order; an empty array where the entity is unknown or has none."""
    asked = names.select("name").where("name is not null").distinct()
    m = mentions.select("entity_id", "file_path").where("file_path is not null").distinct()
    hit = entities.select(F.col("id").alias("entity_id"), "name").join(asked, "name", "left_semi").join(m, "entity_id").select("name", "file_path").distinct()
    lists = hit.groupBy("name").agg(F.sort_array(F.collect_list("file_path")).alias("files"))
    return asked.join(lists, "name", "left").select("name", F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def resolved(names: DataFrame, entities: DataFrame, aliases: DataFrame, preferred: list[str] = ("person",)) -> DataFrame:
    """(name, id): the entity that a name or alias means, without regard to case: by preferred types in order, names before aliases,
    then the smallest id. Unknown names have a null id."""
    labels = entities.select("id", "entity_type", F.lower("name").alias("k"), F.lit(0).alias("of")).unionByName(aliases.join(entities.select(F.col("id").alias("entity_id"), "entity_type"), "entity_id").select(F.col("entity_id").alias("id"), "entity_type", F.lower("alias").alias("k"), F.lit(1).alias("of")))
    asked = names.select("name").distinct().withColumn("k", F.lower("name"))
    hit = first_by(asked.join(labels, "k"), ["name"], [T.ranked(F.col("entity_type"), list(preferred)), F.col("of"), F.col("id")])
    return asked.select("name").join(hit.select("name", "id"), "name", "left")


def other_names(entities: DataFrame, aliases: DataFrame, language: str) -> DataFrame:
    """(id, name, other): each entity's first alias of a language, null without one."""
    a = aliases.where(F.col("language") == language).groupBy(F.col("entity_id").alias("id")).agg(F.min("alias").alias("other"))
    return entities.select("id", "name").join(a, "id", "left")


def ancestors(edges: DataFrame, root: int, depth: int) -> DataFrame:
    """(id, level, path): every path upwards over parent edges (src is the parent), ``depth`` (1 to 10) levels at most, none twice over
    a node. Level 0 is the root."""
    return descendants(edges.select("src", "dst"), root, depth)


def tree(edges: DataFrame, entities: DataFrame, root: int, depth: int = 3, parents: tuple[str, ...] = ("FATHER_OF", "MOTHER_OF"), spouses: str = "SPOUSE_OF") -> dict:
    """A family tree as nested dicts (id, name, spouses, parents, children), for display. Rows come from the path queries, whose size
    the depth bounds; a person met on two paths of one generation appears once under the same child or parent."""
    kin = edges.where(F.col("rel_type").isin(*parents)).select("src", "dst")
    up = [r.path.split(",") for r in ancestors(kin, root, depth).collect()]
    down = [r.path.split(",") for r in descendants(kin.select(F.col("dst").alias("src"), F.col("src").alias("dst")), root, depth).collect()]
    s = edges.where(F.col("rel_type") == spouses)
    wed = sorted({r.id for r in s.where(F.col("src") == root).select(F.col("dst").alias("id")).union(s.where(F.col("dst") == root).select("src")).collect()})
    ids = sorted({int(x) for p in up + down for x in p} | set(wed) | {root})
    names = {r.id: r.name for r in entities.where(F.col("id").isin(ids)).select("id", "name").collect()}
    new = lambda i: {"id": i, "name": names.get(i), "spouses": [], "parents": [], "children": []}
    top = new(root) | {"spouses": [{"id": i, "name": names.get(i)} for i in wed]}
    for paths, side in ((up, "parents"), (down, "children")):
        for p in sorted(paths):
            at = top
            for i in map(int, p[1:]):
                nxt = next((x for x in at[side] if x["id"] == i), None)
                if nxt is None:
                    nxt = new(i)
                    at[side].append(nxt)
                at = nxt
    return top


def structure_edges(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of a hierarchy written as paths (file_path): every folder and file with its depth, PART_OF the folder above."""
    parts = paths.select(F.split("file_path", "/").alias("p")).where("file_path is not null").distinct()
    steps = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.struct(F.array_join(F.slice("p", 1, i), "/").alias("name"), i.alias("depth"), F.array_join(F.slice("p", 1, i - 1), "/").alias("above")))).alias("s")).select("s.*").distinct()
    return steps.select("name", "depth"), steps.where("depth > 1").select(F.col("name").alias("src"), F.lit("PART_OF").alias("rel_type"), F.col("above").alias("dst"))


def narrative_cliques(paths: DataFrame) -> DataFrame:
    """(narrative, a, b): every ordered couple of different files of one narrative. A narrative has a handful of files; the output is
    the couples themselves."""
    one = paths.where("narrative is not null").select("narrative", "file_path").distinct().groupBy("narrative").agg(F.sort_array(F.collect_list("file_path")).alias("f"))
    return one.select("narrative", F.explode("f").alias("a"), "f").select("narrative", "a", F.explode("f").alias("b")).where("a <> b")


def limited(found: DataFrame, order: list, each: int, names: int, group: str | None = None) -> DataFrame:
    """``each`` x ``names`` rows in all, as batch look-ups are limited; with ``group``, ``each`` rows of every group instead."""
    if group is None:
        return found.orderBy(*order).limit(each * names)
    return found.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rn") <= each).drop("_rn")


def resolved_paths(rows: DataFrame, present: DataFrame, depth: int = 10) -> DataFrame:
    """(id, path, level, present): the place of each row of a hierarchy (id, parent, name; parent null at the top) as the names above it joined by
    slashes, and whether the corpus (file_path) has something there. Rows below an unknown or circular parent have no path."""
    level = rows.where("parent is null").select("id", F.col("name").alias("path"), F.lit(0).alias("level"))
    out = [level]
    for d in range(1, depth + 1):
        level = cut(rows.select(F.col("id").alias("child"), "parent", "name").join(small(level.select(F.col("id").alias("parent"), "path")), "parent").select(F.col("child").alias("id"), F.concat_ws("/", "path", "name").alias("path"), F.lit(d).alias("level")))
        if level.isEmpty():
            break
        out.append(level)
    every = reduce(DataFrame.unionByName, out)
    steps = present.where("file_path is not null").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("file_path", "/"))), lambda i: F.array_join(F.slice(F.split("file_path", "/"), 1, i), "/"))).alias("path")).distinct().withColumn("present", F.lit(True))
    return every.join(steps, "path", "left").select("id", "path", "level", F.coalesce("present", F.lit(False)).alias("present"))
