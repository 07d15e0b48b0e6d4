"""Upkeep of an entity graph: names, variants, noise, statuses, clean-ups. Every step is (tables) -> new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekiln.functions.text import ranked
from lorekiln.operators.graph import TIERS, first_by


# names ---------------------------------------------------------------------------------------------------------------
def alias_conflicts(entities: DataFrame, aliases: DataFrame, exceptions: Column) -> DataFrame:
    """(entity_id, name, alias_of, verdict): entities whose name is an alias of another entity of the same type; ``kept`` where
    ``exceptions`` holds of them, else ``removed``. Null names and aliases conflict with nothing."""
    e = entities.select("id", "name", "entity_type")
    a = aliases.join(e.select(F.col("id").alias("entity_id"), "entity_type"), "entity_id").select(F.col("entity_id").alias("alias_of"), F.lower("alias").alias("k"), "entity_type").distinct()
    hit = e.withColumn("k", F.lower("name")).join(a, ["k", "entity_type"]).where("id <> alias_of")
    return hit.select(F.col("id").alias("entity_id"), "name", "alias_of", F.when(exceptions, "kept").otherwise("removed").alias("verdict"))


def alias_heirs(entities: DataFrame, aliases: DataFrame, exceptions: Column) -> DataFrame:
    """(entity_id, alias), distinct: aliases of removed entities under the entity that inherits them: of those whose alias the removed
    name was the one of smallest id that isn't removed itself. Its own name is no alias."""
    gone = alias_conflicts(entities, aliases, exceptions).where("verdict = 'removed'").select("entity_id", "alias_of").distinct()
    heirs = gone.join(gone.select(F.col("entity_id").alias("alias_of")).distinct(), "alias_of", "left_anti").groupBy("entity_id").agg(F.min("alias_of").alias("heir"))
    moved = aliases.join(heirs, "entity_id").join(entities.select(F.col("id").alias("heir"), "name"), "heir")
    return moved.where("alias <> name").select(F.col("heir").alias("entity_id"), "alias").distinct()


def with_aliases(aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """(entity_id, alias): the aliases of entities that ``wanted`` (entity_id, alias) names are exactly those it lists; other entities
    keep theirs. A null alias clears an entity's aliases."""
    kept = aliases.select("entity_id", "alias").join(wanted.select("entity_id").distinct(), "entity_id", "left_anti")
    return kept.unionByName(wanted.where("alias is not null").select("entity_id", "alias")).distinct()


def curated_aliases(aliases: DataFrame, changes: DataFrame) -> DataFrame:
    """(entity_id, alias, status): aliases after ``changes`` (entity_id, alias, action 'add' or 'remove'): added, removed, absent (to be
    removed, but not there), kept."""
    a = aliases.select("entity_id", "alias", F.lit(1).alias("had")).distinct()
    c = changes.groupBy("entity_id", "alias").agg(F.max("action").alias("action"))
    both = a.join(c, ["entity_id", "alias"], "full")
    status = F.when(F.col("action").isNull(), "kept").when(F.col("action") == "add", F.when(F.col("had") == 1, "kept").otherwise("added")).otherwise(F.when(F.col("had") == 1, "removed").otherwise("absent"))
    return both.select("entity_id", "alias", status.alias("status"))


# variants and noise --------------------------------------------------------------------------------------------------
def variant_merges(entities: DataFrame, stripped) -> DataFrame:
    """(id, winner, pattern, verdict): malformed names, and the one entity of the same type that bears the clean name.

    ``stripped`` gives a name's (candidate, pattern). The verdict is merge, no_canonical, ambiguous (several bear it), too_short, or
    chained (the entity is itself the winner of another). Names that are clean already have no row.
    """
    e = entities.select("id", "entity_type", "name", F.lower(F.trim("name")).alias("k")).withColumn("v", stripped(F.col("name")))
    dirty = e.where("v is not null and lower(v.candidate) <> k").select("id", "entity_type", F.lower("v.candidate").alias("c"), F.col("v.pattern").alias("pattern"))
    clean = e.groupBy(F.col("k").alias("c"), "entity_type").agg(F.count("*").alias("n"), F.min("id").alias("winner"))
    hit = dirty.join(clean, ["c", "entity_type"], "left")
    verdict = F.when(F.length("c") < 3, "too_short").when(F.col("n").isNull(), "no_canonical").when(F.col("n") > 1, "ambiguous").otherwise("merge")
    hit = hit.select("id", F.when(verdict == "merge", F.col("winner")).alias("winner"), "pattern", verdict.alias("verdict"))
    winners = hit.where("verdict = 'merge'").select(F.col("winner").alias("id"), F.lit(True).alias("wins")).distinct()
    return hit.join(winners, "id", "left").select("id", "winner", "pattern", F.when(F.col("wins") & (F.col("verdict") == "merge"), "chained").otherwise(F.col("verdict")).alias("verdict"))


def purged(entities: DataFrame, reason: Column, exempt: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, removed with ``reason``): entities without those whose name has a reason to go; ``exempt``: by reason, the types it spares."""
    e = entities.withColumn("reason", reason)
    spared = F.lit(False)
    for why, types in (exempt or {}).items():
        spared = spared | ((F.col("reason") == why) & F.col("entity_type").isin(types))
    gone = F.col("reason").isNotNull() & ~F.coalesce(spared, F.lit(False))
    return e.where(~gone).drop("reason"), e.where(gone)


def cleanup_report(entities: DataFrame, edges: DataFrame, reasons: Column, canonical: Column) -> DataFrame:
    """(what, n) of a dry run: entities, edges, garbage by reason (a name may have several), entities with any, losers of merges, edges
    that merges would rewrite and loops they would make."""
    from lorekiln.operators.merge import merge_plan

    bad = entities.select("id", F.explode(reasons).alias("reason"))
    plan = merge_plan(entities, canonical).where("id <> winner")
    ends = edges.join(plan.select(F.col("id").alias("src"), F.col("winner").alias("ws")), "src", "left").join(plan.select(F.col("id").alias("dst"), F.col("winner").alias("wd")), "dst", "left")
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    rows = [one(entities, "entities"), one(edges, "relations"), bad.groupBy(F.concat(F.lit("garbage:"), "reason").alias("what")).agg(F.count("*").alias("n")), one(bad.select("id").distinct(), "garbage"), one(plan, "losers")]
    rows += [one(ends.where("ws is not null or wd is not null"), "rewritten"), one(ends.where("(ws is not null or wd is not null) and coalesce(ws, src) = coalesce(wd, dst)"), "loops")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# relations -----------------------------------------------------------------------------------------------------------
def without_sources(entities: DataFrame, edges: DataFrame, preserve: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) when a graph is cleared: edges of the ``preserve``d sources stay, and entities that such an edge has; without
    ``preserve`` nothing does."""
    kept = edges.where(F.col("source").isin(list(preserve))) if preserve else edges.where("false")
    ends = kept.select(F.col("src").alias("id")).union(kept.select("dst")).distinct()
    return entities.join(ends, "id", "left_semi"), kept


def new_relations(old: DataFrame, found: DataFrame, entities: DataFrame, types: list[str], source: str, exclude: list[str] = ()) -> DataFrame:
    """(src, rel_type, dst, source): relations found by name (src, rel_type, dst) as ids, without those that exist. A name means the entity
    of the first of ``types`` that bears it, then the smallest id; unknown and ``exclude``d names give none, nor do loops."""
    e = entities.select(F.lower("name").alias("k"), "id", "entity_type").where(F.col("entity_type").isin(types) & ~F.col("k").isin([x.lower() for x in exclude]))
    one = first_by(e, ["k"], [ranked(F.col("entity_type"), types), F.col("id")]).select("k", "id")
    pair = found.select(F.lower("src").alias("ks"), "rel_type", F.lower("dst").alias("kd")).distinct()
    hit = pair.join(one.select(F.col("k").alias("ks"), F.col("id").alias("src")), "ks").join(one.select(F.col("k").alias("kd"), F.col("id").alias("dst")), "kd").where("src <> dst").select("src", "rel_type", "dst").distinct()
    return hit.join(old.select("src", "rel_type", "dst").distinct(), ["src", "rel_type", "dst"], "left_anti").withColumn("source", F.lit(source))




def known_relations(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Relations (key, src, rel_type, dst) of which both names are known in their text: ``known`` has (key, name, resolved); the resolved
    form takes the name's place where there is one."""
    k = known.groupBy(key, F.lower("name").alias("n")).agg(F.max(F.coalesce("resolved", "name")).alias("r"))
    a = found.join(k.select(key, F.col("n").alias("ns"), F.col("r").alias("rs")), (F.lower("src") == F.col("ns")) & (found[key] == k[key])).drop(k[key])
    b = k.select(F.col(key).alias("key2"), F.col("n").alias("nd"), F.col("r").alias("rd"))
    return a.join(b, (F.lower("dst") == F.col("nd")) & (F.col(key) == F.col("key2"))).select(key, F.col("rs").alias("src"), "rel_type", F.col("rd").alias("dst")).distinct()


def safe_family(edges: DataFrame, entities: DataFrame, no_names: list[str]) -> DataFrame:
    """Edges without derived ones that no recorded parent backs, without loops, and without ends named by ``no_names``.

    A derived FATHER_OF (source inferred) is backed where the child has a sibling whose recorded father is the same."""
    bad = entities.where(F.lower("name").isin([n.lower() for n in no_names])).select("id").distinct()
    e = edges.where("src <> dst").join(bad.withColumnRenamed("id", "src"), "src", "left_anti").join(bad.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns)
    given = e.where("rel_type = 'FATHER_OF' and source <> 'inferred'").select(F.col("src").alias("father"), F.col("dst").alias("child"))
    sib = e.where(F.col("rel_type").isin("BROTHER_OF", "SISTER_OF"))
    sib = sib.select(F.col("src").alias("child"), F.col("dst").alias("other")).union(sib.select("dst", "src"))
    backed = given.join(sib, "child").select(F.col("father").alias("src"), F.col("other").alias("dst")).distinct()
    derived = e.where("rel_type = 'FATHER_OF' and source = 'inferred'")
    rest = e.where("not (rel_type = 'FATHER_OF' and source = 'inferred')")
    return rest.unionByName(derived.join(backed, ["src", "dst"], "left_semi").select(*edges.columns))


# metadata, profiles, candidates --------------------------------------------------------------------------------------
def merged_metadata(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """Entities with their JSON metadata overlaid by ``changes`` (id, patch), key by key; of several patches of an id the last by patch
    text counts. Broken metadata count as empty; values keep their JSON form."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    p = changes.groupBy("id").agg(F.max("patch").alias("patch"))
    both = entities.join(p, "id", "left")
    left, right = as_map(F.col("metadata")), as_map(F.col("patch"))
    merged = F.map_concat(F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k)), right)
    entries = F.map_from_entries(F.sort_array(F.map_entries(merged)))
    return both.select(*[F.when(F.col("patch").isNull(), F.col("metadata")).otherwise(F.to_json(entries)).alias("metadata") if c == "metadata" else F.col(c) for c in entities.columns])


def profile_status(profiles: DataFrame, rewritten: DataFrame) -> DataFrame:
    """Profiles (entity_id, status) after their metadata were written anew for ``rewritten`` (entity_id): those that were profiled are
    stale, the others as they were; new ones are pending."""
    r = rewritten.select("entity_id", F.lit(True).alias("again")).distinct()
    both = profiles.join(r, "entity_id", "full")
    return both.select("entity_id", F.when(F.col("status").isNull(), "pending").when(F.col("again") & (F.col("status") == "profiled"), "stale").otherwise(F.col("status")).alias("status"))


def orphaned(profiles: DataFrame, entities: DataFrame) -> DataFrame:
    """Profiles whose entity is gone. Without any entities that is all of them."""
    return profiles.join(entities.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_anti")


def candidates_after(candidates: DataFrame, promote: DataFrame, dismiss: DataFrame, now: Column, days: int = 30, least: int = 3) -> DataFrame:
    """Candidates (name, frequency, last_seen, status) after a round: promoted and dismissed by name, if they were pending; pending ones
    seen fewer than ``least`` times and not for ``days`` days are pruned, that is, left out."""
    p, d = promote.select("name", F.lit(True).alias("up")).distinct(), dismiss.select("name", F.lit(True).alias("down")).distinct()
    both = candidates.join(p, "name", "left").join(d, "name", "left")
    pending = F.col("status") == "pending"
    status = F.when(pending & F.col("up"), "promoted").when(pending & F.col("down"), "dismissed").otherwise(F.col("status"))
    old = (status == "pending") & (F.col("frequency") < least) & (F.col("last_seen") < now - F.make_dt_interval(F.lit(days)))
    return both.where(~F.coalesce(old, F.lit(False))).select("name", "frequency", "last_seen", status.alias("status"))
