"""Queries of the graph's reads and upkeep, with their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.functions import text as T
from lorekiln.operators import disambiguate, family, graph, maintenance
from lorekiln.plans.catalogue import BOTH, CUSTOMER, ENT, PLAIN, PLAN, REL, SUPPLIER, TIER, edge_view, entity_view, query
from lorekiln.session import one_row, table


@query("SELECT n.name AS name, coalesce(string_agg(DISTINCT m.file_path, '|' ORDER BY m.file_path), '') AS files FROM (SELECT DISTINCT name FROM entities UNION SELECT 'Nobody' UNION SELECT DISTINCT c_name FROM customer) n LEFT JOIN entities e ON e.name = n.name LEFT JOIN entity_document_mentions m ON m.entity_id = e.id GROUP BY 1")
def docs_for_entity_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The files of every name, also of those that are no entity's."""
    names = table(spark, sf, "entities").select("name").union(spark.createDataFrame([("Nobody",)], "name string")).union(table(spark, sf, "customer").select("c_name"))
    f = graph.files_of(names, table(spark, sf, "entities"), table(spark, sf, "entity_document_mentions"))
    return f.select("name", F.array_join("files", "|").alias("files"))


@query("SELECT e.id AS id, e.name AS name, count(DISTINCT m.file_path) AS files, coalesce(string_agg(DISTINCT nullif(m.resolved_name, ''), '|' ORDER BY nullif(m.resolved_name, '')), '') AS senses FROM entities e LEFT JOIN entity_document_mentions m ON m.entity_id = e.id GROUP BY 1, 2")
def entity_mentions(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "entity_document_mentions").groupBy(F.col("entity_id").alias("id")).agg(F.countDistinct("file_path").alias("files"), F.sort_array(F.collect_set(F.nullif("resolved_name", F.lit("")))).alias("senses"))
    e = table(spark, sf, "entities").select("id", "name").join(m, "id", "left")
    return e.select("id", "name", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce(F.array_join("senses", "|"), F.lit("")).alias("senses"))


@query("SELECT id, '{' || string_agg(resolved || ':' || n, ',' ORDER BY resolved) || '}' AS senses FROM (SELECT entity_id id, resolved_name resolved, count(DISTINCT file_path) n FROM entity_document_mentions WHERE resolved_name <> '' GROUP BY 1, 2) GROUP BY 1")
def sense_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Each entity's senses as a map to their number of files, written out in order."""
    m = table(spark, sf, "entity_document_mentions").where("resolved_name <> ''").groupBy("entity_id", "resolved_name").agg(F.countDistinct("file_path").alias("n"))
    maps = m.groupBy(F.col("entity_id").alias("id")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("resolved_name", "n")))).alias("m"))
    text = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return maps.select("id", F.concat(F.lit("{"), text, F.lit("}")).alias("senses"))


@query("""WITH n AS (SELECT DISTINCT alias AS name FROM entity_aliases UNION SELECT name FROM entities), l AS (SELECT id, entity_type, lower(name) k, 0 o FROM entities UNION ALL SELECT entity_id, entity_type, lower(alias), 1 FROM entity_aliases JOIN entities ON id = entity_id)
SELECT n.name AS name, (SELECT l.id FROM l WHERE l.k = lower(n.name) ORDER BY CASE l.entity_type WHEN 'person' THEN 0 WHEN 'place' THEN 1 ELSE 2 END, o, l.id LIMIT 1) AS id FROM n WHERE n.name IS NOT NULL""")
def name_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """The entity of every name and alias, persons before places before others."""
    e, a = table(spark, sf, "entities"), table(spark, sf, "entity_aliases")
    names = e.select("name").union(a.select("alias")).where("name is not null")
    return graph.resolved(names, e, a, ["person", "place"])


@query("SELECT e.id AS id, e.name AS name, min(a.alias) AS other FROM entities e LEFT JOIN entity_aliases a ON a.entity_id = e.id AND a.language = 'es' GROUP BY 1, 2")
def alternative_names(spark: SparkSession, sf: str) -> DataFrame:
    return graph.other_names(table(spark, sf, "entities"), table(spark, sf, "entity_aliases"), "es")


@query(f"WITH {ENT}, {REL}, {BOTH} SELECT a, b, rel_type, confidence, outgoing, name AS other FROM both_ways JOIN ent ON id = b WHERE a >= 100 AND a < 125 AND rel_type <> 'MENTIONED_IN' AND confidence IN ('curated', 'metadata', 'llm_high')")
def typed_relations_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The surer relations of all nations; an edge between two of them would appear twice."""
    ids = [r[0] + 100 for r in table(spark, sf, "nation").select("n_nationkey").collect()]  # a table of fixed size
    return graph.neighbours(entity_view(spark, sf), edge_view(spark, sf), ids, floor="llm_high").where("rel_type <> 'MENTIONED_IN'").drop("other_type", "tier")


@query(f"WITH {ENT}, {REL}, {BOTH} SELECT a, b, rel_type FROM (SELECT a, b, rel_type, row_number() OVER (PARTITION BY a ORDER BY {TIER}, rel_type, b) rn FROM both_ways WHERE a IN (105, 107, 111)) WHERE rn <= 5")
def relations_per_entity(spark: SparkSession, sf: str) -> DataFrame:
    """Five relations of each of three nations, surest first; ``limited`` also has the limit over all of them together."""
    n = graph.neighbours(entity_view(spark, sf), edge_view(spark, sf), [105, 107, 111])
    return graph.limited(n, ["tier", "rel_type", "b"], 5, 3, "a").select("a", "b", "rel_type")


@query(f"WITH {ENT}, {REL}, {BOTH} SELECT a, b, rel_type FROM both_ways WHERE a IN (105, 107, 111) ORDER BY {TIER}, rel_type, a, b LIMIT 15")
def relations_limited(spark: SparkSession, sf: str) -> DataFrame:
    n = graph.neighbours(entity_view(spark, sf), edge_view(spark, sf), [105, 107, 111])
    return graph.limited(n, ["tier", "rel_type", "a", "b"], 5, 3).select("a", "b", "rel_type")


@query(f"""WITH RECURSIVE {REL}, t AS (SELECT CAST({SUPPLIER + 1} AS BIGINT) id, 0 AS level, '{SUPPLIER + 1}' AS path UNION ALL SELECT dst, level + 1, path || ',' || dst FROM t JOIN rel ON src = id WHERE rel_type IN ('PART_OF', 'BELONGS_TO') AND level < 8) SELECT id, level, path FROM t""")
def ancestor_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Everything above a supplier."""
    e = edge_view(spark, sf).where(F.col("rel_type").isin("PART_OF", "BELONGS_TO"))
    return graph.ancestors(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), SUPPLIER + 1, 8)


@query("""WITH p AS (SELECT DISTINCT string_split(file_path, '/') p FROM document_registry WHERE file_path IS NOT NULL), s AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS src, array_to_string(p[1:i-1], '/') AS dst, i FROM (SELECT p, unnest(range(1, len(p) + 1)) i FROM p))
SELECT src, 'PART_OF' AS rel_type, dst FROM s WHERE i > 1""")
def structure_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.structure_edges(table(spark, sf, "document_registry").select("file_path"))[1]


@query("""WITH s AS (SELECT file_path, regexp_extract(file_path, '^([a-z]{2})/', 1) lang, regexp_extract(regexp_replace(file_path, '^[a-z]{2}/', ''), '^([^/]+)/', 1) shelf, book, chapter, lo, hi FROM (SELECT DISTINCT file_path, trim(regexp_extract(reference, '^(.*[^0-9 ,:])[ ]+[0-9]+[:,]', 1)) book, TRY_CAST(regexp_extract(reference, ' ([0-9]+)[:,]', 1) AS INT) chapter, TRY_CAST(regexp_extract(reference, '[:,] ?([0-9]+)', 1) AS INT) lo, coalesce(TRY_CAST(nullif(regexp_extract(reference, '[-–]([0-9]+)$', 1), '') AS INT), TRY_CAST(regexp_extract(reference, '[:,] ?([0-9]+)', 1) AS INT)) hi FROM chunks WHERE reference IS NOT NULL) WHERE chapter IS NOT NULL AND lo IS NOT NULL)
SELECT lang, shelf, book, count(DISTINCT chapter) AS chapters, count(DISTINCT (chapter - 1) // 10) AS parts, max(hi) AS last_verse FROM s GROUP BY 1, 2, 3""")
def structure_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Library, shelf, book, part (ten chapters) and passage of every reference, counted by book."""
    from lorekiln.operators.extract import verse_ranges

    c = table(spark, sf, "chunks").where("reference is not null").select("file_path", "reference").distinct()
    r = verse_ranges(c.select(F.struct("file_path").alias("k"), "reference"), "k", "reference").select("k.file_path", "book", "chapter", "lo", "hi").distinct()
    shelf = F.regexp_extract(F.regexp_replace("file_path", "^[a-z]{2}/", ""), "^([^/]+)/", 1)
    return r.groupBy(F.regexp_extract("file_path", "^([a-z]{2})/", 1).alias("lang"), shelf.alias("shelf"), "book").agg(F.countDistinct("chapter").alias("chapters"), F.countDistinct(F.floor((F.col("chapter") - 1) / 10)).alias("parts"), F.max("hi").alias("last_verse"))


@query("""WITH f AS (SELECT DISTINCT narrative, f FROM (SELECT narrative, unnest([src_file_path, dst_file_path]) f FROM document_parallels WHERE narrative IS NOT NULL)) SELECT x.narrative AS narrative, x.f AS a, y.f AS b FROM f x JOIN f y ON x.narrative = y.narrative AND x.f <> y.f""")
def narrative_cliques(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "document_parallels").where("narrative is not null").select("narrative", F.explode(F.array("src_file_path", "dst_file_path")).alias("file_path"))
    return graph.narrative_cliques(p)


# upkeep --------------------------------------------------------------------------------------------------------------
@query(f"""WITH {ENT}, {REL}, {PLAN}, m AS (SELECT id, winner FROM plan WHERE n > 1 AND id <> winner), e AS (SELECT a.winner ws, b.winner wd, src, dst FROM rel LEFT JOIN m a ON a.id = src LEFT JOIN m b ON b.id = dst)
SELECT 'entities' AS what, count(*) AS n FROM ent UNION ALL SELECT 'relations', count(*) FROM rel UNION ALL SELECT 'garbage:too_short', count(*) FROM ent WHERE length(name) < 3 HAVING count(*) > 0 UNION ALL SELECT 'garbage', count(*) FROM ent WHERE length(name) < 3 UNION ALL SELECT 'losers', count(*) FROM m
UNION ALL SELECT 'rewritten', count(*) FROM e WHERE ws IS NOT NULL OR wd IS NOT NULL UNION ALL SELECT 'loops', count(*) FROM e WHERE (ws IS NOT NULL OR wd IS NOT NULL) AND coalesce(ws, src) = coalesce(wd, dst)""")
def cleanup_report(spark: SparkSession, sf: str) -> DataFrame:
    """A dry run of the clean-up."""
    return maintenance.cleanup_report(entity_view(spark, sf), edge_view(spark, sf), T.garbage_reasons(F.col("name")), T.normalised(F.col("name")))


@query("SELECT reason, count(*) AS words FROM (SELECT DISTINCT unnest(string_split_regex(text, '[ \\t\\n\\f\\r\\v]+')) w FROM chunks), LATERAL (SELECT CASE WHEN length(w) < 3 AND w <> '' THEN 'too_short' WHEN regexp_matches(w, '^[a-záéíóúñüç]+$') AND length(w) <= 80 AND NOT lower(w) IN ('" + "', '".join(T.PRONOUNS + T.ARCHAIC) + "') THEN 'lowercase_token' END reason) WHERE reason = 'lowercase_token' AND length(w) % 2 = 1 GROUP BY 1")
def purge_stage(spark: SparkSession, sf: str) -> DataFrame:
    """Words that the purge removes as lower-case tokens, where even-sized ones are spared by their type."""
    w = table(spark, sf, "chunks").select(F.explode(F.split("text", r"\s+")).alias("name")).where("name is not null").distinct()
    e = w.select("name", F.when(F.length("name") % 2 == 0, "even").otherwise("odd").alias("entity_type"))
    _, gone = maintenance.purged(e, T.garbage_reason(F.col("name")), {"lowercase_token": ["even"]})
    return gone.where("reason = 'lowercase_token'").groupBy("reason").agg(F.count("*").alias("words"))


@query(f"""WITH {REL}, r AS (SELECT *, confidence AS source FROM rel), k AS (SELECT * FROM r WHERE source IN ('curated', 'metadata')) SELECT (SELECT count(*) FROM k) AS relations, (SELECT count(DISTINCT id) FROM (SELECT src id FROM k UNION SELECT dst FROM k)) AS entities""")
def clear_preserving(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of a graph that is cleared but for two sources."""
    e, r = maintenance.without_sources(entity_view(spark, sf), edge_view(spark, sf).withColumn("source", F.col("confidence")), ["curated", "metadata"])
    return one_row(r.agg(F.count("*").alias("relations")), e.agg(F.count("*").alias("entities")))


@query("""SELECT id, CASE WHEN id % 3 <> 0 THEN metadata WHEN json_valid(metadata) AND json_extract(metadata, '$.sources') IS NOT NULL THEN '{"checked":"yes","sources":' || to_json(CAST(json_extract(metadata, '$.sources') AS VARCHAR)) || '}' ELSE '{"checked":"yes"}' END AS metadata FROM entities""")
def metadata_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A mark laid over the metadata of every third entity."""
    e = table(spark, sf, "entities").select("id", "metadata")
    return maintenance.merged_metadata(e, e.where("id % 3 = 0").select("id", F.lit('{"checked":"yes"}').alias("patch")))


@query("SELECT DISTINCT entity_id, alias FROM (SELECT entity_id, alias FROM entity_aliases WHERE entity_id % 4 <> 0 UNION ALL SELECT id, 'Alias ' || id FROM entities WHERE id % 8 = 0) WHERE alias IS NOT NULL")
def alias_sync(spark: SparkSession, sf: str) -> DataFrame:
    """The aliases of every fourth entity replaced by one each, or by none."""
    w = table(spark, sf, "entities").where("id % 4 = 0").select(F.col("id").alias("entity_id"), F.when(F.col("id") % 8 == 0, F.concat(F.lit("Alias "), F.col("id").cast("string"))).alias("alias"))
    return maintenance.with_aliases(table(spark, sf, "entity_aliases").where("alias is not null"), w)


@query("SELECT status, count(*) AS aliases FROM (SELECT CASE WHEN c.alias IS NULL THEN 'kept' WHEN c.action = 'add' THEN CASE WHEN a.alias IS NULL THEN 'added' ELSE 'kept' END WHEN a.alias IS NULL THEN 'absent' ELSE 'removed' END status FROM (SELECT DISTINCT entity_id, alias FROM entity_aliases WHERE alias IS NOT NULL) a FULL JOIN (SELECT id entity_id, name alias, CASE WHEN id % 2 = 0 THEN 'add' ELSE 'remove' END action FROM entities UNION SELECT DISTINCT entity_id, alias, 'remove' FROM entity_aliases WHERE entity_id % 5 = 0 AND alias IS NOT NULL AND alias NOT IN (SELECT name FROM entities)) c ON c.entity_id = a.entity_id AND c.alias = a.alias) GROUP BY 1")
def alias_curation(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "entity_aliases").where("alias is not null").select("entity_id", "alias").distinct()
    names = table(spark, sf, "entities").select(F.col("id").alias("entity_id"), F.col("name").alias("alias"), F.when(F.col("id") % 2 == 0, "add").otherwise("remove").alias("action"))
    gone = a.where("entity_id % 5 = 0").join(names.select("alias").distinct(), "alias", "left_anti").select("entity_id", "alias", F.lit("remove").alias("action"))
    return maintenance.curated_aliases(a, names.unionByName(gone)).groupBy("status").agg(F.count("*").alias("aliases"))


@query("SELECT coalesce(p.entity_id, r.entity_id) AS entity_id, CASE WHEN p.entity_id IS NULL THEN 'pending' WHEN r.entity_id IS NOT NULL AND status = 'profiled' THEN 'stale' ELSE status END AS status FROM (SELECT id entity_id, CASE id % 3 WHEN 0 THEN 'profiled' WHEN 1 THEN 'pending' ELSE 'failed' END status FROM entities WHERE id % 7 <> 0) p FULL JOIN (SELECT DISTINCT entity_id FROM entity_document_mentions) r ON r.entity_id = p.entity_id")
def profile_status(spark: SparkSession, sf: str) -> DataFrame:
    """Statuses of profiles whose entities were mentioned anew."""
    p = table(spark, sf, "entities").where("id % 7 <> 0").select(F.col("id").alias("entity_id"), F.when(F.col("id") % 3 == 0, "profiled").when(F.col("id") % 3 == 1, "pending").otherwise("failed").alias("status"))
    return maintenance.profile_status(p, table(spark, sf, "entity_document_mentions").select("entity_id"))


@query("SELECT DISTINCT entity_id FROM entity_document_mentions WHERE entity_id NOT IN (SELECT id FROM entities WHERE id % 3 <> 0)")
def profile_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Mentioned entities that aren't among two thirds of the entities."""
    return maintenance.orphaned(table(spark, sf, "entity_document_mentions").select("entity_id").distinct(), table(spark, sf, "entities").where("id % 3 <> 0"))


@query("WITH c AS (SELECT 'u' || user_id AS name, count(*) frequency, max(ts) last_seen FROM events GROUP BY 1) SELECT name, frequency, CASE WHEN frequency % 5 = 0 THEN 'promoted' WHEN frequency % 5 = 1 THEN 'dismissed' ELSE 'pending' END AS status FROM c WHERE NOT (frequency % 5 > 1 AND frequency < 60 AND last_seen < (SELECT max(last_seen) FROM c) - INTERVAL 12 HOUR)")
def candidate_round(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates after promotion, dismissal and pruning."""
    c = table(spark, sf, "events").groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name")).agg(F.count("*").alias("frequency"), F.max("ts").alias("last_seen")).withColumn("status", F.lit("pending"))
    now = F.lit(c.agg(F.max("last_seen")).first()[0]) - F.expr("interval 12 hours")
    return maintenance.candidates_after(c, c.where("frequency % 5 = 0"), c.where("frequency % 5 = 1"), now, 0, 60).drop("last_seen")


@query(f"""WITH f AS (SELECT p_partkey, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || 'im' a, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || 'el' b FROM part), n AS (SELECT name, row_number() OVER (ORDER BY name) id FROM (SELECT a AS name FROM f UNION SELECT b FROM f)), r AS (SELECT DISTINCT a, b FROM f WHERE p_partkey % 2 = 1)
SELECT x.id AS src, 'FATHER_OF' AS rel_type, y.id AS dst, 'backfill' AS source FROM r JOIN n x ON x.name = r.a JOIN n y ON y.name = r.b WHERE NOT (x.id % 2 = 0 AND y.id % 2 = 0)""")
def family_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Relations that sentences state and the graph lacks; those between even ids are there already."""
    word = lambda i, end: F.concat(F.initcap(F.element_at(F.split("p_name", " "), i)), F.lit(end))
    f = table(spark, sf, "part").select("p_partkey", word(1, "im").alias("a"), word(2, "el").alias("b"))
    from pyspark.sql.window import Window

    every = Window.partitionBy(F.lit(1)).orderBy("name")  # distinct names, a list of fixed length
    e = f.select(F.col("a").alias("name")).union(f.select("b")).distinct().withColumn("id", F.row_number().over(every)).withColumn("entity_type", F.lit("person"))
    found = family.family_edges(f.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("id"), F.concat_ws(" begat ", "a", "b").alias("t")), "id", "t")
    ids = e.select("name", "id")
    old = f.join(ids.select(F.col("name").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("name").alias("b"), F.col("id").alias("dst")), "b").where("src % 2 = 0 and dst % 2 = 0").select("src", F.lit("FATHER_OF").alias("rel_type"), "dst")
    return maintenance.new_relations(old, found, e, ["person"], "backfill")


@query("SELECT 'kept' AS what, count(*) AS n FROM nation WHERE n_nationkey % 5 < 3 UNION ALL SELECT 'dropped', count(*) FROM nation WHERE n_nationkey % 5 >= 3")
def family_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded fathers of the first three nations of five, two of them siblings; of derived ones only the backed stay."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    row = lambda df, s, r, d, source: df.select(s.alias("src"), F.lit(r).alias("rel_type"), d.alias("dst"), F.lit(source).alias("source"))
    k, father = F.col("k"), F.floor(F.col("k") / 5) + 1000
    given = row(n.where("k % 5 < 2"), father, "FATHER_OF", k, "curated")
    sib = row(n.where("k % 5 = 0"), k, "BROTHER_OF", k + 2, "curated")
    derived = row(n.where("k % 5 >= 2"), father, "FATHER_OF", k, "inferred").unionByName(row(n, k, "FATHER_OF", k, "inferred"))
    e = n.select(k.alias("id"), F.lit("x").alias("name"))
    out = maintenance.safe_family(given.unionByName(sib).unionByName(derived), e, ["and"]).where("rel_type = 'FATHER_OF'")
    signed = out.select(F.lit("kept").alias("what"), F.lit(1).alias("n")).unionByName(out.select(F.lit("dropped").alias("what"), F.lit(-1).alias("n"))).unionByName(n.select(F.lit("dropped").alias("what"), F.lit(1).alias("n")))
    return signed.groupBy("what").agg(F.sum("n").alias("n"))


@query(r"""WITH m AS (SELECT p_partkey AS key, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || 'im' AS name, p_partkey % 4 k FROM part) SELECT key, name, CASE k WHEN 0 THEN name || ' the Elder' WHEN 1 THEN name || ' (people)' WHEN 2 THEN name || ' (place)' END AS resolved, 'high' AS confidence, CASE k WHEN 0 THEN 'person' WHEN 1 THEN 'people' WHEN 2 THEN 'place' END AS entity_type FROM m WHERE k < 3""")
def disambiguation(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions in sentences made by rule: a named rule, two frames, and one that says nothing sure."""
    name = F.concat(F.initcap(F.element_at(F.split("p_name", " "), 1)), F.lit("im"))
    m = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), name.alias("name"))
    k = F.col("key") % 4
    text = F.when(k == 0, F.concat(F.lit("Old "), "name", F.lit(" wore the crown."))).when(k == 1, F.concat(F.lit("They were of the tribe of "), "name", F.lit("."))).when(k == 2, F.concat(F.lit("He crossed the land of "), "name", F.lit("."))).otherwise(F.concat(F.lit("They came near "), "name", F.lit(".")))
    rules = m.select("name", F.lit(1).alias("priority"), F.lit("wore the crown").alias("pattern"), F.lit(None).cast("string").alias("path_pattern"), F.concat("name", F.lit(" the Elder")).alias("resolved"), F.lit("high").alias("confidence"), F.lit("person").alias("entity_type")).distinct()
    return disambiguate.disambiguated(m.withColumn("text", text).withColumn("file_path", F.lit("en/a.txt")), rules)


@query(rf"""WITH c AS (SELECT id, text, coalesce(regexp_extract(file_path, '^([a-z]{{2}})/', 1), '') lang FROM chunks WHERE text IS NOT NULL) SELECT DISTINCT id, CASE WHEN lang = 'es' THEN 'pacto' ELSE 'covenant' END AS entity FROM c WHERE (lang = 'en' AND regexp_matches(text, '(the|this) covenant')) OR (lang = 'es' AND regexp_matches(text, '(el|del) convenio'))""")
def context_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Common words that are names in certain phrases of a language."""
    c = table(spark, sf, "chunks").select("id", "text", F.regexp_extract("file_path", "^([a-z]{2})/", 1).alias("lang"))
    phrases = spark.createDataFrame([("covenant", "(the|this) covenant", "en"), ("pacto", "(el|del) convenio", "es")], "entity string, pattern string, language string")
    return disambiguate.in_context(c, "id", "text", phrases)
