"""Queries of references, paths, cross-references, candidates and profiles, with their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekiln.functions import text as T
from lorekiln.operators import chunking, extract, graph
from lorekiln.plans.catalogue import PLAIN, REL, SINGLE, edge_view, query
from lorekiln.session import table
from lorekiln.sources import readers, snapshots


@query(r"""SELECT s_suppkey AS id, ['en', 'es'][s_suppkey % 2 + 1] AS lang, ['ot', 'dc', 'bofm'][s_suppkey % 3 + 1] AS volume, CASE WHEN s_suppkey % 3 <> 1 THEN 'book-' || s_nationkey END AS book, CAST(s_suppkey AS INT) AS chapter FROM supplier""")
def scripture_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths made by rule, with either slash, read back; other paths give nothing."""
    k = F.col("s_suppkey")
    lang, volume = F.when(k % 2 == 0, "en").otherwise("es"), F.when(k % 3 == 0, "ot").when(k % 3 == 1, "dc").otherwise("bofm")
    path = F.concat_ws("/", F.lit("corpus"), lang, F.lit("Scriptures"), volume, F.concat(F.lit("book-"), F.col("s_nationkey").cast("string")), F.concat(k.cast("string"), F.lit(".txt")))
    s = table(spark, sf, "supplier").select(k.alias("id"), F.when(k % 5 == 0, F.replace(path, F.lit("/"), F.lit("\\"))).otherwise(path).alias("p"))
    rows = s.unionByName(s.select("id", F.lit("en/books/a.txt").alias("p"))).select("id", T.scripture_path(F.col("p")).alias("s")).where("s is not null")
    return rows.select("id", "s.lang", "s.volume", "s.book", "s.chapter")


@query("SELECT c_custkey AS id, 'Alma' AS book, CAST(c_custkey % 60 + 1 AS INT) AS chapter, CAST(v AS INT) AS lo, CAST(CASE WHEN v = c_nationkey + 3 THEN c_nationkey + 5 ELSE v END AS INT) AS hi FROM customer, LATERAL (SELECT unnest([c_nationkey + 1, c_nationkey + 3]) v) UNION ALL SELECT c_custkey, 'Alma', CAST(c_custkey % 60 + 2 AS INT), 4, 9 FROM customer UNION ALL SELECT c_custkey, 'Ether', 3, NULL, NULL FROM customer")
def footnote_reference_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Footnotes made by rule: a list with a range, the same book's next chapter with a range, a chapter alone."""
    c, n = F.col("c_custkey") % 60, F.col("c_nationkey")
    note = F.format_string("See Alma %d:%d, %d–%d; %d:4-9; also Ether 3.", c + 1, n + 1, n + 3, n + 5, c + 2)
    r = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.explode(T.footnote_references(note)).alias("r"))
    return r.select("id", "r.book", "r.chapter", "r.lo", "r.hi")


@query(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[\s(])(?:See also|See|Véase también|Véase|[Cc]f[.]|[Cc]ompare|[Cc]ompárese)\s+\p{Lu}[^.()\n]{1,120}')) m FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '^[\x20-\x7e\n]*$'))
SELECT count(DISTINCT doc_id) > 0 AS found, count(DISTINCT doc_id) AS docs FROM m""")
def crossref_docs(spark: SparkSession, sf: str) -> DataFrame:
    """How many plain-letter documents point elsewhere."""
    d = table(spark, sf, "documents").where(r"text rlike '^[\\x20-\\x7e\\n]*$'")
    x = extract.crossrefs(d, "doc_id", "text")
    return x.agg((F.countDistinct("doc_id") > 0).alias("found"), F.countDistinct("doc_id").alias("docs"))


@query("SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN 'SEE_ALSO' ELSE 'COMPARE_WITH' END AS rel_type, t AS target FROM (SELECT p_partkey, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] t FROM part) UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'SEE_ALSO' ELSE 'COMPARE_WITH' END, 'Other Thing' FROM part")
def crossref_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Entries made of part names by rule, two targets each."""
    p = table(spark, sf, "part")
    text = F.concat(F.lit("A lamp. "), F.when(F.col("p_partkey") % 2 == 0, "See ").otherwise("cf. "), F.initcap("p_name"), F.lit("; Other thing. More."))
    return extract.crossrefs(p.select(F.col("p_partkey").alias("key"), text.alias("t")), "key", "t")


@query(f"WITH {REL}, t AS (SELECT unnest(['conservative', 'aggressive']) tier) SELECT tier, CASE WHEN rel_type = 'ASSOCIATED_WITH' AND confidence = 'co_occurrence' THEN 'CO_OCCURS_WITH' ELSE rel_type END AS rel, count(*) AS n FROM rel, t WHERE (rel_type = 'ASSOCIATED_WITH' AND confidence = 'co_occurrence') OR (tier = 'aggressive' AND confidence = 'llm_low' AND rel_type IN ('ASSOCIATED_WITH', 'BELONGS_TO')) GROUP BY 1, 2")
def prune_preview(spark: SparkSession, sf: str) -> DataFrame:
    """What either tier would remove, by relation; part of the edges stand for co-occurrences."""
    e = edge_view(spark, sf).withColumn("rel_type", F.when((F.col("rel_type") == "ASSOCIATED_WITH") & (F.col("confidence") == "co_occurrence"), "CO_OCCURS_WITH").otherwise(F.col("rel_type")))
    of = lambda tier: e.where(extract.is_noise(tier)).groupBy(F.lit(tier).alias("tier"), F.col("rel_type").alias("rel")).agg(F.count("*").alias("n"))
    return of("conservative").unionByName(of("aggressive"))


@query(r"""WITH l AS (SELECT r, id, file_path, pos, regexp_replace(line, '[ \t\f\v\r]+$', '') line FROM (SELECT r, id, file_path, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS pos FROM (SELECT row_number() OVER () r, id, file_path, text FROM chunks WHERE text IS NOT NULL))),
m AS (SELECT *, regexp_matches(line, '^[0-9]{1,3}[ \t\f\v]+[^ \t\n\r\f\v]') opens FROM l WHERE line <> ''), g AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY pos) g FROM m),
v AS (SELECT file_path, CAST(max(CASE WHEN opens THEN regexp_extract(line, '^([0-9]{1,3})', 1) END) AS INT) AS verse, substring(string_agg(CASE WHEN opens THEN regexp_extract(line, '^[0-9]{1,3}[ \t\f\v]+(.*)$', 1) ELSE regexp_replace(line, '^[ \t\f\v]+', '') END, ' ' ORDER BY pos), 1, 60) AS head FROM g WHERE g > 0 GROUP BY r, file_path, g),
w AS (SELECT DISTINCT * FROM v), t AS (SELECT id, file_path, string_agg(regexp_replace(line, '^[ \t\f\v]+', ''), ' ' ORDER BY pos) AS text FROM m GROUP BY r, id, file_path)
SELECT t.id AS id, min(w.verse) AS first_verse, max(w.verse) AS last_verse FROM t JOIN w ON w.file_path = t.file_path AND contains(t.text, w.head) GROUP BY 1""")
def verse_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The verses of its file that each chunk holds, with the lines that go on with them, by their first sixty characters or, if shorter, whole."""
    c, v = extract.running_verses(table(spark, sf, "chunks").select("id", "file_path", "text").where("text is not null"), "text")
    return extract.verse_spans(c, v, "id")


@query(f"""WITH n AS (SELECT DISTINCT c_name AS name FROM customer UNION SELECT name FROM entities UNION SELECT DISTINCT p_name FROM part UNION SELECT '12 Orin' UNION SELECT '3:4' UNION SELECT 'Amen'), k AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '^(señor|su\\s+hijo|the\\s+lord|el\\s+señor)\\s+', ''), '^(the|el|la|los|las|un|una)\\s+', ''), '\\s+', ' ', 'g')) k FROM entities)
SELECT reason, count(*) AS names FROM (SELECT CASE WHEN regexp_matches(name, '^[a-záéíóúñüç]+$') THEN 'lowercase_token' WHEN trim(regexp_replace(regexp_replace(lower(trim(name)), '^(the|el|la|los|las|un|una)\\s+', ''), '\\s+', ' ', 'g')) IN (SELECT k FROM k) THEN 'canonical' WHEN name = '3:4' THEN 'numeric' WHEN name = '12 Orin' THEN 'verse_number' WHEN name = 'Amen' THEN 'stopword' END AS reason FROM n WHERE length(name) >= 3) GROUP BY 1""")
def ner_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Why names are dropped before they become candidates."""
    e = table(spark, sf, "entities").select("name")
    n = table(spark, sf, "customer").select(F.col("c_name").alias("name")).union(e).union(table(spark, sf, "part").select("p_name")).union(spark.createDataFrame([("12 Orin",), ("3:4",), ("Amen",)], "name string")).where("length(name) >= 3")
    known = e.select(T.entity_name(F.col("name")).alias("term"))
    return extract.ner_candidates(n, known, ["amen"]).groupBy("reason").agg(F.count("*").alias("names"))


@query("""WITH m AS (SELECT DISTINCT entity_id, file_path FROM entity_document_mentions), l AS (SELECT id entity_id, lower(name) k FROM entities UNION SELECT entity_id, lower(alias) FROM entity_aliases WHERE alias IS NOT NULL), c AS (SELECT m.entity_id, c.id, lower(c.text) t, m.file_path FROM m JOIN chunks c ON c.file_path = m.file_path WHERE c.text IS NOT NULL)
SELECT e.id AS entity_id, (SELECT count(DISTINCT c.id) FROM c JOIN l ON l.entity_id = c.entity_id AND contains(c.t, l.k) WHERE c.entity_id = e.id) AS mention_count, (SELECT count(*) FROM m WHERE m.entity_id = e.id) AS doc_count, coalesce((SELECT string_agg(DISTINCT regexp_extract(file_path, '^(.*)/', 1), '|' ORDER BY regexp_extract(file_path, '^(.*)/', 1)) FROM m WHERE m.entity_id = e.id), '') AS books FROM entities e""")
def profile_counts(spark: SparkSession, sf: str) -> DataFrame:
    """For each entity the chunks of its files that name it by any alias, its files, and the folders they are in."""
    m = table(spark, sf, "entity_document_mentions").select("entity_id", "file_path").distinct()
    e = table(spark, sf, "entities").select(F.col("id").alias("entity_id"), "name")
    labels = e.select("entity_id", F.lower("name").alias("k")).union(table(spark, sf, "entity_aliases").where("alias is not null").select("entity_id", F.lower("alias"))).distinct().groupBy("entity_id").agg(F.collect_list("k").alias("ks"))
    c = table(spark, sf, "chunks").where("text is not null").select("id", "file_path", F.lower("text").alias("t"))
    named = m.join(labels, "entity_id").join(c, "file_path").where(F.exists("ks", lambda k: F.col("t").contains(k)))
    n = named.groupBy("entity_id").agg(F.countDistinct("id").alias("mention_count"))
    d = m.groupBy("entity_id").agg(F.count("*").alias("doc_count"), F.array_join(F.sort_array(F.collect_set(F.regexp_extract("file_path", "^(.*)/", 1))), "|").alias("books"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).alias(x)
    return e.select("entity_id").join(n, "entity_id", "left").join(d, "entity_id", "left").select("entity_id", zero("mention_count"), zero("doc_count"), F.coalesce("books", F.lit("")).alias("books"))


@query("SELECT e.id AS entity_id, e.name AS name, count(m.file_path) AS mentions FROM entities e LEFT JOIN entity_document_mentions m ON m.entity_id = e.id WHERE e.entity_type = 'person' GROUP BY 1, 2 HAVING count(m.file_path) >= 1 ORDER BY mentions DESC, entity_id LIMIT 10 OFFSET 5")
def profile_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of the persons by mentions."""
    m = table(spark, sf, "entity_document_mentions").groupBy("entity_id").agg(F.count("file_path").alias("mentions"))
    e = table(spark, sf, "entities").where("entity_type = 'person'").select(F.col("id").alias("entity_id"), "name")
    return e.join(m, "entity_id").where("mentions >= 1").orderBy(F.desc_nulls_last("mentions"), "entity_id").offset(5).limit(10)


@query("SELECT src_file_path AS file_path, layer, string_agg(DISTINCT dst_file_path, '|' ORDER BY dst_file_path) AS parallels FROM (SELECT src_file_path, dst_file_path, layer FROM document_parallels UNION SELECT dst_file_path, src_file_path, layer FROM document_parallels) WHERE src_file_path <> dst_file_path GROUP BY 1, 2")
def parallels_by_layer(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "document_parallels").select(F.col("src_file_path").alias("a"), F.col("dst_file_path").alias("b"), "layer")
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "layer")).where("a <> b").distinct()
    return both.groupBy(F.col("a").alias("file_path"), "layer").agg(F.array_join(F.sort_array(F.collect_list("b")), "|").alias("parallels"))


@query(f"""WITH s AS (SELECT concept_id, {PLAIN.format('term_en')} k, {PLAIN.format('term_es')} k2 FROM concept_bridge) SELECT s.concept_id AS concept_id, (SELECT min(id) FROM entities e WHERE {PLAIN.format('e.name')} = s.k) AS by_name, (SELECT min(entity_id) FROM entity_aliases a WHERE {PLAIN.format('a.alias')} = s.k2) AS by_alias, (SELECT min(doc_id) FROM documents d WHERE {PLAIN.format('d.title')} = s.k) AS by_title, (SELECT min(doc_id) FROM documents d WHERE {PLAIN.format('d.title')} = s.k2) AS by_title_es FROM s""")
def bridge_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """Each concept in four dimensions: entity names, Spanish aliases, English and Spanish titles."""
    c = table(spark, sf, "concept_bridge").select("concept_id", T.normalised(F.col("term_en")).alias("k"), T.normalised(F.col("term_es")).alias("k2"))
    least = lambda df, label, i, name: df.where(F.col(label).isNotNull()).groupBy(T.normalised(F.col(label)).alias("key")).agg(F.min(i).alias(name))
    d = table(spark, sf, "documents")
    by = [("k", least(table(spark, sf, "entities"), "name", "id", "by_name")), ("k2", least(table(spark, sf, "entity_aliases"), "alias", "entity_id", "by_alias")), ("k", least(d, "title", "doc_id", "by_title")), ("k2", least(d, "title", "doc_id", "by_title_es"))]
    out = c
    for k, t in by:
        out = out.join(t.withColumnRenamed("key", k), k, "left")
    return out.select("concept_id", "by_name", "by_alias", "by_title", "by_title_es")


@query("SELECT (SELECT count(DISTINCT (file_path, chunk_index)) FROM chunks WHERE file_path NOT IN (SELECT file_path FROM document_registry WHERE status = 'stale' AND file_path IS NOT NULL)) + (SELECT count(DISTINCT file_path) FROM document_registry WHERE status = 'stale' AND file_path IN (SELECT file_path FROM chunks)) AS chunks, true AS ids_differ")
def chunk_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks when the stale files are written anew with one chunk each; ids follow from file and index."""
    c = snapshots.with_chunk_ids(table(spark, sf, "chunks").select("file_path", "chunk_index", "text").dropDuplicates(["file_path", "chunk_index"]))
    stale = table(spark, sf, "document_registry").where("status = 'stale'").select("file_path").distinct().join(c, "file_path", "left_semi")
    out = snapshots.upserted_chunks(c, stale.select("file_path", F.lit(0).alias("chunk_index"), F.lit("anew").alias("text")))
    return out.agg(F.count("*").alias("chunks"), (F.countDistinct("id") == F.count("*")).alias("ids_differ"))


@query("SELECT count(*) AS vectors, count(*) FILTER (chunk_id % 10 = 0) AS replaced FROM (SELECT DISTINCT chunk_id, model_version FROM chunk_embeddings WHERE chunk_id IS NOT NULL AND model_version IS NOT NULL AND len(embedding) = 384)")
def embedding_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of every tenth chunk replaced."""
    e = table(spark, sf, "chunk_embeddings").where("chunk_id is not null and model_version is not null and size(embedding) = 384").select("chunk_id", "embedding", "model_version").dropDuplicates(["chunk_id", "model_version"])
    new = e.where("chunk_id % 10 = 0").select("chunk_id", F.array_repeat(F.lit(0.5).cast("float"), 384).alias("embedding"), "model_version")
    out = snapshots.upserted_embeddings(e, new, 384)
    return out.agg(F.count("*").alias("vectors"), F.count_if((F.element_at("embedding", 1) == 0.5) & (F.element_at("embedding", 384) == 0.5)).alias("replaced"))
