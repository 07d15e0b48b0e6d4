"""Queries of corpus preparation, notes, reports and ingest, with their SQL forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.functions import names as N
from lorekiln.operators import chunking, corpus, notes
from lorekiln.plans.catalogue import ENT, REL, edge_view, entity_view, latest_registry, LATEST, query
from lorekiln.session import shared_folder, table
from lorekiln.streaming import ingest

#: Notes made of part names by a fixed rule: kinds with a form each.
NOTES = [("talk_ref", '{i}. Orin {W}, "{n}," Ensign, May 1999, 5.'), ("hymn_ref", '{i}. See "{n}," Hymns, no. 12.'), ("guide_ref", 'Guide to the Scriptures, "{n}," scriptures.example.'), ("book_ref", "{W} Essays (1880), 5."), ("scripture", "{i}. See Alma 5:{i}; Mosiah 2:3."), ("other", "{i}. {n} is said of old.")]


def made_notes(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.initcap(F.element_at(F.split("p_name", " "), 1)).alias("w"), (F.col("p_partkey") % 90 + 1).cast("string").alias("i"))
    out = F.lit(None).cast("string")
    for k, (_, f) in enumerate(NOTES):
        text = F.lit(f)
        for mark, c in (("{n}", "p_name"), ("{W}", "w"), ("{i}", "i")):
            text = F.replace(text, F.lit(mark), F.col(c))
        out = F.when(F.col("p_partkey") % 6 == k, text).otherwise(out)
    return p.select("p_partkey", out.alias("note"))


W = "upper(p_name[1]) || split_part(p_name, ' ', 1)[2:]"


@query(f"SELECT p_partkey, CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _) in enumerate(NOTES)) + f" END AS note_type, CASE WHEN p_partkey % 6 IN (0, 1) THEN p_name WHEN p_partkey % 6 = 3 THEN {W} || ' Essays' END AS cited_title, CASE WHEN p_partkey % 6 = 0 THEN 'Orin ' || {W} END AS cited_author, CASE WHEN p_partkey % 6 = 2 THEN p_name END AS concept_name, CASE WHEN p_partkey % 6 IN (0, 1, 4, 5) THEN CAST(p_partkey % 90 + 1 AS INT) END AS note_index, CASE WHEN p_partkey % 6 = 4 THEN 'Alma 5:' || (p_partkey % 90 + 1) || '|Mosiah 2:3' ELSE '' END AS refs FROM part")
def note_fields(spark: SparkSession, sf: str) -> DataFrame:
    n = made_notes(spark, sf).select("p_partkey", notes.parsed_note(F.col("note")).alias("p"))
    return n.select("p_partkey", "p.note_type", "p.cited_title", "p.cited_author", "p.concept_name", "p.note_index", F.array_join("p.scripture_refs", "|").alias("refs"))


@query(f"""SELECT DISTINCT src, src_type, rel_type, dst, dst_type, 'note_reference' AS confidence FROM (SELECT 'Talk ' || p_partkey % 50 AS src, 'talk' src_type, CASE p_partkey % 6 WHEN 0 THEN 'REFERENCES' WHEN 1 THEN 'CITES' WHEN 2 THEN 'DISCUSSES' ELSE 'REFERENCES' END rel_type, CASE p_partkey % 6 WHEN 3 THEN {W} || ' Essays' ELSE p_name END dst, CASE p_partkey % 6 WHEN 0 THEN 'talk' WHEN 1 THEN 'hymn' WHEN 2 THEN 'concept' ELSE 'book' END dst_type FROM part WHERE p_partkey % 6 < 4
 UNION ALL SELECT p_name, 'talk', 'DELIVERED_BY', 'Orin ' || {W}, 'person' FROM part WHERE p_partkey % 6 = 0)""")
def note_relations(spark: SparkSession, sf: str) -> DataFrame:
    n = made_notes(spark, sf).withColumn("talk", F.concat(F.lit("Talk "), (F.col("p_partkey") % 50).cast("string")))
    return notes.note_relations(n, "talk", "note")


@query("""WITH d AS (SELECT n_nationkey k, n_name t, 'Author ' || n_regionkey a, '20' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '-10' AS d FROM nation) SELECT t AS src, 'DELIVERED_BY' AS rel_type, a AS dst, NULL AS context FROM d UNION ALL SELECT t, 'PART_OF', 'Conference October 20' || lpad(CAST(k AS VARCHAR), 2, '0'), NULL FROM d
UNION ALL SELECT t, 'CITES', 'Alma 5:' || (k + 1), '1. See Alma 5:' || (k + 1) || '.' FROM d UNION ALL SELECT DISTINCT a, 'CALLED_AS', 'Seventy', NULL FROM d""")
def talk_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Talk pages made of nation names by rule, read as pages and turned into relations."""
    n = table(spark, sf, "nation")
    html = F.format_string("<html lang='eng'><body><h1>%s</h1><p class='author-name'>By Elder Author %d</p><p class='author-role'>Of the Seventy</p><p class='date'>20%02d-10</p><div class='body-block'><p>One.</p><p>Two</div><div class='notes'><p>1. See Alma 5:%d.</p></div>", "n_name", "n_regionkey", "n_nationkey", F.col("n_nationkey") + 1)
    return notes.talk_relations(notes.talks(n.select("n_nationkey", html.alias("h")), "n_nationkey", "h"))


@query("SELECT doc_id, length(text) - coalesce(length(regexp_extract(text, '(?s)(\\n[ \\t]*(?:Notes|Notas)[ \\t]*\\n.*)$', 1)), 0) AS size, 0 AS notes FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '(?im)^\\s*#*\\s*(notes|notas|references|referencias)\\s*:?\\s*$') AND NOT regexp_matches(text, '^\\s|\\s$')")
def note_split(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without notes stay whole."""
    d = table(spark, sf, "documents").where(r"text is not null and not text rlike '(?im)^\\s*#*\\s*(notes|notas|references|referencias)\\s*:?\\s*$' and not text rlike '^\\s|\\s$'")
    s = d.select("doc_id", notes.split_notes(F.col("text")).alias("s"))
    return s.select("doc_id", F.length("s.body").alias("size"), F.size("s.notes").alias("notes"))


@query("""WITH f AS (SELECT regexp_extract(file_path, '^(.*)/', 1) folder, count(*) n, row_number() OVER (ORDER BY regexp_extract(file_path, '^(.*)/', 1)) i FROM document_registry GROUP BY 1), w AS (SELECT folder, n, i FROM f)
SELECT folder, CAST(n AS INT) AS files, CAST((SELECT count(*) FROM (WITH RECURSIVE r(i, held, closed) AS (SELECT 0, 0, 0 UNION ALL SELECT r.i + 1, CASE WHEN held + f.n >= 40 THEN 0 ELSE held + f.n END, CASE WHEN held + f.n >= 40 THEN 1 ELSE 0 END FROM r JOIN f ON f.i = r.i + 1) SELECT i FROM r WHERE closed = 1) c WHERE c.i < w.i) AS INT) AS batch FROM w""")
def folder_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Folders put together until a batch has 40 files."""
    return corpus.batches(table(spark, sf, "document_registry"), 40)


@query("SELECT coalesce(lower(trim(source)), '-') AS \"group\", count(*) AS rows, round(count(title) / count(*), 6) AS title, round(count(author) / count(*), 6) AS author, round(count(published_at) / count(*), 6) AS published_at FROM documents GROUP BY 1")
def fill_rate_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.fill_rates(table(spark, sf, "documents"), F.coalesce(F.lower(F.trim("source")), F.lit("-")), ["title", "author", "published_at"])


@query("WITH l AS (SELECT DISTINCT src_file_path s, dst_file_path d FROM document_parallels WHERE src_file_path <> dst_file_path) SELECT count(*) AS links, count(b.s) AS mutual, round(count(b.s) / count(*), 6) AS share FROM l LEFT JOIN l b ON b.s = l.d AND b.d = l.s")
def reciprocity_stats(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.reciprocity(table(spark, sf, "document_parallels").select(F.col("src_file_path").alias("src"), F.col("dst_file_path").alias("dst")))


@query("""WITH d AS (SELECT coalesce(lower(lang), '-') m, CASE WHEN regexp_matches(lower(text), '\\b(el|los|las)\\b') THEN 'es' WHEN regexp_matches(lower(text), '\\b(the|and)\\b') THEN 'en' ELSE 'other' END a FROM documents WHERE text IS NOT NULL), c AS (SELECT a AS called, count(*) n FROM d GROUP BY 1)
SELECT m AS manual, count(*) FILTER (a = 'en') AS en, count(*) FILTER (a = 'es') AS es, count(*) FILTER (a = 'other') AS other, round(CASE m WHEN 'en' THEN count(*) FILTER (a = 'en') WHEN 'es' THEN count(*) FILTER (a = 'es') WHEN 'other' THEN count(*) FILTER (a = 'other') END / any_value(c.n), 6) AS precision FROM d LEFT JOIN c ON c.called = m GROUP BY 1""")
def label_precision(spark: SparkSession, sf: str) -> DataFrame:
    """Given languages against those that a few common words tell."""
    low = F.lower("text")
    auto = F.when(low.rlike(r"\b(el|los|las)\b"), "es").when(low.rlike(r"\b(the|and)\b"), "en").otherwise("other")
    return corpus.confusion(table(spark, sf, "documents").where("text is not null"), F.coalesce(F.lower("lang"), F.lit("-")), auto, ["en", "es", "other"])


@query(f"WITH {ENT}, {REL}, d AS (SELECT src, count(*) d FROM rel GROUP BY 1) SELECT 'entities' AS what, count(*) AS n FROM ent UNION ALL SELECT 'relations', count(*) FROM rel UNION ALL SELECT 'entity_types', count(DISTINCT entity_type) FROM ent UNION ALL SELECT 'relation_types', count(DISTINCT rel_type) FROM rel UNION ALL SELECT 'degree_min', min(d) FROM d UNION ALL SELECT 'degree_max', max(d) FROM d UNION ALL SELECT 'degree_avg_x1000', CAST(floor(avg(d) * 1000) AS BIGINT) FROM d UNION ALL SELECT 'confidence:' || confidence, count(*) FROM rel GROUP BY confidence")
def graph_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.baseline(entity_view(spark, sf), edge_view(spark, sf))


@query("""SELECT e.id AS id, e.name AS name, coalesce(a.n, 0) AS aliases, coalesce(m.n, 0) AS files FROM entities e LEFT JOIN (SELECT entity_id, count(DISTINCT alias) n FROM entity_aliases GROUP BY 1) a ON a.entity_id = e.id LEFT JOIN (SELECT entity_id, count(DISTINCT file_path) n FROM entity_document_mentions GROUP BY 1) m ON m.entity_id = e.id""")
def profile_card(spark: SparkSession, sf: str) -> DataFrame:
    """Profile cards, read back from their JSON."""
    none = spark.createDataFrame([], "src long, dst long")
    c = corpus.profile_cards(table(spark, sf, "entities"), table(spark, sf, "entity_aliases"), table(spark, sf, "entity_document_mentions"), none)
    j = F.from_json("card", "aliases array<string>, files long")
    return c.select("id", "name", F.size(j["aliases"]).alias("aliases"), j["files"].alias("files"))


STATUS = "CASE doc_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'promoted' WHEN 2 THEN '' ELSE 'odd' END"


@query(f"SELECT problem, count(*) AS entries FROM (SELECT unnest(list_filter([CASE WHEN title IS NULL OR trim(title) = '' THEN 'missing:title' END, CASE WHEN status IS NULL OR trim(status) = '' THEN 'missing:status' END, CASE WHEN status NOT IN ('new', 'promoted') THEN 'status' END], lambda x: x IS NOT NULL)) problem FROM (SELECT title, {STATUS} status FROM documents) UNION ALL SELECT 'duplicate' FROM (SELECT lower(title) s FROM documents WHERE title IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) GROUP BY 1")
def backlog_validation(spark: SparkSession, sf: str) -> DataFrame:
    s = F.when(F.col("doc_id") % 4 == 0, "new").when(F.col("doc_id") % 4 == 1, "promoted").when(F.col("doc_id") % 4 == 2, "").otherwise("odd")
    b = table(spark, sf, "documents").select(F.lower("title").alias("slug"), "title", s.alias("status"))
    return corpus.invalid_rows(b, ["title", "status"], ["new", "promoted"]).groupBy("problem").agg(F.count("*").alias("entries"))


@query(f"""WITH r AS (SELECT file_path slug, sha256, status, row_number() OVER (ORDER BY file_path) i FROM ({LATEST})), f AS (SELECT DISTINCT file_path FROM chunks)
SELECT check_, finding, count(*) AS entries FROM (SELECT 'promoted' check_, 'update' finding FROM r WHERE i % 2 = 0 UNION ALL SELECT 'downloaded', 'update' FROM r JOIN f ON f.file_path = slug WHERE i % 3 = 0 UNION ALL SELECT 'drift', 'update' FROM r JOIN f ON f.file_path = slug WHERE i % 3 = 1 UNION ALL SELECT 'orphan', 'orphan' FROM r WHERE i % 3 > 0 AND slug NOT IN (SELECT file_path FROM f)
 UNION ALL SELECT 'indexed', 'update' FROM r WHERE i % 2 = 0 AND status = 'indexed' UNION ALL SELECT 'indexed', 'info' FROM r WHERE i % 2 = 1 AND status <> 'indexed') GROUP BY 1, 2""")
def reconcile_backlogs(spark: SparkSession, sf: str) -> DataFrame:
    """The five checks over backlogs made from the registry by rule; files at hand are those with chunks, with their digests."""
    from pyspark.sql.window import Window

    r = latest_registry(spark, sf).select(F.col("file_path").alias("slug"), "file_path", "sha256", "status").withColumn("i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("file_path")))
    files = table(spark, sf, "chunks").select("file_path").distinct().join(r.select("file_path", "sha256"), "file_path")
    made = lambda status, sha=F.col("sha256"): r.select("slug", status.alias("status"), "file_path", sha.alias("sha256"))
    logs = {"discovery": made(F.when(F.col("i") % 2 == 0, "new").otherwise("promoted")), "research": made(F.lit("done")).limit(0), "downloads": made(F.when(F.col("i") % 3 == 0, "queued").otherwise("downloaded"), F.when(F.col("i") % 3 == 1, F.lit("other")).otherwise(F.col("sha256"))), "indexing": made(F.when(F.col("i") % 2 == 0, "queued").otherwise("indexed"))}
    out = corpus.reconcile(logs, files, r.select("file_path", "status"))
    return out.groupBy(F.col("check").alias("check_"), "finding").agg(F.count("*").alias("entries"))


@query("""WITH a AS (SELECT user_id q, event_id item, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) r FROM events), x AS (SELECT * FROM a WHERE r <= 10), y AS (SELECT q, item, r FROM a WHERE r <= 12 AND item % 3 > 0) SELECT q AS query, CAST((SELECT count(*) FROM x JOIN y ON y.item = x.item AND y.q = x.q WHERE x.q = z.q AND x.r <= 5 AND y.r <= 5) AS INT) AS overlap,
 round((SELECT count(*) FROM x JOIN y USING (q, item) WHERE q = z.q) / greatest(1, (SELECT count(DISTINCT item) FROM (SELECT item FROM x WHERE q = z.q UNION SELECT item FROM y WHERE q = z.q))), 6) AS jaccard, round((SELECT count(*) FROM x JOIN y USING (q, item) WHERE q = z.q) / greatest(1, (SELECT count(DISTINCT item) FROM (SELECT item FROM x WHERE q = z.q UNION SELECT item FROM y WHERE q = z.q))), 6) >= 0.3 AS agrees FROM (SELECT DISTINCT q FROM x) z""")
def parity_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Two rankings of each user's events against each other."""
    from pyspark.sql.window import Window

    a = table(spark, sf, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("item"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rank"))
    return corpus.parity(a.where("rank <= 10"), a.where("rank <= 12 and item % 3 > 0"))


@query("""SELECT s_suppkey AS key, s_name AS src, 'person' AS src_type, 'TEACHES' AS rel_type, 'Topic ' || s_nationkey AS dst, 'unknown' AS dst_type, CASE WHEN s_suppkey % 2 = 0 THEN 'llm_high' ELSE 'llm_low' END AS confidence FROM supplier""")
def response_salvage(spark: SparkSession, sf: str) -> DataFrame:
    """Answers made by rule: whole, fenced, amid words, broken off; each also states a relation that is none."""
    s = table(spark, sf, "supplier")
    one = F.format_string('{"from_name": "%s", "from_type": "person", "rel_type": "TEACHES", "to_name": "Topic %d", "confidence": "%s"}', "s_name", "s_nationkey", F.when(F.col("s_suppkey") % 2 == 0, "llm_high").otherwise("sure"))
    bad = F.lit('{"from_name": "x", "rel_type": "LIKES", "to_name": "y"}')
    whole = F.concat(F.lit('{"relations": ['), one, F.lit(", "), bad, F.lit("]}"))
    k = F.col("s_suppkey") % 4
    text = F.when(k == 0, whole).when(k == 1, F.concat(F.lit("Here:\n```json\n"), whole, F.lit("\n```"))).when(k == 2, F.concat(F.lit("So "), whole, F.lit(" I think."))).otherwise(F.concat(F.lit('{"relations": ['), one, F.lit(', {"from_name": "z')))
    return corpus.salvaged(s.select(F.col("s_suppkey").alias("key"), text.alias("t")), "key", "t")


@query("""WITH s AS (SELECT p_name n, 'part' t, 'en' l, 'parts' s, 0 i FROM part UNION ALL SELECT upper(p_name), 'part', 'es', 'shouted', 1 FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'The ' || p_name, 'part', 'en', 'titled', 2 FROM part WHERE p_partkey % 3 = 0)
SELECT term, 'part' AS entity_type, arg_min(n, i) AS name, string_agg(DISTINCT l, ',' ORDER BY l) AS languages, string_agg(DISTINCT s, ',' ORDER BY s) AS sources FROM (SELECT *, regexp_replace(lower(n), '^(the|el|la|los|las|un|una) ', '') term FROM s) GROUP BY 1""")
def gazetteer_build(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary from three lists of part names."""
    p = table(spark, sf, "part")
    row = lambda df, n, lang, s: df.select(n.alias("name"), F.lit("part").alias("entity_type"), F.lit(lang).alias("language"), F.lit(s).alias("source"))
    return corpus.built_gazetteer([row(p, F.col("p_name"), "en", "parts"), row(p.where("p_partkey % 2 = 0"), F.upper("p_name"), "es", "shouted"), row(p.where("p_partkey % 3 = 0"), F.concat(F.lit("The "), "p_name"), "en", "titled")])


@query("""SELECT title, CASE WHEN title = 'Memory' THEN 'La memoria' WHEN regexp_matches(title, '^La ') THEN regexp_replace(title, '^La ', 'The ') WHEN regexp_matches(title, '^El ') THEN regexp_replace(title, '^El ', 'The ') END AS translation, CASE WHEN title = 'Memory' THEN 'exact' WHEN regexp_matches(title, '^(La|El) ') THEN 'rule' ELSE 'none' END AS how FROM (SELECT DISTINCT title FROM documents) WHERE title IS NOT NULL""")
def title_translation(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.translated_titles(table(spark, sf, "documents").where("title is not null"), {"Memory": "La memoria"}, [("^La ", "The "), ("^El ", "The ")])


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * CAST(o_orderkey % 3000 + 1 AS INT) AS date_sort FROM orders")
def chronology_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Signed years from phrases made by rule."""
    y = (F.col("o_orderkey") % 3000 + 1).cast("string")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("c. "), y, F.lit(" BC"))).otherwise(F.concat(F.lit("AD "), y)).alias("t"))
    return corpus.event_dates(o, "t").select("id", "date_sort")


@query("SELECT title, verdict, count(*) AS books FROM (SELECT p_name title, CASE p_partkey % 3 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'likely' ELSE 'new' END verdict FROM (SELECT min(p_partkey) p_partkey, p_name FROM part GROUP BY 2)) GROUP BY 1, 2")
def book_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Names as books against a list made by rule: the same, with two letters more, or of another author."""
    p = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    books = p.select(F.col("p_name").alias("title"), F.concat(F.lit("Author "), F.col("k").cast("string")).alias("author"), F.lit("en").alias("language"))
    title = F.when(F.col("k") % 3 == 1, F.concat("p_name", F.lit("xx"))).otherwise(F.col("p_name"))
    known = p.select(title.alias("title"), F.when(F.col("k") % 3 == 2, "Somebody else").otherwise(F.concat(F.lit("Author "), F.col("k").cast("string"))).alias("author"), F.lit("en").alias("language"))
    return corpus.inventory(books, known).groupBy("title", "verdict").agg(F.count("*").alias("books"))


@query("WITH RECURSIVE x AS (SELECT 1) SELECT doc_id, CAST(count(*) FILTER (regexp_matches(line, '^Part [0-9]+: ')) AS INT) AS chapters, CAST(max(CAST(nullif(regexp_extract(line, '^Part ([0-9]+): ', 1), '') AS INT)) AS INT) AS last_number FROM (SELECT o_custkey doc_id, 'Part ' || (o_orderkey % 40) || ': Order' line FROM orders) GROUP BY 1")
def chapter_split(spark: SparkSession, sf: str) -> DataFrame:
    """Texts made of customers' orders, a chapter each, divided again."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: F.concat(F.lit("Part "), (k % 40).cast("string"), F.lit(": Order\nBody of "), k.cast("string"))), "\n").alias("t"))
    c = corpus.chapters(o, "o_custkey", "t", r"^Part (\d+): (.*)$")
    return c.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count("*").cast("int").alias("chapters"), F.max("number").alias("last_number"))


@query("SELECT upper(lang) AS lang, count(*) AS docs, sum(length(text)) AS chars FROM documents GROUP BY 1")
def streaming_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The documents taken in by a stream of files, each batch written under its number; then counted. Everything lies in the shared folder."""
    root = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    d = table(spark, sf, "documents")
    write = lambda b, i: b.select("doc_id", "lang", "text").write.mode("overwrite").parquet(f"{root}/batches/{i}")
    ingest.ingest_once(spark, f"{sf}/documents.parquet*", d.schema, write, f"{root}/progress")
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/batches")
    return rows.groupBy(F.upper("lang").alias("lang")).agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query("""WITH o AS (SELECT file_path, sha256, status FROM (""" + LATEST + """)), c AS (SELECT DISTINCT file_path, chunk_index FROM chunks), n AS (SELECT file_path, CASE WHEN i % 5 = 0 THEN sha256 || 'x' ELSE sha256 END sha256, i FROM (SELECT *, row_number() OVER (ORDER BY file_path) i FROM o) WHERE i % 7 > 0)
SELECT change, count(*) AS files FROM (SELECT CASE WHEN n.file_path IS NULL THEN 'deleted' WHEN o.status = 'error' OR o.sha256 IS DISTINCT FROM n.sha256 THEN 'changed' ELSE 'unchanged' END change FROM o LEFT JOIN n ON n.file_path = o.file_path) GROUP BY 1""")
def corpus_sync(spark: SparkSession, sf: str) -> DataFrame:
    """What a scan finds against the registry, where by rule some files are gone and some changed; the new registry and chunks follow from it."""
    from pyspark.sql.window import Window

    o = latest_registry(spark, sf).select("file_path", "sha256", "file_size", "chunk_count", "last_indexed", "status")
    files = o.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("file_path"))).where("i % 7 > 0").select("file_path", F.when(F.col("i") % 5 == 0, F.concat("sha256", F.lit("x"))).otherwise(F.col("sha256")).alias("sha256"), "file_size", F.lit("One. Two.").alias("text"))
    chunks = table(spark, sf, "chunks").select("file_path", "chunk_index", "text")
    split = lambda f: chunking.chunked(f, "file_path", "text", 1, 0)
    return ingest.sync(files, o, chunks, split, F.current_timestamp())[2].groupBy("change").agg(F.count("*").alias("files"))
