"""Queries of retrieval beyond one ranked list, with their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.functions import text as T
from lorekiln.operators import extract, graph, retrieval, search
from lorekiln.plans.catalogue import PLAIN, SINGLE, WHOLE_RANGES, entity_view, edge_view, query
from lorekiln.session import cut, spread, table

STOP = "['" + "', '".join(T.STOP_WORDS) + "']"
#: Words of a chunk without stop words, as the query language sees them.
CONTENT = f"list_filter(string_split({PLAIN.format('text')}, ' '), lambda w: w <> '' AND NOT list_contains({STOP}, w))"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "chunks").select("id", "file_path", "chunk_index", "text").where("text is not null"), "id")


def cover(source: str, terms: tuple[str, ...]) -> str:
    """SQL of cover density over ``source`` (id, w: words): from each hit to the first place where all terms have come; of those that end
    together the shortest."""
    nxt = ", ".join(f"min(CASE WHEN w = '{t}' THEN i END) OVER n AS i{k}" for k, t in enumerate(terms))
    end, some = ", ".join(f"i{k}" for k in range(len(terms))), " AND ".join(f"i{k} IS NOT NULL" for k in range(len(terms)))
    return f"""SELECT c.id AS id, round(sum(0.1 / (1 + (b.p - a.p) - (b.i - a.i))), 6) AS score FROM (SELECT id, greatest({end}) j, max(i) i FROM (SELECT *, {nxt} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) i FROM {source} WHERE w IN ({", ".join(f"'{t}'" for t in terms)})) WINDOW n AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) WHERE {some} GROUP BY 1, 2) c
 JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) i FROM {source} WHERE w IN ({", ".join(f"'{t}'" for t in terms)})) a ON a.id = c.id AND a.i = c.i JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) i FROM {source} WHERE w IN ({", ".join(f"'{t}'" for t in terms)})) b ON b.id = c.id AND b.i = c.j GROUP BY 1"""


WORDS = f"docs AS (SELECT id, file_path, chunk_index, text, {CONTENT} ws FROM chunks WHERE text IS NOT NULL), words AS (SELECT id, unnest(ws) w, generate_subscripts(ws, 1) p FROM docs)"


@query(f"""WITH {WORDS}, a1 AS (SELECT id FROM docs WHERE list_contains(ws, 'covenant') AND list_contains(ws, 'harvest') AND NOT list_contains(ws, 'plough')), a2 AS (SELECT DISTINCT x.id FROM words x JOIN words y ON y.id = x.id AND y.p = x.p + 1 WHERE x.w = 'silver' AND y.w = 'cup'),
s AS (SELECT id, max(score) AS score FROM (SELECT * FROM ({cover('words', ('covenant', 'harvest'))}) WHERE id IN (FROM a1) UNION ALL SELECT * FROM ({cover('words', ('silver', 'cup'))}) WHERE id IN (FROM a2)) GROUP BY 1)
SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s ORDER BY score DESC, id LIMIT 40""")
def fts_query(spark: SparkSession, sf: str) -> DataFrame:
    """Side by side, excluded, alternative and quoted words in one query."""
    return retrieval.find(docs(spark, sf), "id", "text", 'the covenant harvest -plough or "silver cup"', 40)


@query(f"""WITH {WORDS}, s AS ({cover('words', ('cronica',))}) SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s JOIN docs USING (id) WHERE contains(file_path, 'libros/') ORDER BY score DESC, id LIMIT 20""")
def fts_in_path(spark: SparkSession, sf: str) -> DataFrame:
    """A search within files whose path has a part."""
    return retrieval.find(docs(spark, sf), "id", "text", "crónica", 20, F.col("file_path").contains("libros/"))


#: Queries of a batch: the single-word English terms of the glossary.
@query(f"""WITH {WORDS}, q AS (SELECT DISTINCT concept_id, {PLAIN.format('term_en')} t FROM concept_bridge), h AS (SELECT q.concept_id, words.id, round(0.1 * count(*), 6) score FROM q JOIN words ON words.w = q.t GROUP BY 1, 2)
SELECT concept_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY score DESC, id) AS rank FROM h) WHERE rank <= 10""")
def fts_batch_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best chunks of every single-word glossary term, all in one pass."""
    q = table(spark, sf, "concept_bridge").select("concept_id", T.normalised(F.col("term_en")).alias("w")).where("w <> '' and not w like '% %'").distinct()
    w = docs(spark, sf).select("id", F.explode(F.split(T.normalised(F.col("text")), " ")).alias("w")).where((F.col("w") != "") & ~F.col("w").isin(T.STOP_WORDS))
    hits = w.join(F.broadcast(q), "w").groupBy("concept_id", "id").agg(F.round(F.count("*") * F.lit(0.1), 6).alias("score"))  # a glossary of fixed size
    return graph.limited(hits, [F.desc("score"), "id"], 10, 0, "concept_id").withColumn("rank", F.row_number().over(_by("concept_id", F.desc("score"), "id")))


def _by(key: str, *order):
    from pyspark.sql.window import Window

    return Window.partitionBy(key).orderBy(*order)


@query(f"""SELECT e.id AS question, m.file_path AS file_path, min(e.name) AS label FROM entities e JOIN entity_document_mentions m ON m.entity_id = e.id JOIN document_registry r ON r.file_path = m.file_path WHERE e.id IN (SELECT min(id) FROM ({SINGLE}) WHERE term <> '' GROUP BY term HAVING count(DISTINCT id) = 1) AND {PLAIN.format('e.name')} IN (SELECT term FROM ({SINGLE}) GROUP BY term HAVING count(DISTINCT id) = 1) AND e.id % 10 = 0 AND NOT regexp_matches(lower(e.name), '(^| )what|of( |$)') GROUP BY 1, 2""")
def question_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Files for questions that name an entity: found by the dictionary, then through its mentions. Questions are made from every tenth
    entity's name, where that name is no other's."""
    e, a = table(spark, sf, "entities"), table(spark, sf, "entity_aliases")
    g = extract.gazetteer(e, a)
    alone = g.groupBy("term").agg(F.countDistinct("entity_id").alias("n")).where("n = 1").select("term")
    asked = e.where("id % 10 = 0 and not lower(name) rlike '(^| )what|of( |$)'").withColumn("term", T.normalised(F.col("name"))).join(alone, "term", "left_semi")
    q = asked.select(F.col("id").alias("question"), F.concat(F.lit("What became of "), "name", F.lit("?")).alias("text"))
    found = extract.mentions(q, "question", "text", g).where("entity_id = question")
    m = table(spark, sf, "entity_document_mentions").select("entity_id", "file_path").join(table(spark, sf, "document_registry").select("file_path"), "file_path", "left_semi")
    return found.join(m, "entity_id").join(e.select(F.col("id").alias("entity_id"), "name"), "entity_id").groupBy("question", "file_path").agg(F.min("name").alias("label"))


HITS = f"hits AS (SELECT id, file_path, chunk_index, score, text FROM (SELECT d.id, d.file_path, d.chunk_index, d.text, s.score, row_number() OVER (ORDER BY s.score DESC, d.id) r FROM ({cover('words', ('cronica',))}) s JOIN docs d USING (id)) WHERE r <= 30)"


def hits(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    return retrieval.find(d, "id", "text", "crónica", 30).join(d, "id")


@query(f"""WITH {WORDS}, {HITS}, hints AS (SELECT m.file_path, min(e.name) label FROM entity_document_mentions m JOIN entities e ON e.id = m.entity_id WHERE e.entity_type = 'concept' GROUP BY 1), missing AS (SELECT * FROM hints WHERE file_path NOT IN (SELECT file_path FROM hits) ORDER BY file_path LIMIT 10),
inside AS (SELECT s.id, s.score, d.file_path, d.chunk_index, d.text FROM ({cover('words', ('cronica',))}) s JOIN docs d USING (id) WHERE d.file_path IN (SELECT file_path FROM missing)), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path, chunk_index ORDER BY score DESC, id) k FROM inside) WHERE k = 1), more AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, id) place FROM one) WHERE place <= 2)
SELECT h.file_path AS file_path, h.chunk_index AS chunk_index, round(CASE WHEN x.label IS NULL THEN score ELSE score * 1.5 END, 8) AS score, CASE WHEN x.label IS NULL THEN 'hybrid' ELSE 'hybrid+kg' END AS mode, length(h.text) AS size FROM hits h LEFT JOIN hints x ON x.file_path = h.file_path
UNION ALL SELECT m.file_path, m.chunk_index, round(m.score * 0.001, 8), 'kg-boost', length('[KG: ' || s.label || '] ' || m.text) FROM more m JOIN missing s ON s.file_path = m.file_path""")
def retrieve_hinted(spark: SparkSession, sf: str) -> DataFrame:
    """Hits boosted by the graph's hints, and the best of hinted files beside them."""
    m = table(spark, sf, "entity_document_mentions").join(F.broadcast(table(spark, sf, "entities").where("entity_type = 'concept'").select(F.col("id").alias("entity_id"), F.col("name").alias("label"))), "entity_id")  # entities: a table of fixed size
    out = retrieval.with_hints(cut(hits(spark, sf)), m.select("file_path", "label"), docs(spark, sf), "crónica")
    return out.select("file_path", "chunk_index", F.round("score", 8).alias("score"), "mode", F.length("text").alias("size"))


def linked_sql(kind: str, each: int, k: int, mode: str) -> str:
    return f"""WITH {WORDS}, {HITS}, l AS (SELECT src_file_path src, dst_file_path dst FROM document_parallels WHERE rel_type {kind}), b AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l), f AS (SELECT DISTINCT dst AS file_path FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) n FROM b WHERE src <> dst AND src IN (SELECT file_path FROM hits)) WHERE n <= {each} AND dst NOT IN (SELECT file_path FROM hits)),
one AS (SELECT * FROM (SELECT s.id, s.score, d.file_path, d.chunk_index, row_number() OVER (PARTITION BY d.file_path, d.chunk_index ORDER BY s.score DESC, s.id) c FROM ({cover('words', ('cronica',))}) s JOIN docs d USING (id) WHERE d.file_path IN (SELECT file_path FROM f)) WHERE c = 1)
SELECT file_path, chunk_index, round(score * 0.001, 8) AS score, '{mode}' AS mode FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, id) place FROM one) WHERE place <= {k}"""


def linked(spark: SparkSession, sf: str, kinds: list[str], each: int | None, k: int, mode: str) -> DataFrame:
    links = table(spark, sf, "document_parallels").where(F.col("rel_type").isin(kinds)).select(F.col("src_file_path").alias("src"), F.col("dst_file_path").alias("dst"))
    out = retrieval.expanded(docs(spark, sf), "crónica", cut(hits(spark, sf)).select("file_path").distinct(), links, mode, k, each)
    return out.select("file_path", "chunk_index", F.round("score", 8).alias("score"), "mode")


@query(linked_sql("IN ('PARALLEL_NARRATIVE', 'EDITORIAL_PARALLEL')", 1 << 30, 3, "cross-ref"))
def expand_parallel_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The three best hits within each parallel of a retrieved file."""
    return linked(spark, sf, ["PARALLEL_NARRATIVE", "EDITORIAL_PARALLEL"], None, 3, "cross-ref")


@query(linked_sql("IS NOT NULL", 3, 2, "footnote-xref"))
def expand_footnote_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The two best hits within three linked files of each retrieved one."""
    return linked(spark, sf, ["PARALLEL_NARRATIVE", "EDITORIAL_PARALLEL", "THEMATIC_LINK"], 3, 2, "footnote-xref")


LANGED = f"r AS (SELECT w.*, regexp_extract(file_path, '^([a-z]{{2}})/', 1) lang, file_path FROM ({WHOLE_RANGES}) w JOIN (SELECT id i, file_path FROM chunks) c ON c.i = w.id WHERE chapter IS NOT NULL AND lo IS NOT NULL), ask AS (SELECT DISTINCT id AS request, book, chapter, lo AS verse FROM r WHERE id % 100 = 0)"


def ranges(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks")
    v = extract.verse_ranges(c, "id", "reference")
    return v.join(c.select("id", "file_path", F.regexp_extract("file_path", "^([a-z]{2})/", 1).alias("lang")).distinct(), "id")


@query(f"""WITH {LANGED}, h AS (SELECT a.request, r.id, CASE lang WHEN 'es' THEN 0 WHEN 'en' THEN 1 ELSE 2 END turn FROM ask a JOIN r ON r.book = a.book AND r.chapter = a.chapter AND r.lo <= a.verse + 3 AND r.hi >= a.verse - 2) SELECT DISTINCT request, id, 100.0 AS score FROM (SELECT *, min(turn) OVER (PARTITION BY request) least FROM h) WHERE turn = least""")
def reference_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Passages around the verse that every hundredth reference begins with."""
    r = ranges(spark, sf)
    ask = r.where("id % 100 = 0").select(F.col("id").alias("request"), "book", "chapter", F.col("lo").alias("verse")).distinct()
    return retrieval.by_reference(r, ask, "id")


@query(f"""WITH {LANGED}, links AS (SELECT DISTINCT book, chapter, lo verse, book to_book, chapter to_chapter, CASE WHEN lo % 2 = 0 THEN lo END to_verse FROM r), t AS (SELECT * FROM (SELECT a.request, l.to_book, l.to_chapter, l.to_verse, row_number() OVER (PARTITION BY a.request, l.to_book, l.to_chapter ORDER BY l.to_verse NULLS FIRST) k FROM ask a JOIN links l ON l.book = a.book AND l.chapter = a.chapter AND l.verse = a.verse) WHERE k = 1)
SELECT request, id, 50.0 AS score FROM (SELECT t.request, r.id, row_number() OVER (PARTITION BY t.request, t.to_book, t.to_chapter ORDER BY r.lo, r.id) n FROM t JOIN r ON r.book = t.to_book AND r.chapter = t.to_chapter AND ((t.to_verse IS NULL AND r.lo <= 5) OR t.to_verse BETWEEN r.lo AND r.hi)) WHERE n = 1""")
def crossreference_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The first passage of each cross-referenced chapter; every verse points into its own chapter by rule."""
    r = ranges(spark, sf)
    ask = r.where("id % 100 = 0").select(F.col("id").alias("request"), "book", "chapter", F.col("lo").alias("verse")).distinct()
    links = r.select("book", "chapter", F.col("lo").alias("verse"), F.col("book").alias("to_book"), F.col("chapter").alias("to_chapter"), F.when(F.col("lo") % 2 == 0, F.col("lo")).alias("to_verse")).distinct()
    return retrieval.by_crossreference(r, ask, links, "id")


@query(f"""WITH {LANGED}, c AS (SELECT DISTINCT src_file_path a, dst_file_path b FROM document_parallels WHERE rel_type = 'EDITORIAL_PARALLEL') SELECT DISTINCT x.id AS id, y.id AS variant FROM c JOIN r x ON x.file_path = c.a JOIN r y ON y.file_path = c.b AND y.chapter = x.chapter AND x.lo <= y.hi AND y.lo <= x.hi""")
def variant_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of two editions whose verses overlap."""
    c = table(spark, sf, "document_parallels").where("rel_type = 'EDITORIAL_PARALLEL'").select(F.col("src_file_path").alias("a"), F.col("dst_file_path").alias("b"))
    return retrieval.variants(ranges(spark, sf), c, "id")


@query(f"""WITH e AS (SELECT doc_id entry, title, lower(trim(source)) source, lower(lang) lang, text, {PLAIN.format('title')} k FROM documents WHERE text IS NOT NULL AND title IS NOT NULL), t AS (SELECT DISTINCT term, {PLAIN.format('term')} k FROM (SELECT term_es term FROM concept_bridge UNION SELECT term_en FROM concept_bridge)), own AS (SELECT t.term, e.* EXCLUDE (k) FROM t JOIN e ON e.k = t.k WHERE t.k <> ''),
other AS (SELECT t.term, e.* EXCLUDE (k) FROM (SELECT * FROM t WHERE term NOT IN (SELECT term FROM own)) t JOIN (SELECT DISTINCT {PLAIN.format('term_es')} k, {PLAIN.format('term_en')} k2 FROM concept_bridge) b ON b.k = t.k JOIN e ON e.k = b.k2), h AS (SELECT * FROM own UNION ALL SELECT * FROM other),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY CASE WHEN lang = 'es' THEN 0 ELSE 1 END, CASE source WHEN 'manuals' THEN 0 WHEN 'talks' THEN 1 ELSE 2 END, entry) n FROM h) WHERE n = 1)
SELECT term, title, source, lang, CASE WHEN length(text) <= 300 THEN text WHEN p > 0 AND 149 + p <= 300 THEN substring(text, 1, CAST(148 + p AS INT)) ELSE substring(text, 1, 300) || '...' END AS text FROM (SELECT *, strpos(substring(text, 150), chr(10) || chr(10)) p FROM best)""")
def definition_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The best document under each glossary term's title, Spanish first, by way of the English term where there is none."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("entry"), "title", F.lower(F.trim("source")).alias("source"), F.lower("lang").alias("lang"), "text")
    b = table(spark, sf, "concept_bridge").select(F.col("term_es").alias("term"), F.col("term_en").alias("other"))
    return retrieval.definitions(d, b.select("term").union(b.select("other")), b, "es", ["manuals", "talks"], 300)


@query("""WITH d AS (SELECT DISTINCT l_partkey p, l_suppkey s FROM lineitem) SELECT n_nationkey + 100 AS id, string_agg(line, chr(10) ORDER BY n) AS context FROM (SELECT n_nationkey, line, row_number() OVER (PARTITION BY n_nationkey ORDER BY tier, rel, b, line) n FROM (SELECT n_nationkey, 0 tier, 'PART_OF' rel, n_regionkey b, n_name || ' -PART_OF-> ' || r_name line FROM nation JOIN region ON r_regionkey = n_regionkey
 UNION ALL SELECT s_nationkey, 1, 'BELONGS_TO', s_suppkey + 10000000000, s_name || ' -BELONGS_TO-> ' || n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT c_nationkey, CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END, 'BELONGS_TO', c_custkey + 20000000000, c_name || ' -BELONGS_TO-> ' || n_name FROM customer JOIN nation ON n_nationkey = c_nationkey)) WHERE n <= 25 GROUP BY 1""")
def graph_context(spark: SparkSession, sf: str) -> DataFrame:
    """What the graph says of every nation, as text."""
    ids = table(spark, sf, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"))
    return retrieval.graph_context(entity_view(spark, sf), edge_view(spark, sf), ids)


@query(f"""WITH {WORDS}, s AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({cover('words', ('cronica',))}) ORDER BY score DESC, id LIMIT 8) SELECT string_agg('[' || rank || '] ' || file_path || ': ' || substring(text, 1, 200), chr(10) || chr(10) ORDER BY rank) AS context FROM s JOIN docs USING (id)""")
def context_text(spark: SparkSession, sf: str) -> DataFrame:
    """The best hits as one numbered text, cut to what is wanted."""
    return retrieval.assembled(retrieval.reranked(hits(spark, sf), 8), 200)


@query("""WITH RECURSIVE rel AS (SELECT DISTINCT least(a, b) x, greatest(a, b) y FROM (SELECT x.entity_id a, y.entity_id b FROM (SELECT DISTINCT entity_id, file_path FROM entity_document_mentions) x JOIN (SELECT DISTINCT entity_id, file_path FROM entity_document_mentions) y ON x.file_path = y.file_path AND x.entity_id < y.entity_id)), core AS (SELECT DISTINCT unnest([x, y]) id FROM rel WHERE x IN (1, 2) OR y IN (1, 2)),
inner_edges AS (SELECT x, y FROM rel WHERE x IN (FROM core) AND y IN (FROM core)), sub AS (SELECT x a, y b FROM inner_edges UNION ALL SELECT y, x FROM inner_edges), deg AS (SELECT a, count(*) deg FROM sub GROUP BY 1), r(step, id, score) AS (SELECT 0, id, 1.0::DOUBLE / (SELECT count(*) FROM core) FROM core
 UNION ALL SELECT step + 1, id, 0.5 * CASE WHEN id IN (1, 2) THEN 0.5 ELSE 0 END + 0.5 * sum(got) FROM (SELECT r.step, sub.b id, r.score / deg.deg got FROM r JOIN sub ON sub.a = r.id JOIN deg ON deg.a = r.id WHERE r.step < 20) GROUP BY step, id),
best AS (SELECT id, score FROM r WHERE step = 20), f AS (SELECT m.entity_id id, min(c.id) chunk_id FROM entity_document_mentions m JOIN chunks c ON c.file_path = m.file_path GROUP BY 1) SELECT best.id AS entity_id, chunk_id, round(score * 100, 3) AS score FROM best JOIN f USING (id)""")
def ppr_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Entities near two seeds in the graph of those mentioned together, each with its first chunk and a hundred times its score."""
    m = table(spark, sf, "entity_document_mentions").select("entity_id", "file_path").distinct()
    pairs = extract.cooccurrence(m.withColumn("entity_type", F.lit("x")), "file_path", {})
    scores = graph.pagerank(cut(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))), [1, 2])
    first = m.join(table(spark, sf, "chunks").groupBy("file_path").agg(F.min("id").alias("c")), "file_path").groupBy("entity_id").agg(F.min("c").alias("chunk_id"))
    return scores.join(first, scores["id"] == first["entity_id"]).select("entity_id", "chunk_id", F.round(F.col("score") * 100, 3).alias("score"))
