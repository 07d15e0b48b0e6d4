"""The registry of core queries and of their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekiln.functions import text as T
from lorekiln.operators import chunking, extract, graph, maintenance, merge, search
from lorekiln.session import cut, one_row, spread, table

def chunk_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text) of chunks, over as many tasks as there are cores: a small file is one split, but work on texts is heavy."""
    return spread(table(spark, sf, "chunks").select("id", "text").where("text is not null"), "id")


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ---------------------------------------------------------------------------------------------------------------------
# views: entities and edges over the star schema
SUPPLIER, CUSTOMER, PART = 10_000_000_000, 20_000_000_000, 30_000_000_000


def entity_view(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    one = lambda n, i, name, kind: t(n).select(i.cast("long").alias("id"), F.col(name).alias("name"), F.lit(kind).alias("entity_type"))
    parts = (("region", F.col("r_regionkey"), "r_name", "region"), ("nation", F.col("n_nationkey") + 100, "n_name", "nation"), ("supplier", F.col("s_suppkey") + SUPPLIER, "s_name", "supplier"), ("customer", F.col("c_custkey") + CUSTOMER, "c_name", "customer"), ("part", F.col("p_partkey") + PART, "p_name", "part"))
    out = one(*parts[0])
    for p in parts[1:]:
        out = out.unionByName(one(*p))
    return out


def edge_view(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    e = lambda df, s, d, r, c: df.select(s.cast("long").alias("src"), d.cast("long").alias("dst"), F.lit(r).alias("rel_type"), c.alias("confidence"))
    three = lambda k: F.when(k % 3 == 0, "llm_high").when(k % 3 == 1, "llm_low").otherwise("ner")
    pairs = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    return (
        e(t("nation"), F.col("n_nationkey") + 100, F.col("n_regionkey"), "PART_OF", F.lit("curated"))
        .unionByName(e(t("supplier"), F.col("s_suppkey") + SUPPLIER, F.col("s_nationkey") + 100, "BELONGS_TO", F.lit("metadata")))
        .unionByName(e(t("customer"), F.col("c_custkey") + CUSTOMER, F.col("c_nationkey") + 100, "BELONGS_TO", three(F.col("c_custkey"))))
        .unionByName(e(pairs, F.col("l_partkey") + PART, F.col("l_suppkey") + SUPPLIER, "ASSOCIATED_WITH", F.when((F.col("l_partkey") + F.col("l_suppkey")) % 2 == 0, "llm_low").otherwise("co_occurrence")))
    )


ENT = f"""ent AS (
 SELECT CAST(r_regionkey AS BIGINT) id, r_name name, 'region' entity_type FROM region
 UNION ALL SELECT n_nationkey + 100, n_name, 'nation' FROM nation
 UNION ALL SELECT s_suppkey + {SUPPLIER}, s_name, 'supplier' FROM supplier
 UNION ALL SELECT c_custkey + {CUSTOMER}, c_name, 'customer' FROM customer
 UNION ALL SELECT p_partkey + {PART}, p_name, 'part' FROM part)"""
REL = f"""rel AS (
 SELECT CAST(n_nationkey + 100 AS BIGINT) src, CAST(n_regionkey AS BIGINT) dst, 'PART_OF' rel_type, 'curated' confidence FROM nation
 UNION ALL SELECT s_suppkey + {SUPPLIER}, s_nationkey + 100, 'BELONGS_TO', 'metadata' FROM supplier
 UNION ALL SELECT c_custkey + {CUSTOMER}, c_nationkey + 100, 'BELONGS_TO', CASE c_custkey % 3 WHEN 0 THEN 'llm_high' WHEN 1 THEN 'llm_low' ELSE 'ner' END FROM customer
 UNION ALL SELECT l_partkey + {PART}, l_suppkey + {SUPPLIER}, 'ASSOCIATED_WITH', CASE WHEN (l_partkey + l_suppkey) % 2 = 0 THEN 'llm_low' ELSE 'co_occurrence' END
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))"""
BOTH = "both_ways AS (SELECT src a, dst b, rel_type, confidence, true outgoing FROM rel UNION ALL SELECT dst, src, rel_type, confidence, false FROM rel)"
TIER = "CASE confidence WHEN 'curated' THEN 0 WHEN 'metadata' THEN 1 WHEN 'llm_high' THEN 2 WHEN 'llm_low' THEN 3 WHEN 'ner' THEN 4 WHEN 'co_occurrence' THEN 5 ELSE 6 END"
PLAIN = "trim(regexp_replace(translate(lower({0}), '" + T.FOLD[0] + "', '" + T.FOLD[1] + "'), '[^a-z0-9]+', ' ', 'g'))"


# ---------------------------------------------------------------------------------------------------------------------
# scans, projections, aggregates
@query("SELECT lower(trim(source)) AS source, upper(lang) AS lang, count(*) AS docs, sum(length(text)) AS chars FROM documents GROUP BY 1, 2")
def corpus_source_lang_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.groupBy(F.lower(F.trim("source")).alias("source"), F.upper("lang").alias("lang")).agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query(r"""SELECT doc_id, CAST(len(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])[\t\n\f\r \v]+', '\1' || chr(1), 'g'), '\n\n+', chr(1), 'g'), chr(1)),
 lambda x: regexp_replace(x, '^[\t\n\f\r \v]+|[\t\n\f\r \v]+$', '', 'g')), lambda x: x <> '')) AS INT) AS sentences FROM documents WHERE text IS NOT NULL""")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


@query(r"""WITH RECURSIVE s AS (SELECT doc_id, unnest(l) k, generate_subscripts(l, 1) i, len(l) m FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])[\t\n\f\r \v]+', '\1' || chr(1), 'g'), '\n\n+', chr(1), 'g'), chr(1)),
 lambda x: len(list_filter(string_split_regex(x, '[\t\n\f\r \v]+'), lambda w: w <> ''))), lambda k: k > 0) l FROM documents WHERE text IS NOT NULL)),
f(doc_id, i, lo, hi, closed_lo, closed_hi) AS (SELECT doc_id, 1, 0, CAST(k AS BIGINT), NULL::BIGINT, NULL::BIGINT FROM s WHERE i = 1
 UNION ALL SELECT f.doc_id, f.i + 1, CASE WHEN hi - lo + k > 500 THEN (CASE WHEN hi - lo > 50 THEN hi - 50 ELSE hi END) ELSE lo END, hi + k, CASE WHEN hi - lo + k > 500 THEN lo END, CASE WHEN hi - lo + k > 500 THEN hi END FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1),
c AS (SELECT doc_id, closed_lo lo, closed_hi hi FROM f WHERE closed_hi IS NOT NULL UNION ALL SELECT f.doc_id, lo, hi FROM f JOIN (SELECT doc_id, max(i) i FROM s GROUP BY 1) e ON e.doc_id = f.doc_id AND e.i = f.i), w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\t\n\f\r \v]+'), lambda w: w <> '') w FROM documents)
SELECT c.doc_id AS doc_id, CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY hi) - 1 AS INT) AS chunk_index, CAST(hi - lo AS INT) AS n_words, array_to_string(w[lo + 1 : hi], ' ') AS text FROM c JOIN w ON w.doc_id = c.doc_id""")
def chunk_text_500_50(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunked(spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text", 500, 50).drop("start_char", "end_char")


@query("SELECT doc_id, true AS in_place, true AS in_order FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\f\\r\\v]')")
def chunk_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """For each text whether its chunks (80 words, 10 of overlap) are the words between their offsets, and follow each other."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("whole"))
    c = chunking.chunked(d, "doc_id", "whole", 80, 10).join(d, "doc_id")
    same = F.trim(F.regexp_replace(F.substring(F.col("whole"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char")), r"\s+", " ")) == F.col("text")
    ends = F.lag("end_char").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    return c.select("doc_id", same.alias("same"), (F.coalesce(ends, F.lit(0)) < F.col("end_char")).alias("after")).groupBy("doc_id").agg(F.bool_and("same").alias("in_place"), F.bool_and("after").alias("in_order"))


@query("SELECT count(*) AS chunks, count(DISTINCT file_path) AS files, sum(length(text)) AS chars, max(chunk_index) AS last_index, count(reference) AS with_reference FROM chunks")
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks")
    return c.agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"), F.sum(F.length("text")).alias("chars"), F.max("chunk_index").alias("last_index"), F.count("reference").alias("with_reference"))


@query(r"""WITH l AS (SELECT id, pos, regexp_replace(line, '[ \t\f\v\r]+$', '') line FROM (SELECT id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS pos FROM chunks WHERE text IS NOT NULL)),
m AS (SELECT *, regexp_matches(line, '^[0-9]{1,3}[ \t\f\v]+[^ \t\n\r\f\v]') opens FROM l WHERE line <> ''), g AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) g FROM m)
SELECT id, CAST(max(CASE WHEN opens THEN regexp_extract(line, '^([0-9]{1,3})', 1) END) AS INT) AS verse, string_agg(CASE WHEN opens THEN regexp_extract(line, '^[0-9]{1,3}[ \t\f\v]+(.*)$', 1) ELSE regexp_replace(line, '^[ \t\f\v]+', '') END, ' ' ORDER BY pos) AS body FROM g WHERE g > 0 GROUP BY id, g""")
def verse_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Verses with the lines that go on with them."""
    return chunking.verses(table(spark, sf, "chunks").where("text is not null"), "id", "text").drop("pos")


@query(r"""SELECT DISTINCT file_path, nullif(regexp_extract(file_path, '^([a-z]{2})/', 1), '') AS lang, regexp_extract(regexp_replace(file_path, '^[a-z]{2}/', ''), '^(.*)/[^/]*$', 1) AS category,
 regexp_extract(regexp_replace(file_path, '^[a-z]{2}/', ''), '([^/]*)$', 1) AS name, regexp_extract(file_path, '\.([a-z0-9]+)$', 1) AS suffix FROM document_registry WHERE file_path IS NOT NULL""")
def path_metadata(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("file_path")
    r = table(spark, sf, "document_registry").where("file_path is not null").select("file_path").distinct()
    return r.select("file_path", T.path_part(p, 0).alias("lang"), T.path_part(p, 1).alias("category"), T.path_part(p, 2).alias("name"), T.path_part(p, 3).alias("suffix"))


@query(r"""SELECT id, trim(regexp_extract(reference, '^(.*[^0-9 ])[ ]+[0-9]', 1)) AS book, TRY_CAST(regexp_extract(reference, ' ([0-9]+)[:,]', 1) AS INT) AS chapter,
 TRY_CAST(regexp_extract(reference, '[:,] ?([0-9]+)', 1) AS INT) AS first_verse, TRY_CAST(nullif(regexp_extract(reference, '[-–]([0-9]+)$', 1), '') AS INT) AS last_verse FROM chunks WHERE reference IS NOT NULL""")
def reference_parse(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("reference")
    number = lambda p: F.regexp_extract(r, p, 1).try_cast("int")
    return table(spark, sf, "chunks").where(r.isNotNull()).select("id", F.trim(F.regexp_extract(r, r"^(.*[^0-9 ])[ ]+[0-9]", 1)).alias("book"), number(r" ([0-9]+)[:,]").alias("chapter"), number(r"[:,] ?([0-9]+)").alias("first_verse"), number(r"[-–]([0-9]+)$").alias("last_verse"))


@query(r"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+ [0-9]{1,3}:[0-9]{1,3}(?:-[0-9]{1,3})?')) AS reference FROM documents)
SELECT reference, count(*) AS mentions, count(DISTINCT doc_id) AS docs FROM r GROUP BY 1""")
def reference_detect(spark: SparkSession, sf: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]+ [A-Z][a-z]+ [0-9]{1,3}:[0-9]{1,3}(?:-[0-9]{1,3})?"), F.lit(0))
    d = table(spark, sf, "documents").select("doc_id", F.explode(found).alias("reference"))
    return d.groupBy("reference").agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("docs"))


@query("""SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(F.get_json_object("props", "$.k").try_cast("long").alias("k"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT coalesce(CASE WHEN json_valid(metadata) THEN nullif(json_extract_string(metadata, '$.source'), '') END, 'none') AS source, count(*) AS chunks FROM chunks GROUP BY 1""")
def metadata_sources(spark: SparkSession, sf: str) -> DataFrame:
    source = F.nullif(F.get_json_object("metadata", "$.source"), F.lit(""))
    return table(spark, sf, "chunks").groupBy(F.coalesce(source, F.lit("none")).alias("source")).agg(F.count("*").alias("chunks"))


LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY last_indexed DESC, sha256) rn FROM document_registry) WHERE rn = 1"


def latest_registry(spark: SparkSession, sf: str) -> DataFrame:
    return graph.first_by(table(spark, sf, "document_registry"), ["file_path"], [F.desc("last_indexed"), F.col("sha256")])


@query(f"SELECT file_path, sha256, chunk_count, status FROM ({LATEST})")
def registry_latest(spark: SparkSession, sf: str) -> DataFrame:
    return latest_registry(spark, sf).select("file_path", "sha256", "chunk_count", "status")


@query("""WITH o AS (SELECT doc_id, sha256(text) h FROM documents WHERE doc_id % 10 <> 3), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 4 THEN text || '.' ELSE text END) h FROM documents WHERE doc_id % 10 <> 5)
SELECT change, count(*) AS docs FROM (SELECT CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.h IS NOT DISTINCT FROM n.h THEN 'unchanged' ELSE 'changed' END change
 FROM o FULL JOIN n ON o.doc_id = n.doc_id) GROUP BY 1""")
def doc_hash_diff(spark: SparkSession, sf: str) -> DataFrame:
    """The two states differ by rule; every document is in one of them."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    old = d.where("doc_id % 10 <> 3").select("doc_id", F.sha2("text", 256).alias("h"))
    new = d.where("doc_id % 10 <> 5").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 4, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("h"))
    return merge.difference(old, new, "doc_id", "h").groupBy("change").agg(F.count("*").alias("docs"))


@query("""SELECT file_path, sha256(string_agg(chunk_index || chr(0) || sha256(text), chr(10) ORDER BY chunk_index, sha256(text))) AS digest FROM (SELECT DISTINCT file_path, chunk_index, text FROM chunks WHERE text IS NOT NULL) GROUP BY 1""")
def file_digest(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").where("text is not null").select("file_path", "chunk_index", F.sha2("text", 256).alias("h")).distinct()
    parts = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "h"))), lambda s: F.concat(s["chunk_index"].cast("string"), F.lit("\0"), s["h"]))
    return c.groupBy("file_path").agg(F.sha2(F.array_join(parts, "\n"), 256).alias("digest"))


@query("SELECT file_path, chunk_index, count(*) AS copies, min(id) AS first_id FROM chunks GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks")
    return c.groupBy("file_path", "chunk_index").agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).where("copies > 1")


@query(f"SELECT id, {PLAIN.format('name')} AS plain, " + r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '^(señor|su\s+hijo|the\s+lord|el\s+señor)\s+', ''), '^(the|el|la|los|las|un|una)\s+', ''), '\s+', ' ', 'g')) AS canonical FROM entities")
def term_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "entities").select("id", T.normalised(F.col("name")).alias("plain"), T.entity_name(F.col("name")).alias("canonical"))


#: The distinct words of the chunks, and names and aliases, with how often they are used.
NAMES = r"""SELECT name, count(*) n FROM (SELECT unnest(string_split_regex(text, '[ \t\n\f\r\v]+')) name FROM chunks) GROUP BY 1 UNION ALL SELECT name, count(*) FROM (SELECT name FROM entities UNION ALL SELECT alias FROM entity_aliases) GROUP BY 1"""


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def garbage_sql() -> str:
    rx = lambda c, p: f"regexp_matches({c}, {_sql(p)})"
    word = lambda ws, end="": rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(ws)}){end}([^\p{{L}}\p{{N}}_]|$)"
    alnum = r"length(regexp_replace(s, '[^\p{L}\p{N}]', '', 'g'))"
    cases = [
        ("empty", "s = ''"), ("nul_bytes", "contains(s, chr(0))"), ("too_short", "length(s) < 3"), ("too_long", "length(s) > 80"), ("all_punct", f"{alnum} = 0"),
        ("url_like", rx("low", rf"https?://|www\.|[a-z0-9][a-z0-9-]*\.({'|'.join(T.DOMAINS)})\b")), ("html_fragment", rx("s", r"<\s*/?\s*[a-z][a-z0-9]*(\s+[^>]*)?>|\b(id|class|href|src|rel|style|data-\w+)\s*=\s*[\"']|&(amp|lt|gt|quot|nbsp|#[0-9]+);")),
        ("mojibake", rx("s", T.MOJIBAKE)), ("scripture_ref", rx("low", rf"^\s*((read|ver|véase|see)\s+)?(\d\s+)?({'|'.join(T.BOOKS)})\.?\s+\d+")), ("archaic_verb", rx("low", word(T.ARCHAIC))), ("xref_fragment", rx("low", "^(see |véase )")),
        ("pronoun_stopword", "low IN ('" + "', '".join(T.PRONOUNS) + "')"), ("leading_punct", rx("s", T.LEADING)), ("markdown_heading", rx("s", r"^#{1,6}\s|\s#{2,}\s*$|^#{2,}$")),
        ("measurement", rx("low", word(T.UNITS, "s?")) + f" AND length(regexp_replace(s, '[^0-9]', '', 'g')) >= 0.18 * {alnum}"), ("sentence_fragment_es", rx("s", "^(" + "|".join(T.OPENERS) + r")\s+[\p{L}\p{N}_]")), ("lowercase_token", rx("s", "^[a-záéíóúñüç]+$")),
    ]
    return "CASE " + " ".join(f"WHEN {cond} THEN '{name}'" for name, cond in cases) + " END"


@query(rf"""SELECT reason, count(*) AS names, CAST(sum(n) AS BIGINT) AS uses FROM (SELECT n, {garbage_sql()} AS reason FROM (SELECT n, s, lower(s) low FROM (SELECT n, coalesce(regexp_replace(name, '^[ \t\n\f\r\v]+|[ \t\n\f\r\v]+$', '', 'g'), '') s FROM ({NAMES}) WHERE name IS NOT NULL))) GROUP BY 1""")
def garbage_reason(spark: SparkSession, sf: str) -> DataFrame:
    """Reasons over all words of the chunks, entity names and aliases, with their counts."""
    words = table(spark, sf, "chunks").select(F.explode(F.split("text", r"\s+")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    names = table(spark, sf, "entities").select("name").union(table(spark, sf, "entity_aliases").select("alias")).groupBy("name").agg(F.count("*").alias("n")).where("name is not null")
    return words.unionByName(names).withColumn("reason", T.garbage_reason(F.col("name"))).groupBy("reason").agg(F.count("*").alias("names"), F.sum("n").alias("uses"))


@query(rf"""SELECT reason, count(*) AS names FROM (SELECT unnest(list_filter([CASE WHEN NOT regexp_matches(s, '[\p{{L}}\p{{N}}]') THEN 'all_punct' END, CASE WHEN length(s) > 80 THEN 'too_long' END, CASE WHEN length(s) < 3 THEN 'too_short' END,
 CASE WHEN lower(s) IN ('{"', '".join(T.PRONOUNS)}') THEN 'pronoun_stopword' END, CASE WHEN regexp_matches(lower(s), '^(see |véase )') THEN 'xref_fragment' END, CASE WHEN regexp_matches(lower(s), '(^|[^\p{{L}}\p{{N}}_])({"|".join(T.ARCHAIC)})([^\p{{L}}\p{{N}}_]|$)') THEN 'archaic_verb' END,
 CASE WHEN regexp_matches(lower(s), 'https?://|www\.|[a-z0-9][a-z0-9-]*\.({"|".join(T.DOMAINS)})\b') THEN 'url_like' END], lambda x: x IS NOT NULL)) AS reason FROM (SELECT DISTINCT name s FROM ({NAMES}) WHERE name IS NOT NULL)) GROUP BY 1""")
def garbage_multilabel(spark: SparkSession, sf: str) -> DataFrame:
    """All reasons of the set-based clean-up that hold for a distinct word, name or alias."""
    words = table(spark, sf, "chunks").select(F.explode(F.split("text", r"\s+")).alias("s"))
    names = words.union(table(spark, sf, "entities").select("name")).union(table(spark, sf, "entity_aliases").select("alias")).where("s is not null").distinct()
    return names.select(F.explode(T.garbage_reasons(F.col("s"))).alias("reason")).groupBy("reason").agg(F.count("*").alias("names"))


@query("""SELECT doc_id, CASE WHEN p > 0 THEN (CASE WHEN greatest(1, p - 60) > 1 THEN '...' ELSE '' END) || substring(text, CAST(greatest(1, p - 60) AS INT), 120) || (CASE WHEN greatest(1, p - 60) + 120 <= length(text) THEN '...' ELSE '' END) END AS snippet
FROM (SELECT doc_id, text, strpos(lower(text), 'lantern') p FROM documents WHERE text IS NOT NULL)""".replace("lantern", "harvest"))
def snippet(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", T.snippet(F.col("text"), F.lit("harvest")).alias("snippet"))


@query("SELECT event_type, v[CAST(floor(0.5 * len(v)) AS INT) + 1] AS p50, v[CAST(floor(0.95 * len(v)) AS INT) + 1] AS p95, v[CAST(floor(0.99 * len(v)) AS INT) + 1] AS p99 FROM (SELECT event_type, list(value ORDER BY value) v FROM events WHERE value IS NOT NULL GROUP BY 1)")
def latency_percentile(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles by index, floor(p n), without interpolation."""
    return search.index_percentiles(table(spark, sf, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("SELECT count(*) AS docs, count(title) AS title, count(author) AS author, count(series) AS series, count(published_at) AS published_at, count(lang) AS lang FROM documents")
def fill_rate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count("*").alias("docs"), *[F.count(c).alias(c) for c in ("title", "author", "series", "published_at", "lang")])


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'pt') AS pt FROM (SELECT lower(trim(source)) source, lower(lang) lang FROM documents) GROUP BY 1")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.lower(F.trim("source")).alias("source"), F.lower("lang").alias("lang"))
    return d.groupBy("source").agg(*[F.count_if(F.col("lang") == x).alias(x) for x in ("en", "es", "fr", "pt")])


# ---------------------------------------------------------------------------------------------------------------------
# retrieval
TERMS = ("covenant", "harvest")
WORDS = "string_split(" + PLAIN.format("text") + ", ' ')"


@query(f"SELECT id, CAST(len(list_filter(w, lambda x: x IN ('covenant', 'harvest'))) AS INT) AS hits FROM (SELECT id, {WORDS} w FROM chunks WHERE text IS NOT NULL) WHERE list_contains(w, 'covenant') AND list_contains(w, 'harvest') AND NOT list_contains(w, 'plough')")
def fts_match(spark: SparkSession, sf: str) -> DataFrame:
    return search.match_all(chunk_texts(spark, sf), "id", "text", list(TERMS), ["plough"])


RANK = f"SELECT id, round(0.1 * len(list_filter({WORDS}, lambda x: x = 'covenant')), 6) AS score FROM chunks WHERE text IS NOT NULL AND list_contains({WORDS}, 'covenant')"


@query(f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({RANK}) ORDER BY score DESC, id LIMIT 20")
def fts_rank(spark: SparkSession, sf: str) -> DataFrame:
    return search.top(search.cover_rank(chunk_texts(spark, sf), "id", "text", ["covenant"]), "score", "id", 20)


def cover_sql(terms: tuple[str, ...]) -> str:
    """Shortest stretches with all terms: from each hit on to the first place where every term has come; of those that end together
    the shortest."""
    nxt = ", ".join(f"min(CASE WHEN w = '{t}' THEN i END) OVER n AS i{k}" for k, t in enumerate(terms))
    end = ", ".join(f"i{k}" for k in range(len(terms)))
    some = " AND ".join(f"i{k} IS NOT NULL" for k in range(len(terms)))
    inlist = ", ".join(f"'{t}'" for t in terms)
    return f"""WITH t AS (SELECT id, unnest({WORDS}) w, generate_subscripts({WORDS}, 1) p FROM chunks WHERE text IS NOT NULL), h AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) i FROM t WHERE w IN ({inlist})),
e AS (SELECT *, {nxt} FROM h WINDOW n AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), r AS (SELECT id, i, p, greatest({end}) j FROM e WHERE {some}), c AS (SELECT id, j, max(i) i FROM r GROUP BY 1, 2)
SELECT c.id AS id, round(sum(0.1 / (1 + (b.p - a.p) - (b.i - a.i))), 6) AS score FROM c JOIN h a ON a.id = c.id AND a.i = c.i JOIN h b ON b.id = c.id AND b.i = c.j GROUP BY 1"""


@query(cover_sql(TERMS))
def fts_cover(spark: SparkSession, sf: str) -> DataFrame:
    return search.cover_rank(chunk_texts(spark, sf), "id", "text", list(TERMS))


@query(cover_sql(("the", "of", "hope")))
def fts_cover_three(spark: SparkSession, sf: str) -> DataFrame:
    """Three terms, two of them frequent, so that stretches overlap and repeat terms."""
    return search.cover_rank(chunk_texts(spark, sf), "id", "text", ["the", "of", "hope"])


@query("SELECT q.vec_id AS query, e.vec_id AS vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) <= 20")
def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return search.nearest(v, v.where("vec_id % 100 = 0"), "vec_id", "embedding", 20).select("query", "vec_id", "score")


@query("SELECT q.vec_id AS query, e.vec_id AS vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND q.label = e.label QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) <= 20")
def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return search.nearest(v, v.where("vec_id % 100 = 0").withColumn("grp", F.col("label")), "vec_id", "embedding", 20, F.col("label")).select("query", "vec_id", "score")


KNN = "SELECT chunk_id AS id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (SELECT DISTINCT e.chunk_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) score FROM (SELECT * FROM chunk_embeddings WHERE len(embedding) = 384 AND model_version LIKE '%v2' AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN 0 ELSE 1 END), 'sum') = 0 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'sum') > 0) e, (SELECT embedding FROM chunk_embeddings WHERE len(embedding) = 384 AND model_version LIKE '%v2' AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN 0 ELSE 1 END), 'sum') = 0 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'sum') > 0 ORDER BY chunk_id LIMIT 1) q) ORDER BY score DESC, chunk_id LIMIT 30"


def usable_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "chunk_embeddings").where("size(embedding) = 384 and model_version like '%v2'")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.where(finite & F.exists("embedding", lambda x: x != 0)).select(F.col("chunk_id").alias("id"), "embedding")


def hybrid(spark: SparkSession, sf: str) -> DataFrame:
    texts = search.top(search.cover_rank(chunk_texts(spark, sf), "id", "text", ["covenant"]), "score", "id", 30)
    v = usable_vectors(spark, sf)
    q = v.orderBy("id").limit(1)
    # repeated rows (an id comes twice at most) go after the best are found
    best = search.nearest(v, q, "id", "embedding", 60).select("id", "score").distinct()
    return search.fuse(texts.select("id", "rank"), search.top(best, "score", "id", 30).select("id", "rank"), "id")


FUSED = f"SELECT coalesce(t.id, v.id) AS id, t.rank AS left_rank, v.rank AS right_rank, round(coalesce(0.4 / (60 + t.rank), 0.0) + coalesce(0.6 / (60 + v.rank), 0.0), 8) AS fused FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({RANK}) ORDER BY score DESC, id LIMIT 30) t FULL JOIN ({KNN}) v ON t.id = v.id"


@query(f"SELECT * FROM ({FUSED}) ORDER BY fused DESC, id LIMIT 20")
def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid(spark, sf).orderBy(F.desc("fused"), "id").limit(20)


AUTHORITY = {"manuals": 60, "study-aids": 57, "books": 40, "commentary": 15}


@query(f"""SELECT file_path, chunk_index, round(fused * (1 + authority / 200.0) * CASE WHEN hinted THEN 1.5 ELSE 1 END, 8) AS score FROM (SELECT c.file_path, c.chunk_index, f.fused, CASE regexp_extract(c.file_path, '^(?:[a-z]{{2}}/)?([^/]*)', 1) WHEN 'manuals' THEN 60 WHEN 'study-aids' THEN 57 WHEN 'books' THEN 40 WHEN 'commentary' THEN 15 ELSE 30 END authority,
 c.file_path IN (SELECT file_path FROM entity_document_mentions WHERE entity_id = 1) hinted, row_number() OVER (PARTITION BY c.file_path, c.chunk_index ORDER BY f.fused DESC, c.id) rn FROM ({FUSED}) f JOIN chunks c ON c.id = f.id) WHERE rn = 1""")
def retrieve_boosted(spark: SparkSession, sf: str) -> DataFrame:
    """Fused hits with a boost by authority of their source and by files that mention an entity of the question; copies go."""
    kind = F.regexp_extract("file_path", r"^(?:[a-z]{2}/)?([^/]*)", 1)
    authority = F.lit(30)
    for k, v in AUTHORITY.items():
        authority = F.when(kind == k, v).otherwise(authority)
    hints = table(spark, sf, "entity_document_mentions").where("entity_id = 1").select("file_path", F.lit(1.5).alias("boost")).distinct()
    hits = hybrid(spark, sf).join(table(spark, sf, "chunks").select("id", "file_path", "chunk_index"), "id")
    hits = graph.first_by(hits, ["file_path", "chunk_index"], [F.desc("fused"), F.col("id")]).join(hints, "file_path", "left")
    return hits.select("file_path", "chunk_index", F.round(F.col("fused") * (1 + authority / 200.0) * F.coalesce("boost", F.lit(1.0)), 8).alias("score"))


@query("""WITH p AS (SELECT src_file_path a, dst_file_path b, layer FROM document_parallels UNION SELECT dst_file_path, src_file_path, layer FROM document_parallels)
SELECT a AS file_path, b AS parallel, layer, count(c.id) AS chunks FROM p JOIN chunks c ON c.file_path = p.b WHERE a <> b GROUP BY 1, 2, 3""")
def expand_parallels(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "document_parallels")
    both = d.select(F.col("src_file_path").alias("a"), F.col("dst_file_path").alias("b"), "layer").union(d.select("dst_file_path", "src_file_path", "layer")).distinct().where("a <> b")
    n = table(spark, sf, "chunks").groupBy(F.col("file_path").alias("b")).agg(F.count("*").alias("chunks"))
    return both.join(n, "b").select(F.col("a").alias("file_path"), F.col("b").alias("parallel"), "layer", "chunks")


GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


SIMILAR = "round(len(list_intersect({0}, q)) / CAST(len({0}) + len(q) - len(list_intersect({0}, q)) AS DOUBLE), 6)"


@query(f"""WITH q AS (SELECT {GRAMS.format("'or'")} q), j AS (SELECT id, name, alias FROM entities LEFT JOIN entity_aliases ON entity_id = id WHERE contains(lower(name), 'or') OR contains(lower(alias), 'or'))
SELECT id, name, greatest(max({SIMILAR.format(GRAMS.format('name'))}), coalesce(max({SIMILAR.format(GRAMS.format('alias'))}), 0)) AS score FROM j, q GROUP BY 1, 2 ORDER BY score DESC, id LIMIT 50""")
def trigram_find(spark: SparkSession, sf: str) -> DataFrame:
    """Entities whose name or an alias contains 'or', most similar first; names count with the similarity of either."""
    return graph.find(table(spark, sf, "entities"), table(spark, sf, "entity_aliases"), "or", 50).drop("entity_type")


@query(f"""SELECT id, name, round(len(list_intersect(g, q)) / CAST(len(g) + len(q) - len(list_intersect(g, q)) AS DOUBLE), 6) AS score FROM (SELECT p_partkey id, p_name AS name, {GRAMS.format('p_name')} g, {GRAMS.format("'red widget'")} q FROM part WHERE contains(lower(p_name), 'widget')) ORDER BY score DESC, id LIMIT 50""")
def trigram_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Part names with 'widget' by their likeness to 'red widget': each is scored once, and each task keeps its best 50."""
    p = table(spark, sf, "part").where(F.lower("p_name").contains("widget"))
    probe = F.lit("red widget")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.round(T.similarity(T.trigrams(F.col("p_name")), T.trigrams(probe)), 6).alias("score")).orderBy(F.desc("score"), "id").limit(50)


@query("""SELECT pattern, count(*) AS hits, min(p_partkey) AS first_id FROM part, (SELECT unnest(['red', 'blue', 'gear', 'bolt']) pattern) WHERE contains(lower(p_name), pattern) GROUP BY 1""")
def find_batch(spark: SparkSession, sf: str) -> DataFrame:
    patterns = spark.createDataFrame([("red",), ("blue",), ("gear",), ("bolt",)], "pattern string")
    p = table(spark, sf, "part").join(F.broadcast(patterns), F.lower("p_name").contains(F.col("pattern")))
    return p.groupBy("pattern").agg(F.count("*").alias("hits"), F.min("p_partkey").alias("first_id"))


# ---------------------------------------------------------------------------------------------------------------------
# graph
@query(f"WITH {ENT}, {REL} SELECT 'entities' AS what, entity_type AS kind, count(*) AS n FROM ent GROUP BY 2 UNION ALL SELECT 'relations', rel_type, count(*) FROM rel GROUP BY 2")
def graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = entity_view(spark, sf).groupBy(F.col("entity_type").alias("kind")).agg(F.count("*").alias("n")).withColumn("what", F.lit("entities"))
    r = edge_view(spark, sf).groupBy(F.col("rel_type").alias("kind")).agg(F.count("*").alias("n")).withColumn("what", F.lit("relations"))
    return e.unionByName(r)


@query(f"WITH {ENT}, {REL}, {BOTH} SELECT a, b, rel_type, confidence, outgoing, name AS other, {TIER} AS tier FROM both_ways JOIN ent ON id = b WHERE a = 107")
def neighbors_1hop(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(entity_view(spark, sf), edge_view(spark, sf), [107]).drop("other_type")


@query(f"WITH {REL}, {BOTH}, one AS (SELECT DISTINCT b id FROM both_ways WHERE a = 107), two AS (SELECT DISTINCT b id FROM both_ways WHERE a IN (SELECT id FROM one)) SELECT id, min(hops) AS hops FROM (SELECT CAST(107 AS BIGINT) id, 0 hops UNION ALL SELECT id, 1 FROM one UNION ALL SELECT id, 2 FROM two) GROUP BY 1")
def neighbors_2hop(spark: SparkSession, sf: str) -> DataFrame:
    return graph.within_hops(edge_view(spark, sf), [107], 2)


@query(f"WITH {ENT}, {REL}, {BOTH} SELECT a, b, rel_type, confidence, outgoing, name AS other, {TIER} AS tier FROM both_ways JOIN ent ON id = b WHERE a IN (105, 107, 111) AND confidence IN ('curated', 'metadata', 'llm_high')")
def typed_relations(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(entity_view(spark, sf), edge_view(spark, sf), [105, 107, 111], floor="llm_high").drop("other_type")


@query("SELECT e.name AS name, string_agg(DISTINCT m.file_path, '|' ORDER BY m.file_path) AS files FROM entity_document_mentions m JOIN entities e ON e.id = m.entity_id JOIN document_registry r ON r.file_path = m.file_path GROUP BY e.id, e.name")
def docs_for_entity(spark: SparkSession, sf: str) -> DataFrame:
    """The registered files of every mentioned entity; a file counts once before the list is built."""
    m = table(spark, sf, "entity_document_mentions").select("entity_id", "file_path").distinct()
    m = m.join(table(spark, sf, "document_registry").select("file_path"), "file_path", "left_semi")
    files = m.groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_list("file_path")), "|").alias("files"))
    return files.join(table(spark, sf, "entities").select(F.col("id").alias("entity_id"), "name").distinct(), "entity_id").select("name", "files")


@query("SELECT entity_id, coalesce(nullif(resolved_name, ''), '-') AS resolved, count(DISTINCT file_path) AS files FROM entity_document_mentions GROUP BY 1, 2")
def disambiguated_counts(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "entity_document_mentions")
    return m.groupBy("entity_id", F.coalesce(F.nullif("resolved_name", F.lit("")), F.lit("-")).alias("resolved")).agg(F.countDistinct("file_path").alias("files"))


@query(f"""WITH RECURSIVE {REL}, t AS (SELECT CAST(1 AS BIGINT) id, 0 AS level, '1' AS path UNION ALL SELECT src, level + 1, path || ',' || src FROM t JOIN rel ON dst = id WHERE rel_type IN ('PART_OF', 'BELONGS_TO') AND level < 2) SELECT id, level, path FROM t""")
def family_tree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.descendants(edge_view(spark, sf).where(F.col("rel_type").isin("PART_OF", "BELONGS_TO")), 1, 2)


@query(f"""WITH {REL}, {BOTH}, s AS (SELECT DISTINCT a, b FROM both_ways WHERE rel_type <> 'ASSOCIATED_WITH'), goal AS (SELECT min(c.src) g FROM rel c JOIN rel cn ON cn.src = c.dst JOIN rel sn ON sn.dst = cn.dst AND sn.src <> cn.src JOIN rel x ON x.dst = sn.src WHERE x.src = {SUPPLIER + 1} AND c.src >= {CUSTOMER} AND c.src < {PART} AND cn.rel_type = 'PART_OF' AND sn.rel_type = 'PART_OF'),
p1 AS (SELECT b id, [{SUPPLIER + 1}, b] path FROM s WHERE a = {SUPPLIER + 1}), p2 AS (SELECT s.b id, list_append(path, s.b) path FROM p1 JOIN s ON s.a = p1.id WHERE s.b < 1000), p3 AS (SELECT s.b id, list_append(path, s.b) path FROM p2 JOIN s ON s.a = p2.id WHERE s.b < 1000), p4 AS (SELECT s.b id, list_append(path, s.b) path FROM p3 JOIN s ON s.a = p3.id)
SELECT CAST(len(path) - 1 AS INT) AS hops, array_to_string(path, ',') AS path FROM p4, goal WHERE id = g ORDER BY path LIMIT 1""")
def family_path(spark: SparkSession, sf: str) -> DataFrame:
    """One shortest path between a supplier and the first customer of another nation of its region, over places only."""
    e = edge_view(spark, sf).where("rel_type <> 'ASSOCIATED_WITH'")
    own = table(spark, sf, "supplier").where("s_suppkey = 1").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("r"), F.col("s_nationkey").alias("own"))
    others = table(spark, sf, "nation").join(own, F.col("n_regionkey") == F.col("r")).where("n_nationkey <> own")
    goal = table(spark, sf, "customer").join(others, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").agg(F.min("c_custkey")).first()[0]
    return graph.shortest_path(e, SUPPLIER + 1, CUSTOMER + (goal or 0))


@query("""WITH s AS (SELECT n_nationkey + 100 a, n_nationkey + 101 b FROM nation WHERE n_nationkey % 5 < 2), p AS (SELECT n_regionkey p, n_nationkey + 100 x FROM nation WHERE n_nationkey % 5 = 0),
sib AS (SELECT a src, b dst FROM s UNION SELECT b, a FROM s), p1 AS (SELECT p, x FROM p UNION SELECT p, dst FROM p JOIN sib ON x = src), p2 AS (SELECT p, x FROM p1 UNION SELECT p, dst FROM p1 JOIN sib ON x = src)
SELECT CAST(src AS BIGINT) src, 'SIBLING_OF' AS rel_type, CAST(dst AS BIGINT) dst FROM sib UNION ALL SELECT CAST(p AS BIGINT), 'FATHER_OF', CAST(x AS BIGINT) FROM p2""")
def family_closure(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    key = F.col("n_nationkey").cast("long")
    sib = n.where("n_nationkey % 5 < 2").select((key + 100).alias("src"), F.lit("SIBLING_OF").alias("rel_type"), (key + 101).alias("dst"))
    par = n.where("n_nationkey % 5 = 0").select(F.col("n_regionkey").cast("long").alias("src"), F.lit("FATHER_OF").alias("rel_type"), (key + 100).alias("dst"))
    return graph.closure(sib.unionByName(par), ["SIBLING_OF"], "SIBLING_OF", "FATHER_OF").drop("reason")


@query(f"""WITH RECURSIVE {REL}, core AS (SELECT DISTINCT unnest([src, dst]) id FROM rel WHERE src IN (107, {SUPPLIER + 3}) OR dst IN (107, {SUPPLIER + 3})), inner_edges AS (SELECT DISTINCT least(src, dst) x, greatest(src, dst) y FROM rel WHERE src IN (FROM core) AND dst IN (FROM core)),
sub AS (SELECT x a, y b FROM inner_edges UNION ALL SELECT y, x FROM inner_edges), deg AS (SELECT a, count(*) deg FROM sub GROUP BY 1), r(step, id, score) AS (SELECT 0, id, 1.0::DOUBLE / (SELECT count(*) FROM core) FROM core
 UNION ALL SELECT step + 1, id, 0.5 * CASE WHEN id IN (107, {SUPPLIER + 3}) THEN 0.5 ELSE 0 END + 0.5 * sum(got) FROM (SELECT r.step, sub.b id, r.score / deg.deg got FROM r JOIN sub ON sub.a = r.id JOIN deg ON deg.a = r.id WHERE r.step < 20) GROUP BY step, id)
SELECT id, round(score, 5) AS score FROM r WHERE step = 20""")
def ppr(spark: SparkSession, sf: str) -> DataFrame:
    return graph.pagerank(edge_view(spark, sf), [107, SUPPLIER + 3]).select("id", F.round("score", 5).alias("score"))


@query(f"WITH {REL} SELECT round(avg(d), 6) AS avg_degree, min(d) AS min_degree, max(d) AS max_degree, count(*) AS nodes FROM (SELECT src, count(*) d FROM rel GROUP BY 1)")
def degree_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(edge_view(spark, sf))


# ---------------------------------------------------------------------------------------------------------------------
# extraction
SINGLE = f"SELECT {PLAIN.format('name')} term, id, entity_type FROM entities UNION SELECT {PLAIN.format('alias')}, entity_id, entity_type FROM entity_aliases JOIN entities ON id = entity_id"


@query(f"""WITH g AS (SELECT * FROM ({SINGLE}) WHERE term <> '' AND NOT contains(term, ' ')), w AS (SELECT DISTINCT id AS chunk_id, unnest({WORDS}) term FROM chunks WHERE text IS NOT NULL)
SELECT g.id AS entity_id, count(DISTINCT chunk_id) AS chunks FROM w JOIN g ON g.term = w.term GROUP BY 1""")
def gazetteer_words(spark: SparkSession, sf: str) -> DataFrame:
    """Single-word names only, which SQL can hold against; gazetteer_entities has the longest-match form."""
    words = table(spark, sf, "chunks").where("text is not null").select("id", F.explode(F.array_distinct(F.split(T.normalised(F.col("text")), " "))).alias("term"))
    g = extract.gazetteer(table(spark, sf, "entities"), table(spark, sf, "entity_aliases")).where("n = 1")
    return words.join(F.broadcast(g), "term").groupBy("entity_id").agg(F.countDistinct("id").alias("chunks"))

CITED = "trim(regexp_replace(translate(regexp_replace(lower(text), '[.]?[ \\t\\n\\f\\r]+[0-9]{1,3}:[0-9]{1,3}(?:[-–][0-9]{1,3})?', ' ' || chr(1) || ' ', 'g'), '" + T.FOLD[0] + "', '" + T.FOLD[1] + "'), '[^a-z0-9\\x01]+', ' ', 'g'))"

#: Dictionary hits on whole words of the chunks, read from the left, the longest at a place, a citation's book left out.
FOUND = f"""dict AS (SELECT DISTINCT term, id AS entity_id, entity_type, CAST(len(string_split(term, ' ')) AS INT) n FROM ({SINGLE}) WHERE term <> ''),
tok AS (SELECT id, string_split({CITED}, ' ') w FROM chunks WHERE text IS NOT NULL), pos AS (SELECT id, w, CAST(unnest(range(0, len(w))) AS INT) pos FROM tok),
hit AS (SELECT p.id, p.pos, d.n, d.entity_id, d.entity_type FROM (SELECT id, w, pos, unnest((SELECT list(DISTINCT n) FROM dict)) n FROM pos) p JOIN dict d ON d.n = p.n AND d.term = array_to_string(p.w[p.pos + 1 : p.pos + p.n], ' ') WHERE p.pos + p.n <= len(p.w) AND (p.pos + p.n = len(p.w) OR p.w[p.pos + p.n + 1] <> chr(1))),
best AS (SELECT id, pos, max(n) n FROM hit GROUP BY 1, 2), link AS (SELECT a.id, a.pos, a.n, min(b.pos) nxt FROM best a LEFT JOIN best b ON b.id = a.id AND b.pos >= a.pos + a.n GROUP BY 1, 2, 3),
walk AS (SELECT l.id, l.pos, l.n, l.nxt FROM link l JOIN (SELECT id, min(pos) pos FROM best GROUP BY 1) f ON f.id = l.id AND f.pos = l.pos UNION ALL SELECT l.id, l.pos, l.n, l.nxt FROM walk v JOIN link l ON l.id = v.id AND l.pos = v.nxt),
found AS (SELECT h.id, h.entity_id, h.entity_type, min({{pos: h.pos, n: h.n}}) first_at FROM walk v JOIN hit h ON h.id = v.id AND h.pos = v.pos AND h.n = v.n GROUP BY 1, 2, 3)"""


def found_entities(spark: SparkSession, sf: str) -> DataFrame:
    g = extract.gazetteer(table(spark, sf, "entities"), table(spark, sf, "entity_aliases"))
    return extract.mentions(chunk_texts(spark, sf), "id", "text", g)


@query(f"WITH RECURSIVE {FOUND} SELECT id, entity_id, entity_type, first_at.pos AS pos, first_at.n AS n FROM found")
def gazetteer_entities(spark: SparkSession, sf: str) -> DataFrame:
    return found_entities(spark, sf)


@query(f"""WITH RECURSIVE {FOUND}, pair AS (SELECT x.id, x.entity_id a, y.entity_id b, least(x.entity_type, y.entity_type) s, greatest(x.entity_type, y.entity_type) t FROM found x JOIN found y ON x.id = y.id AND x.entity_id < y.entity_id)
SELECT a, b, CASE WHEN s = t AND s = 'person' THEN 'CO_OCCURS_WITH' WHEN s = t AND s = 'concept' THEN 'RELATED_TO' {" ".join(f"WHEN s = '{min(x, y)}' AND t = '{max(x, y)}' THEN '{r}'" for (x, y), r in extract.TYPE_RULES.items() if x != y)} ELSE 'CO_OCCURS_WITH' END AS rel_type, count(*) AS texts FROM pair GROUP BY 1, 2, 3""")
def cooccurrence_relations(spark: SparkSession, sf: str) -> DataFrame:
    return extract.cooccurrence(cut(found_entities(spark, sf)), "id", extract.TYPE_RULES)


@query("SELECT doc_id, 'AUTHORED_BY' AS rel_type, author AS target FROM documents WHERE author IS NOT NULL UNION ALL SELECT doc_id, 'PART_OF', series FROM documents WHERE series IS NOT NULL UNION ALL SELECT doc_id, 'PUBLISHED_IN', lower(trim(source)) FROM documents WHERE source IS NOT NULL")
def meta_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("author").alias("AUTHORED_BY"), F.col("series").alias("PART_OF"), F.lower(F.trim("source")).alias("PUBLISHED_IN"))
    return d.unpivot("doc_id", ["AUTHORED_BY", "PART_OF", "PUBLISHED_IN"], "rel_type", "target").where("target is not null")


@query("SELECT x.l_orderkey AS l_orderkey, x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber")
def parallel_pairs(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    y = li.select("l_orderkey", F.col("l_partkey").alias("b"), F.col("l_linenumber").alias("m"))
    return li.join(y, "l_orderkey").where("l_linenumber < m").select("l_orderkey", F.col("l_partkey").alias("a"), "b")


@query("SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def event_chain(spark: SparkSession, sf: str) -> DataFrame:
    return extract.chain(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_id").select("event_id", "previous")


@query("SELECT user_id, event_type, count(*) AS frequency, min(ts) AS first_seen, max(ts) AS last_seen, array_to_string(list_sort(list_distinct(list(k)))[1:10], ',') AS samples FROM (SELECT *, json_extract_string(props, '$.k') k FROM events) GROUP BY 1, 2")
def candidate_counter(spark: SparkSession, sf: str) -> DataFrame:
    """Counts with ten samples at most: these are found among distinct ones by rank, so no set grows with a key's rows."""
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", F.get_json_object("props", "$.k").alias("k"))
    by = e.groupBy("user_id", "event_type", "k").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    ranked = by.withColumn("rn", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.asc_nulls_last("k"))))
    some = F.sort_array(F.collect_list(F.when(F.col("rn") <= 10, F.col("k"))))
    return ranked.groupBy("user_id", "event_type").agg(F.sum("n").alias("frequency"), F.min("lo").alias("first_seen"), F.max("hi").alias("last_seen"), F.array_join(some, ",").alias("samples"))


@query("SELECT user_id, event_type, frequency FROM (SELECT user_id, event_type, count(*) frequency, max(ts) last_seen FROM events GROUP BY 1, 2) WHERE NOT (frequency < 14 AND last_seen < (SELECT max(ts) FROM events) - INTERVAL 2 DAY)")
def candidate_prune(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    c = e.groupBy("user_id", "event_type").agg(F.count("*").alias("frequency"), F.max("ts").alias("last_seen"))
    c = c.join(F.broadcast(e.agg(F.max("ts").alias("now"))), F.lit(True))
    return c.where(~((F.col("frequency") < 14) & (F.col("last_seen") < F.col("now") - F.expr("INTERVAL 2 DAYS")))).select("user_id", "event_type", "frequency")


# ---------------------------------------------------------------------------------------------------------------------
# merge and quality
@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 4 <> 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 1 THEN NULL ELSE 'N' END o_orderstatus, o_totalprice + 1 o_totalprice FROM orders WHERE o_orderkey % 4 < 2)
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN o.o_orderstatus ELSE coalesce(n.o_orderstatus, o.o_orderstatus) END AS o_orderstatus, round(CASE WHEN n.o_orderkey IS NULL THEN o.o_totalprice ELSE n.o_totalprice END, 2) AS o_totalprice FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def upsert_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The two states are made by rule from all orders."""
    d = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = d.where("o_orderkey % 4 < 2").select("o_orderkey", F.when(F.col("o_orderkey") % 8 != 1, "N").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return merge.upsert(d.where("o_orderkey % 4 <> 0"), new, ["o_orderkey"], ["o_orderstatus"]).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("""WITH m AS (SELECT entity_id, file_path, resolved_name, confidence FROM entity_document_mentions), o AS (SELECT DISTINCT entity_id, file_path FROM m WHERE entity_id % 2 = 0)
SELECT entity_id, file_path FROM o UNION SELECT entity_id, file_path FROM m""")
def insert_absent(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "entity_document_mentions").select("entity_id", "file_path")
    return merge.insert_absent(m.where("entity_id % 2 = 0").distinct(), m, ["entity_id", "file_path"], [F.col("entity_id")])


@query("SELECT (SELECT count(*) FROM chunks WHERE file_path NOT IN (SELECT file_path FROM document_registry WHERE status = 'error' AND file_path IS NOT NULL)) AS chunks, (SELECT count(*) FROM entity_document_mentions WHERE file_path NOT IN (SELECT file_path FROM document_registry WHERE status = 'error' AND file_path IS NOT NULL)) AS mentions")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "document_registry").where("status = 'error'").select("file_path")
    c, m = merge.cascade_delete(gone, "file_path", (table(spark, sf, "chunks").select("file_path"), "file_path"), (table(spark, sf, "entity_document_mentions").select("file_path"), "file_path"))
    return one_row(c.agg(F.count("*").alias("chunks")), m.agg(F.count("*").alias("mentions")))


PLAN = f"""plan AS (SELECT id, first_value(id) OVER w AS winner, count(*) OVER (PARTITION BY entity_type, canonical) n FROM (SELECT *, {PLAIN.format('name')} canonical FROM ent) WHERE canonical <> '' WINDOW w AS (PARTITION BY entity_type, canonical ORDER BY CASE WHEN lower(name) = canonical THEN 0 ELSE 1 END, id))"""


@query(f"WITH {ENT}, {PLAN} SELECT id, winner FROM plan WHERE n > 1")
def merge_plan(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge_plan(entity_view(spark, sf), T.normalised(F.col("name")))


@query(f"""WITH {ENT}, {REL}, {PLAN}, m AS (SELECT id, winner FROM plan WHERE n > 1 AND id <> winner), r AS (SELECT coalesce(a.winner, src) src, coalesce(b.winner, dst) dst, rel_type, confidence, {TIER} AS tier FROM rel LEFT JOIN m a ON a.id = src LEFT JOIN m b ON b.id = dst)
SELECT src, dst, rel_type, arg_min(confidence, tier) AS confidence FROM r WHERE src <> dst GROUP BY 1, 2, 3""")
def merge_apply(spark: SparkSession, sf: str) -> DataFrame:
    plan = cut(merge.merge_plan(entity_view(spark, sf), T.normalised(F.col("name"))))
    return merge.merge_apply(edge_view(spark, sf), plan)


@query(f"WITH {REL} SELECT rel_type, confidence, count(*) AS n FROM rel WHERE NOT ((rel_type = 'CO_OCCURS_WITH' OR (rel_type IN ('ASSOCIATED_WITH', 'RELATED_TO', 'BELONGS_TO', 'LIVED_DURING', 'EXISTS_DURING', 'REFERENCED_IN', 'TEACHES') AND confidence = 'llm_low')) AND confidence NOT IN ('curated', 'metadata', 'llm_high')) GROUP BY 1, 2")
def prune_relations(spark: SparkSession, sf: str) -> DataFrame:
    weak = F.col("rel_type").isin("ASSOCIATED_WITH", "RELATED_TO", "BELONGS_TO", "LIVED_DURING", "EXISTS_DURING", "REFERENCED_IN", "TEACHES") & (F.col("confidence") == "llm_low")
    noise = ((F.col("rel_type") == "CO_OCCURS_WITH") | weak) & ~F.col("confidence").isin("curated", "metadata", "llm_high")
    return edge_view(spark, sf).where(~noise).groupBy("rel_type", "confidence").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT DISTINCT file_path, chunk_index, start_char, end_char FROM chunks), o AS (SELECT *, lag(end_char) OVER (PARTITION BY file_path ORDER BY chunk_index, start_char, end_char) before FROM c WHERE start_char >= 0 AND end_char > start_char)
SELECT f.file_path AS file_path, missing, coalesce(gaps, 0) AS gaps, coalesce(overlapping, 0) AS overlapping FROM (SELECT file_path, CAST(max(chunk_index) + 1 - count(DISTINCT chunk_index) AS BIGINT) missing FROM c GROUP BY 1) f LEFT JOIN (SELECT file_path, count(*) FILTER (start_char > before + 2) gaps, count(*) FILTER (start_char < before) overlapping FROM o GROUP BY 1) g ON g.file_path IS NOT DISTINCT FROM f.file_path""")
def coverage_check(spark: SparkSession, sf: str) -> DataFrame:
    """For each file how many chunk indexes from 0 on are missing, and how often a chunk begins more than a blank line after the one
    before, or within it."""
    c = table(spark, sf, "chunks").select("file_path", "chunk_index", "start_char", "end_char").distinct()
    before = F.lag("end_char").over(Window.partitionBy("file_path").orderBy("chunk_index", "start_char", "end_char"))
    g = c.where("start_char >= 0 and end_char > start_char").withColumn("before", before).groupBy(F.col("file_path").alias("g")).agg(F.count_if(F.col("start_char") > F.col("before") + 2).alias("gaps"), F.count_if(F.col("start_char") < F.col("before")).alias("overlapping"))
    f = c.groupBy("file_path").agg((F.max("chunk_index") + 1 - F.countDistinct("chunk_index")).cast("long").alias("missing"))
    return f.join(g, F.col("file_path").eqNullSafe(F.col("g")), "left").select("file_path", "missing", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("overlapping", F.lit(0)).alias("overlapping"))


@query(f"""WITH r AS (SELECT file_path, chunk_count, status FROM ({LATEST})), c AS (SELECT file_path, count(DISTINCT chunk_index) n FROM chunks GROUP BY 1)
SELECT coalesce(r.file_path, c.file_path) AS file_path, CASE WHEN r.file_path IS NULL THEN 'orphan' WHEN c.file_path IS NULL THEN 'no_chunks' WHEN r.chunk_count IS DISTINCT FROM n THEN 'count_differs' WHEN status <> 'indexed' THEN 'not_indexed' ELSE 'ok' END AS finding FROM r FULL JOIN c ON r.file_path = c.file_path""")
def reconcile_findings(spark: SparkSession, sf: str) -> DataFrame:
    r = latest_registry(spark, sf).select(F.col("file_path").alias("r"), "chunk_count", "status")
    c = table(spark, sf, "chunks").groupBy(F.col("file_path").alias("c")).agg(F.countDistinct("chunk_index").alias("n"))
    finding = F.when(F.col("r").isNull(), "orphan").when(F.col("c").isNull(), "no_chunks").when(~F.col("chunk_count").eqNullSafe(F.col("n")), "count_differs").when(F.col("status") != "indexed", "not_indexed").otherwise("ok")
    return r.join(c, F.col("r") == F.col("c"), "full").select(F.coalesce("r", "c").alias("file_path"), finding.alias("finding"))


#: Part names stand for entities; each has the name of another for an alias, by a fixed rule.
NAMED_PARTS = "ent AS (SELECT min(p_partkey) id, p_name name FROM part GROUP BY 2), num AS (SELECT *, row_number() OVER (ORDER BY id) - 1 r, count(*) OVER () n FROM ent), al AS (SELECT x.id entity_id, y.name alias FROM num x JOIN num y ON y.r = (x.r * 7 + 3) % x.n WHERE x.r % 3 = 0)"


def named_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id")).withColumn("entity_type", F.lit("part"))
    every = Window.partitionBy(F.lit(1))  # distinct names, a list of fixed length
    num = e.withColumn("r", F.row_number().over(every.orderBy("id")) - 1).withColumn("n", F.count("*").over(every))
    y = num.select(F.col("name").alias("alias"), F.col("r").alias("s"))
    return e, num.where("r % 3 = 0").join(y, F.col("s") == (F.col("r") * 7 + 3) % F.col("n")).select(F.col("id").alias("entity_id"), "alias")


@query(f"""WITH {NAMED_PARTS} SELECT a.id AS entity_id, a.name AS name, b.entity_id AS alias_of, CASE WHEN a.name LIKE '%bolt' THEN 'kept' ELSE 'removed' END AS verdict FROM ent a JOIN al b ON lower(a.name) = lower(b.alias) AND a.id <> b.entity_id""")
def alias_hygiene(spark: SparkSession, sf: str) -> DataFrame:
    """Names that are an alias of another entity of the same type, removed but for listed exceptions."""
    e, a = named_parts(spark, sf)
    return maintenance.alias_conflicts(e, a, F.col("name").like("%bolt"))


@query(f"""WITH {NAMED_PARTS}, bad AS (SELECT DISTINCT a.id, b.entity_id FROM ent a JOIN al b ON lower(a.name) = lower(b.alias) AND a.id <> b.entity_id WHERE a.name NOT LIKE '%bolt'), heir AS (SELECT id, min(entity_id) heir FROM bad WHERE entity_id NOT IN (SELECT id FROM bad) GROUP BY 1)
SELECT DISTINCT heir AS entity_id, alias FROM al JOIN heir ON al.entity_id = heir.id WHERE alias <> (SELECT name FROM ent WHERE ent.id = heir)""")
def alias_transfer(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases of removed entities, which go to the entity whose alias they were."""
    e, a = named_parts(spark, sf)
    return maintenance.alias_heirs(e, a, F.col("name").like("%bolt"))


@query("""SELECT entity_id, name, mention_count, doc_count FROM (SELECT e.id AS entity_id, e.name, coalesce(m.n, 0) AS mention_count, coalesce(m.d, 0) AS doc_count FROM entities e LEFT JOIN (SELECT entity_id, count(*) n, count(DISTINCT file_path) d FROM entity_document_mentions GROUP BY 1) m ON m.entity_id = e.id) ORDER BY mention_count DESC, entity_id LIMIT 50""")
def profile_list(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "entity_document_mentions").groupBy("entity_id").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("d"))
    e = table(spark, sf, "entities").select(F.col("id").alias("entity_id"), "name").join(m, "entity_id", "left")
    return e.select("entity_id", "name", F.coalesce("n", F.lit(0)).alias("mention_count"), F.coalesce("d", F.lit(0)).alias("doc_count")).orderBy(F.desc("mention_count"), "entity_id").limit(50)


@query("""WITH m AS (SELECT DISTINCT entity_id, file_path FROM entity_document_mentions), p AS (SELECT m.entity_id, m.file_path, regexp_extract(m.file_path, '^(.*)/', 1) volume, min(c.id) chunk_id FROM m JOIN chunks c ON c.file_path = m.file_path GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, volume ORDER BY file_path) turn FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY turn, volume) place FROM r) SELECT entity_id, chunk_id, place FROM o WHERE place <= 10""")
def profile_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Up to ten passages of an entity, one a document, taken in turns over the volumes. Each file's first chunk is found before the
    join, so a file's chunks aren't multiplied by its mentions."""
    m = table(spark, sf, "entity_document_mentions").select("entity_id", "file_path").distinct()
    c = table(spark, sf, "chunks").groupBy("file_path").agg(F.min("id").alias("chunk_id"))
    p = m.join(c, "file_path").withColumn("volume", F.regexp_extract("file_path", "^(.*)/", 1))
    p = p.withColumn("turn", F.row_number().over(Window.partitionBy("entity_id", "volume").orderBy("file_path")))
    return p.withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy("turn", "volume"))).where("place <= 10").select("entity_id", "chunk_id", "place")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    from lorekiln.streaming.ingest import windowed_counts as counts

    return counts(table(spark, sf, "events"), "1 hour", "1 hour")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2")
def pricing_rollup(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


# ---------------------------------------------------------------------------------------------------------------------
# more operators
#: Authority by category, and patterns of question kinds, both in order of precedence.
CATEGORY_AUTHORITY = [("manuals", 60), ("manuales", 60), ("study-aids", 57), ("ayudas", 57), ("books", 40), ("libros", 40), ("commentary", 15), ("comentarios", 15)]
KINDS = [("soteriological", "repentance|redemption|arrepentimiento"), ("doctrinal", "teach|principle|enseña|doctrin"), ("historical", "year|century|histor|años"), ("teaching", "lesson|example|lección|ejemplo")]


@query("SELECT id, authority, CASE WHEN authority >= 57 THEN 'Correlated' WHEN authority >= 45 THEN 'GA Official' WHEN authority >= 35 THEN 'GA Unofficial' WHEN authority >= 25 THEN 'Institutional' ELSE 'Scholarly' END AS label FROM (SELECT id, CASE regexp_extract(regexp_replace(file_path, '^[a-z]{2}/', ''), '^([^/]*)', 1) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CATEGORY_AUTHORITY) + " ELSE 30 END AS authority FROM chunks)")
def authority_score(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.regexp_extract(F.regexp_replace("file_path", "^[a-z]{2}/", ""), "^([^/]*)", 1)
    a = F.lit(30)
    for k, v in reversed(CATEGORY_AUTHORITY):
        a = F.when(kind == k, v).otherwise(a)
    label = F.when(F.col("authority") >= 57, "Correlated").when(F.col("authority") >= 45, "GA Official").when(F.col("authority") >= 35, "GA Unofficial").when(F.col("authority") >= 25, "Institutional").otherwise("Scholarly")
    return table(spark, sf, "chunks").select("id", a.alias("authority")).withColumn("label", label)


@query("SELECT kind, count(*) AS docs FROM (SELECT CASE WHEN greatest(" + ", ".join(f"k{i}" for i in range(4)) + ") = 0 THEN 'exploratory' " + " ".join(f"WHEN k{i} = greatest(k0, k1, k2, k3) THEN '{n}'" for i, (n, _) in enumerate(KINDS)) + " END AS kind FROM (SELECT " + ", ".join(f"len(regexp_extract_all(lower(text), '{p}')) AS k{i}" for i, (_, p) in enumerate(KINDS)) + " FROM documents WHERE text IS NOT NULL)) GROUP BY 1")
def question_type(spark: SparkSession, sf: str) -> DataFrame:
    """The kind with most matches, the first of equal ones."""
    d = table(spark, sf, "documents").where("text is not null").select(*[F.regexp_count(F.lower("text"), F.lit(p)).alias(f"k{i}") for i, (_, p) in enumerate(KINDS)])
    most = F.greatest("k0", "k1", "k2", "k3")
    kind = F.when(most == 0, "exploratory")
    for i, (n, _) in enumerate(KINDS):
        kind = kind.when(F.col(f"k{i}") == most, n)
    return d.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("docs"))


@query("SELECT CASE WHEN m LIKE 'S%' THEN 'SEE_ALSO' ELSE 'SEE_ALSO_ES' END AS rel_type, regexp_replace(m, '^(See|Véase) ', '') AS target, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?:See|Véase) [A-Z][^0-9.;]*[0-9]+:[0-9]+')) m FROM documents) GROUP BY 1, 2")
def xref_extract(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("(?:See|Véase) [A-Z][^0-9.;]*[0-9]+:[0-9]+"), F.lit(0))).alias("m"))
    return m.groupBy(F.when(F.col("m").startswith("S"), "SEE_ALSO").otherwise("SEE_ALSO_ES").alias("rel_type"), F.regexp_replace("m", "^(See|Véase) ", "").alias("target")).agg(F.count("*").alias("n"))


@query(r"""WITH d AS (SELECT p_partkey id, CASE p_partkey % 6 WHEN 0 THEN 'And ' || a || ', the son of ' || b || ', spoke.' WHEN 1 THEN a || ' begat ' || b || '.' WHEN 2 THEN a || ', esposa de ' || b WHEN 3 THEN a || ' la madre de ' || b WHEN 4 THEN a || ', hermano de ' || b ELSE 'Monte ' || a || ', padre de ' || b END t,
 a, b, p_partkey % 6 k FROM (SELECT p_partkey, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || 'im' a, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || 'el' b FROM part))
SELECT id, CASE WHEN k IN (0, 2) THEN b ELSE a END AS src, CASE k WHEN 0 THEN 'FATHER_OF' WHEN 1 THEN 'FATHER_OF' WHEN 2 THEN 'SPOUSE_OF' WHEN 3 THEN 'MOTHER_OF' ELSE 'BROTHER_OF' END AS rel_type, CASE WHEN k IN (0, 2) THEN a ELSE b END AS dst FROM d WHERE k < 5""")
def family_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences made of part names by a fixed rule, six forms of them; the last names a mountain, which is no one's father."""
    from lorekiln.operators.family import family_edges

    word = lambda i, end: F.concat(F.initcap(F.element_at(F.split("p_name", " "), i)), F.lit(end))
    a, b = word(1, "im"), word(2, "el")
    forms = ["And {a}, the son of {b}, spoke.", "{a} begat {b}.", "{a}, esposa de {b}", "{a} la madre de {b}", "{a}, hermano de {b}", "Monte {a}, padre de {b}"]
    text = F.lit(None).cast("string")
    for k, f in enumerate(forms):
        text = F.when(F.col("p_partkey") % 6 == k, F.replace(F.replace(F.lit(f), F.lit("{a}"), a), F.lit("{b}"), b)).otherwise(text)
    return family_edges(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.alias("t")), "id", "t")


@query("WITH n AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name) AS distance FROM n a JOIN n b ON a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) <= 3")
def fuzzy_title(spark: SparkSession, sf: str) -> DataFrame:
    """Different titles within three edits, however they begin."""
    return search.within_edits(table(spark, sf, "part"), "p_name", 3)


@query("SELECT a AS src, b AS dst, layer FROM (SELECT DISTINCT dst_file_path a, src_file_path b, layer FROM document_parallels WHERE src_file_path <> dst_file_path) x WHERE NOT EXISTS (SELECT 1 FROM document_parallels p WHERE p.src_file_path = a AND p.dst_file_path = b AND p.layer = x.layer)")
def missing_reciprocals(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "document_parallels").select(F.col("src_file_path").alias("src"), F.col("dst_file_path").alias("dst"), "layer").where("src <> dst")
    return p.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "layer").distinct().join(p, ["src", "dst", "layer"], "left_anti")


@query(f"""WITH g AS (SELECT * FROM ({SINGLE}) WHERE term <> '' AND NOT contains(term, ' ')), w AS (SELECT DISTINCT id AS chunk_id, unnest({WORDS}) term FROM chunks WHERE length(text) > 100)
SELECT chunk_id, count(DISTINCT g.id) AS entities FROM w JOIN g ON g.term = w.term GROUP BY 1 ORDER BY entities DESC, chunk_id LIMIT 100""")
def rich_passages(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "chunks").where(F.length("text") > 100).select(F.col("id").alias("chunk_id"), F.explode(F.array_distinct(F.split(T.normalised(F.col("text")), " "))).alias("term"))
    g = extract.gazetteer(table(spark, sf, "entities"), table(spark, sf, "entity_aliases")).where("n = 1")
    return words.join(F.broadcast(g), "term").groupBy("chunk_id").agg(F.countDistinct("entity_id").alias("entities")).orderBy(F.desc("entities"), "chunk_id").limit(100)


@query("SELECT event_id, count(*) OVER w AS n, round(epoch_us(ts) / 1e6 - epoch_us(first_value(ts) OVER w) / 1e6, 3) AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def rolling_throughput(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-99, 0)
    sec = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return table(spark, sf, "events").select("event_id", F.count("*").over(w).alias("n"), F.round(sec(F.col("ts")) - sec(F.first("ts").over(w)), 3).alias("seconds"))


WHOLE_RANGES = r"""SELECT DISTINCT id, book, chapter, lo, coalesce(hi, lo) hi FROM (SELECT id, trim(regexp_extract(reference, '^(.*[^0-9 ,:])[ ]+[0-9]+[:,]', 1)) book, TRY_CAST(regexp_extract(reference, ' ([0-9]+)[:,]', 1) AS INT) chapter, TRY_CAST(regexp_extract(reference, '[:,] ?([0-9]+)', 1) AS INT) lo, TRY_CAST(nullif(regexp_extract(reference, '[-–]([0-9]+)$', 1), '') AS INT) hi FROM chunks WHERE reference IS NOT NULL)"""


@query(f"WITH r AS ({WHOLE_RANGES}) SELECT a.id AS id, count(DISTINCT b.id) FILTER (b.id <> a.id) AS links FROM r a JOIN r b ON a.book = b.book AND a.chapter = b.chapter AND a.lo <= b.hi AND b.lo <= a.hi WHERE a.lo <= a.hi AND b.lo <= b.hi GROUP BY 1")
def overlapping_references(spark: SparkSession, sf: str) -> DataFrame:
    """How many others each chunk's verse range overlaps, in every way of writing them; ranges that many share aren't paired out."""
    return extract.overlap_counts(extract.verse_ranges(table(spark, sf, "chunks"), "id", "reference"), "id")


@query(f"SELECT c.concept_id AS concept_id, c.term_es AS term_es, e.id AS entity_id, count(m.file_path) AS mentions FROM concept_bridge c LEFT JOIN entities e ON {PLAIN.format('c.term_en')} = {PLAIN.format('e.name')} LEFT JOIN entity_document_mentions m ON m.entity_id = e.id GROUP BY 1, 2, 3")
def bilingual_bridge(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "concept_bridge").withColumn("k", T.normalised(F.col("term_en")))
    e = table(spark, sf, "entities").select(F.col("id").alias("entity_id"), T.normalised(F.col("name")).alias("k"))
    m = table(spark, sf, "entity_document_mentions").groupBy("entity_id").agg(F.count("file_path").alias("mentions"))
    return c.join(e, "k", "left").join(m, "entity_id", "left").select("concept_id", "term_es", "entity_id", F.coalesce("mentions", F.lit(0)).alias("mentions"))


@query("SELECT coalesce(nullif(lower(substring(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.lang') END, 1, 2)), ''), regexp_extract(file_path, '^([a-z]{2})/', 1), '') AS lang, count(*) AS chunks FROM chunks GROUP BY 1")
def metadata_language(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.coalesce(F.nullif(F.lower(F.substring(F.get_json_object("metadata", "$.lang"), 1, 2)), F.lit("")), F.regexp_extract("file_path", "^([a-z]{2})/", 1))
    return table(spark, sf, "chunks").groupBy(lang.alias("lang")).agg(F.count("*").alias("chunks"))


@query("SELECT file_path, id, place FROM (SELECT file_path, id, row_number() OVER (PARTITION BY file_path ORDER BY length(text) DESC NULLS LAST, id) AS place FROM chunks) WHERE place <= 3")
def longest_per_file(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("file_path").orderBy(F.desc_nulls_last(F.col("n")), "id")
    return table(spark, sf, "chunks").select("file_path", "id", F.length("text").alias("n")).withColumn("place", F.row_number().over(w)).where("place <= 3").select("file_path", "id", "place")


@query("SELECT entity_id, resolved_name, CAST(total // n AS BIGINT) AS mention_count FROM (SELECT DISTINCT entity_id, resolved_name FROM entity_document_mentions WHERE resolved_name <> '') s JOIN (SELECT entity_id, count(*) total, count(DISTINCT nullif(resolved_name, '')) n FROM entity_document_mentions GROUP BY 1) t USING (entity_id)")
def profile_split(spark: SparkSession, sf: str) -> DataFrame:
    """A profile's mentions divided evenly, in whole numbers, over the senses of its name."""
    m = table(spark, sf, "entity_document_mentions")
    t = m.groupBy("entity_id").agg(F.count("*").alias("total"), F.countDistinct(F.nullif("resolved_name", F.lit(""))).alias("n"))
    s = m.where("resolved_name <> ''").select("entity_id", "resolved_name").distinct()
    return s.join(t, "entity_id").select("entity_id", "resolved_name", F.floor(F.col("total") / F.col("n")).alias("mention_count"))


from lorekiln.plans import corpus_queries, extract_queries, graph_queries, retrieval_queries, text_queries  # noqa: E402, F401 - they register themselves
