"""Queries of text and name derivations, with their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekiln.functions import names as N
from lorekiln.functions import text as T
from lorekiln.operators import chunking, maintenance
from lorekiln.plans.catalogue import PLAIN, query
from lorekiln.session import table

#: Part names written badly by a fixed rule, beside the clean ones: id, name, entity_type.
WRITINGS = [("clean", "{n}"), ("bullet_prefix", "• {n}"), ("arrow_prefix", "→ {n}"), ("possessive", "{n}'s"), ("leading_quote", '"{n}'), ("duplicated_word", "{w} {w}"), ("pronunciation_tail", "{w} ga'-{w}"), ("trailing_punct", "{n};")]
DIRTY = "dirty AS (SELECT p_partkey id, CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN " + " || ".join(f"'{x.replace(chr(39), chr(39) * 2)}'" if x not in ("N", "W") else {"N": "p_name", "W": "split_part(p_name, ' ', 1)"}[x] for x in w.replace("{n}", "\0N\0").replace("{w}", "\0W\0").split("\0") if x) for i, (_, w) in enumerate(WRITINGS)) + " END name, 'part' entity_type FROM part)"


def dirty_names(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    word, name = F.element_at(F.split("p_name", " "), 1), F.col("p_name")
    out = F.lit(None).cast("string")
    for i, (_, w) in enumerate(WRITINGS):
        out = F.when(F.col("p_partkey") % 8 == i, F.replace(F.replace(F.lit(w), F.lit("{n}"), name), F.lit("{w}"), word)).otherwise(out)
    return p.select(F.col("p_partkey").alias("id"), out.alias("name"), F.lit("part").alias("entity_type"))


STRIPPED = """CASE id % 8 WHEN 1 THEN name[3:] WHEN 2 THEN name[3:] WHEN 3 THEN name[:-3] WHEN 4 THEN name[2:] WHEN 5 THEN split_part(name, ' ', 1) WHEN 6 THEN split_part(name, ' ', 1) WHEN 7 THEN name[:-2] END"""


@query(f"WITH {DIRTY} SELECT id, {STRIPPED} AS candidate, CASE id % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _) in enumerate(WRITINGS) if i) + " END AS pattern FROM dirty WHERE id % 8 > 0")
def variant_strip(spark: SparkSession, sf: str) -> DataFrame:
    """The clean name within each bad writing; SQL knows them by the rule that made them."""
    v = dirty_names(spark, sf).withColumn("v", N.stripped_variant(F.col("name"))).where("v is not null")
    return v.select("id", "v.candidate", "v.pattern")


@query(f"""WITH {DIRTY}, d AS (SELECT id, lower({STRIPPED}) c, CASE id % 8 {" ".join(f"WHEN {i} THEN '{k}'" for i, (k, _) in enumerate(WRITINGS) if i)} END pattern FROM dirty WHERE id % 8 > 0), k AS (SELECT lower(trim(name)) c, count(*) n, min(id) winner FROM dirty GROUP BY 1)
SELECT pattern, CASE WHEN length(d.c) < 3 THEN 'too_short' WHEN n IS NULL THEN 'no_canonical' WHEN n > 1 THEN 'ambiguous' ELSE 'merge' END AS verdict, count(*) AS names FROM d LEFT JOIN k ON k.c = d.c GROUP BY 1, 2""")
def variant_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of bad writings: merged into the one clean name, or not."""
    return maintenance.variant_merges(dirty_names(spark, sf), N.stripped_variant).groupBy("pattern", "verdict").agg(F.count("*").alias("names"))


@query(f"""WITH {DIRTY} SELECT category, reason, count(*) AS names FROM (SELECT unnest([CASE id % 8 WHEN 0 THEN {{c: 1, r: 'clean'}} WHEN 1 THEN {{c: 5, r: 'starts_nonword'}} WHEN 2 THEN {{c: 5, r: 'starts_nonword'}} WHEN 3 THEN {{c: 2, r: 'possessive'}} WHEN 4 THEN {{c: 5, r: 'unbalanced_quotes'}} WHEN 5 THEN {{c: 2, r: 'duplicated_word'}} WHEN 6 THEN {{c: 1, r: 'clean'}} ELSE {{c: 2, r: 'trailing_punct'}} END]) x FROM dirty) t, LATERAL (SELECT x.c AS category, x.r AS reason) GROUP BY 1, 2""")
def noise_category(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of noise in the badly written names."""
    n = dirty_names(spark, sf).select(N.noise_category(F.col("name")).alias("n"))
    return n.groupBy("n.category", "n.reason").agg(F.count("*").alias("names"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'cu[aá]nt[ao]s|how many|tod[ao]s l[ao]s|all the|every|enumera') THEN true ELSE false END AS loosely, regexp_matches(text, '[?]') AS asks FROM documents WHERE text IS NOT NULL""")
def question_signs(spark: SparkSession, sf: str) -> DataFrame:
    """Loose signs of a question for all of a kind, beside a question mark; ``wants_all`` itself is tested on its own."""
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.lower("text").rlike("cu[aá]nt[ao]s|how many|tod[ao]s l[ao]s|all the|every|enumera").alias("loosely"), F.col("text").contains("?").alias("asks"))


KINDS = [("soteriological", ["redemption|redenci", "repentance|arrepentimiento", "ordinance|ordenanza"]), ("doctrinal", ["teach|enseña", "principle|principio", "law|ley"]), ("historical", ["year|años?", "century|siglo", "chronicle|crónica"]), ("teaching", ["lesson|lección", "example|ejemplo", "children|hijos"])]


@query("SELECT kind, count(*) AS docs FROM (SELECT CASE WHEN greatest(" + ", ".join(f"k{i}" for i in range(4)) + ") = 0 THEN 'exploratory' " + " ".join(f"WHEN k{i} = greatest(k0, k1, k2, k3) THEN '{n}'" for i, (n, _) in enumerate(KINDS)) + " END AS kind FROM (SELECT " + ", ".join("(" + " + ".join(f"regexp_matches(lower(text), '{p}')::INT" for p in ps) + f") k{i}" for i, (_, ps) in enumerate(KINDS)) + " FROM documents WHERE text IS NOT NULL)) GROUP BY 1")
def question_kind(spark: SparkSession, sf: str) -> DataFrame:
    """The kind of which most patterns occur in a text, however often; the first of equal ones."""
    d = table(spark, sf, "documents").where("text is not null")
    return d.groupBy(N.best_kind(F.lower("text"), KINDS, "exploratory").alias("kind")).agg(F.count("*").alias("docs"))


HARD, EASY = ["compare|compara", "explain|explica", "meaning|significado"], ["who |quién ", "when |cuándo ", "how many|cuánt"]


@query("SELECT tier, count(*) AS docs FROM (SELECT CASE WHEN h >= 2 OR (h = 1 AND e = 0) THEN 'quality' WHEN e >= 2 OR (e >= 1 AND h = 0) THEN 'fast' ELSE 'balanced' END AS tier FROM (SELECT " + " + ".join(f"regexp_matches(q, '{p}')::INT" for p in HARD) + r" + (w >= 30)::INT + (length(text) - length(replace(text, '?', '')) >= 2)::INT h, " + " + ".join(f"regexp_matches(q, '{p}')::INT" for p in EASY) + r""" + (w <= 12)::INT e FROM (SELECT text, regexp_replace(lower(text), '^[ \t\n\f\r\v]+|[ \t\n\f\r\v]+$', '', 'g') q, len(list_filter(string_split_regex(text, '[ \t\n\f\r\v]+'), lambda x: x <> '')) w FROM documents WHERE text IS NOT NULL))) GROUP BY 1""")
def complexity_tier(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    return d.groupBy(N.complexity(F.col("text"), HARD, EASY).alias("tier")).agg(F.count("*").alias("docs"))


@query(r"""SELECT id, trim(regexp_extract(reference, '^(.*[^0-9 ,:])[ ]+[0-9]+[:,]', 1)) || ' ' || c || ':' || lo || CASE WHEN hi IS NOT NULL AND hi <> lo THEN '-' || hi ELSE '' END AS citation FROM (SELECT id, reference, TRY_CAST(regexp_extract(reference, ' ([0-9]+)[:,]', 1) AS INT) c, TRY_CAST(regexp_extract(reference, '[:,] ?([0-9]+)', 1) AS INT) lo, TRY_CAST(nullif(regexp_extract(reference, '[-–]([0-9]+)$', 1), '') AS INT) hi FROM chunks WHERE reference IS NOT NULL) WHERE c IS NOT NULL AND lo IS NOT NULL""")
def reference_format(spark: SparkSession, sf: str) -> DataFrame:
    """References in one way of writing, whatever way they came."""
    from lorekiln.operators.extract import verse_ranges

    r = table(spark, sf, "chunks").select("id", "reference")
    v = verse_ranges(r, "id", "reference")
    return v.select("id", N.citation(F.col("book"), F.col("chapter"), F.col("lo"), F.col("hi")).alias("citation"))


@query(f"SELECT doc_id, replace({PLAIN.format('title')}, ' ', '-') AS slug, trim('Letters ' || ['January','February','March','April','May','June','July','August','September','October','November','December'][month(published_at)] || ' ' || year(published_at)) AS event FROM documents WHERE title IS NOT NULL AND published_at IS NOT NULL")
def title_slug(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("title is not null and published_at is not null")
    return d.select("doc_id", N.slug(F.col("title")).alias("slug"), N.event_name(F.lit("Letters"), F.date_format("published_at", "yyyy-MM")).alias("event"))


@query(f"SELECT k AS author, count(*) AS docs, count(DISTINCT author) AS writings FROM (SELECT author, {PLAIN.format('''regexp_replace(author, '^(?i)((by|por) +)?((elder|élder|president|presidente|presidenta|sister|hermana|brother|hermano|bishop|obispo|dr|prof)[.]? +)+', '')''')} k FROM documents WHERE author IS NOT NULL AND NOT contains(author, ',') AND NOT regexp_matches(author, '[0-9]')) GROUP BY 1")
def author_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Authors by the key under which their writings meet."""
    d = table(spark, sf, "documents").where("author is not null and author not like '%,%' and not author rlike '[0-9]'")
    return d.groupBy(N.author_key(F.col("author")).alias("author")).agg(F.count("*").alias("docs"), F.countDistinct("author").alias("writings"))


@query("SELECT id, CASE WHEN a >= 100 THEN 'Canon' WHEN a >= 90 THEN 'Quasi-canonical' WHEN a >= 78 THEN 'Prophetic' WHEN a >= 65 THEN 'Normative' WHEN a >= 57 THEN 'Correlated' WHEN a >= 45 THEN 'GA Official' WHEN a >= 35 THEN 'GA Unofficial' WHEN a >= 25 THEN 'Institutional' WHEN a >= 15 THEN 'Scholarly' WHEN a >= 10 THEN 'Historical' ELSE 'Reference' END AS label, round(a * CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.5 ELSE 1.0 END * CASE id % 3 WHEN 0 THEN 1.15 ELSE 1.0 END, 6) AS effective FROM (SELECT id, id % 111 a FROM chunks)")
def authority_effective(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and effective authority over all grades, settings and kinds of consensus."""
    c = table(spark, sf, "chunks").select("id", (F.col("id") % 111).alias("a"))
    context = F.when(F.col("id") % 4 == 0, "canon").when(F.col("id") % 4 == 1, "devotional").when(F.col("id") % 4 == 2, "interview").otherwise("unknown")
    return c.select("id", N.authority_label(F.col("a")).alias("label"), F.round(N.effective_authority(F.col("a"), context, F.when(F.col("id") % 3 == 0, "fp-q12").otherwise("individual")), 6).alias("effective"))


@query(r"""SELECT m.entity_id AS entity_id, c.id AS chunk_id, lower(substring(c.text, CAST(greatest(1, p - 200) AS INT), CAST(p + length(e.name) + 200 - greatest(1, p - 200) AS INT))) AS around FROM (SELECT DISTINCT entity_id, file_path FROM entity_document_mentions) m JOIN entities e ON e.id = m.entity_id JOIN (SELECT *, 1 one FROM chunks WHERE text IS NOT NULL) c ON c.file_path = m.file_path, LATERAL (SELECT strpos(lower(c.text), lower(e.name)) p) WHERE p > 0 AND NOT regexp_matches(c.text, '[<{&\x{A0}\x{200B}\x{FEFF}]|\[')""")
def mention_window(spark: SparkSession, sf: str) -> DataFrame:
    """The text around an entity's first mention in each chunk of its files; chunks with markup are left to the tests."""
    m = table(spark, sf, "entity_document_mentions").select("entity_id", "file_path").distinct()
    e = table(spark, sf, "entities").select(F.col("id").alias("entity_id"), "name")
    c = table(spark, sf, "chunks").where(r"text is not null and not text rlike '[<{&\\x{A0}\\x{200B}\\x{FEFF}]|\\['").select(F.col("id").alias("chunk_id"), "file_path", "text")
    hit = m.join(e, "entity_id").join(c, "file_path").where(F.instr(F.lower("text"), F.lower("name")) > 0)
    return hit.select("entity_id", "chunk_id", N.window_around(F.col("text"), F.col("name")).alias("around"))


@query(r"""SELECT doc_id, round(length(text) / 1e6 * 3.0 + length(text) / 4 / 1e6 * 15.0, 9) AS cost FROM documents WHERE text IS NOT NULL""")
def model_cost(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.round(N.cost(F.length("text"), F.length("text") / 4, 3.0, 15.0), 9).alias("cost"))


URL_RULES = [("EXCLUDE", "personal", ["/notes/"]), ("EXCLUDE", "exact", ["=index"]), ("PROFILE", "person", ["/letters/", "/cartas/"]), ("ANALYSIS", "study", ["study-aids", "commentary", "comentarios"])]


@query("SELECT category, reason, count(*) AS files FROM (SELECT CASE WHEN contains(u, '/notes/') THEN 'EXCLUDE' WHEN contains(u, '/letters/') OR contains(u, '/cartas/') THEN 'PROFILE' WHEN contains(u, 'study-aids') OR contains(u, 'commentary') OR contains(u, 'comentarios') THEN 'ANALYSIS' ELSE 'UNCLASSIFIED' END category, CASE WHEN contains(u, '/notes/') THEN 'personal' WHEN contains(u, '/letters/') OR contains(u, '/cartas/') THEN 'person' WHEN contains(u, 'study-aids') OR contains(u, 'commentary') OR contains(u, 'comentarios') THEN 'study' ELSE 'needs-review' END reason FROM (SELECT 'https://library.example/' || file_path u FROM document_registry)) GROUP BY 1, 2")
def url_triage(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "document_registry").select(N.url_verdict(F.concat(F.lit("https://library.example/"), "file_path"), URL_RULES).alias("v"))
    return u.groupBy("v.category", "v.reason").agg(F.count("*").alias("files"))


@query(r"""SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) AS INT) - 1 AS chapter, heading FROM (SELECT id, unnest(string_split(text, chr(10))) heading, generate_subscripts(string_split(text, chr(10)), 1) i FROM chunks) WHERE regexp_matches(heading, '^(#{1,6} |CHAPTER |CAP[IÍ]TULO |[0-9]+[.][0-9]+ )')""")
def heading_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Headings of chunks, numbered."""
    lines = table(spark, sf, "chunks").select("id", F.posexplode(F.split("text", "\n")).alias("i", "heading")).where(r"heading rlike '^(#{1,6} |CHAPTER |CAP[IÍ]TULO |[0-9]+[.][0-9]+ )'")
    return lines.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("i")) - 1).alias("chapter"), "heading")


@query("SELECT source, count(*) AS docs, count(*) FILTER (contains(text, '<') OR contains(text, '&nbsp;')) AS leaks, median(length(text)) AS median_size FROM (SELECT coalesce(lower(trim(source)), '-') source, text FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def fetch_validation(spark: SparkSession, sf: str) -> DataFrame:
    """After a fetch: leaked markup and the median size by source."""
    d = table(spark, sf, "documents").where("text is not null")
    return d.groupBy(F.coalesce(F.lower(F.trim("source")), F.lit("-")).alias("source")).agg(F.count("*").alias("docs"), F.count_if(F.col("text").contains("<") | F.col("text").contains("&nbsp;")).alias("leaks"), F.median(F.length("text")).alias("median_size"))


@query(r"""WITH v AS (SELECT id, pos, regexp_replace(line, '[ \t\f\v\r]+$', '') line FROM (SELECT id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS pos FROM chunks WHERE text IS NOT NULL)),
n AS (SELECT id, count(*) n FROM v WHERE regexp_matches(line, '^[0-9]{1,3}[ \t\f\v]+[^ \t\n\r\f\v]') GROUP BY 1) SELECT id, CAST(n AS BIGINT) AS verses, true AS whole FROM n""")
def verse_groups(spark: SparkSession, sf: str) -> DataFrame:
    """For each chunk with verses how many its groups hold, and whether these follow each other without a gap."""
    c = table(spark, sf, "chunks").where(r"text is not null and text rlike '(?m)^[0-9]{1,3}\\s+\\S'").select("id", "text")
    n = chunking.verses(c, "id", "text").groupBy("id").agg(F.count("*").alias("verses"))
    g = chunking.verse_chunks(c, "id", "text", 20, 40).where("first_verse is not null").groupBy("id").agg(F.max("chunk_index").alias("hi"), F.count("*").alias("groups"), F.max("n_words").alias("most"))
    return n.join(g, "id").select("id", "verses", (F.col("hi") + 1 == F.col("groups")).alias("whole"))
