"""Preparation and inspection of corpora: chapters, batches, inventories, reports, checks between backlogs and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekiln.functions import names as N
from lorekiln.functions import text as T
from lorekiln.functions.arrays import before


def chapters(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, chapter_no, number, title, body): texts divided at lines that ``pattern`` fits; its first group is the chapter's number (figures,
    words or Roman), the second its title. What stands before the first heading is chapter 0, unless it is blank."""
    mark = F.regexp_replace(text, rf"(?m)(?={pattern})", "\x01")
    d = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(mark, "\x01")).alias("_i", "_p")).where(F.col("_p").rlike(r"\S"))
    head = F.regexp_extract("_p", rf"(?m)\A(?:{pattern})", 0)
    d = d.select(key, "_i", N.numeral(F.regexp_extract("_p", rf"(?m)\A(?:{pattern})", 1)).alias("number"), N.trimmed(F.regexp_extract("_p", rf"(?m)\A(?:{pattern})", 2)).alias("title"), N.trimmed(F.substring(F.col("_p"), F.length(head) + 1, F.length("_p"))).alias("body"), (head != "").alias("headed"))
    return d.select(key, F.sum(F.col("headed").cast("int")).over(Window.partitionBy(key).orderBy("_i")).cast("int").alias("chapter_no"), F.when(F.col("headed"), F.col("number")).alias("number"), F.nullif("title", F.lit("")).alias("title"), "body")


def batches(files: DataFrame, size: int) -> DataFrame:
    """(folder, files, batch): folders in order, put together until a batch has ``size`` files or more. A fold over the folders' counts,
    one number each; the folders themselves aren't gathered with their files."""
    n = files.groupBy(F.regexp_extract("file_path", "^(.*)/", 1).alias("folder")).agg(F.count("*").cast("int").alias("files"))
    one = n.agg(F.sort_array(F.collect_list(F.struct("folder", "files"))).alias("f"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("batch"), F.array().cast("array<int>").alias("out"))
    step = lambda a, x: F.struct(F.when(a["n"] + x["files"] >= size, 0).otherwise(a["n"] + x["files"]).cast("int").alias("n"), F.when(a["n"] + x["files"] >= size, a["batch"] + 1).otherwise(a["batch"]).cast("int").alias("batch"), F.concat(a["out"], F.array(a["batch"])).alias("out"))
    return one.select(F.explode(F.zip_with("f", F.aggregate("f", start, step, lambda a: a["out"]), lambda x, b: F.struct(x["folder"].alias("folder"), x["files"].alias("files"), b.alias("batch")))).alias("x")).select("x.*")


def fill_rates(df: DataFrame, group: Column, columns: list[str]) -> DataFrame:
    """(group, rows, a share for each column): how much of each column is filled, by group."""
    return df.groupBy(group.alias("group")).agg(F.count("*").alias("rows"), *[F.round(F.count(c) / F.count("*"), 6).alias(c) for c in columns])


def reciprocity(links: DataFrame) -> DataFrame:
    """One row: distinct links, those whose reverse is there, and the share of these."""
    one = links.select("src", "dst").where("src <> dst").distinct()
    back = one.join(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back")), ["src", "dst"], "left")
    return back.agg(F.count("*").alias("links"), F.count("back").alias("mutual"), F.round(F.count("back") / F.count("*"), 6).alias("share"))


def confusion(df: DataFrame, manual: Column, automatic: Column, classes: list[str]) -> DataFrame:
    """(manual, a count for each automatic class, precision): judged by hand against judged by rule; precision is the share of what the rule
    calls so that is so, null where it calls nothing so."""
    d = df.select(manual.alias("manual"), automatic.alias("automatic"))
    table = d.groupBy("manual").agg(*[F.count_if(F.col("automatic") == c).alias(c) for c in classes])
    called = d.groupBy(F.col("automatic").alias("manual")).agg(F.count("*").alias("called"))
    own = reduce(lambda a, c: F.when(F.col("manual") == c, F.col(c)).otherwise(a), classes, F.lit(None).cast("long"))
    return table.join(called, "manual", "left").select("manual", *classes, F.round(own / F.col("called"), 6).alias("precision"))


def baseline(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, n): counts of entities and edges, of their types, of edges by confidence, and out-degrees (least, greatest, average times a
    thousand in whole numbers)."""
    d = edges.groupBy("src").agg(F.count("*").alias("d"))
    one = lambda df, name, n: df.agg(n.alias("n")).select(F.lit(name).alias("what"), F.col("n").cast("long").alias("n"))
    rows = [one(entities, "entities", F.count("*")), one(edges, "relations", F.count("*")), one(entities, "entity_types", F.countDistinct("entity_type")), one(edges, "relation_types", F.countDistinct("rel_type"))]
    rows += [one(d, "degree_min", F.min("d")), one(d, "degree_max", F.max("d")), one(d, "degree_avg_x1000", F.floor(F.avg("d") * 1000))]
    rows.append(edges.groupBy(F.concat(F.lit("confidence:"), F.coalesce("confidence", F.lit("-"))).alias("what")).agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, rows)


def profile_cards(entities: DataFrame, aliases: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, card): each entity as JSON with its aliases in order, its number of files and of edges at either end."""
    a = aliases.where("alias is not null").groupBy(F.col("entity_id").alias("id")).agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    m = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.countDistinct("file_path").alias("files"))
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.where("src <> dst").select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("relations"))
    e = entities.join(a, "id", "left").join(m, "id", "left").join(ends, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    card = F.to_json(F.struct("name", F.col("entity_type").alias("type"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), zero("files"), zero("relations")))
    return e.select("id", "name", card.alias("card"))


# backlogs ------------------------------------------------------------------------------------------------------------
def invalid_rows(backlog: DataFrame, required: list[str], statuses: list[str]) -> DataFrame:
    """(slug, problem): rows of a backlog that lack a required field, have an unknown status, or share a slug with others."""
    missing = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(f"missing:{c}")) for c in required]
    bad = backlog.select("slug", F.explode(F.array_compact(F.array(*missing, F.when(~F.col("status").isin(statuses), F.lit("status"))))).alias("problem"))
    twice = backlog.where("slug is not null").groupBy("slug").agg(F.count("*").alias("n")).where("n > 1").select("slug", F.lit("duplicate").alias("problem"))
    return bad.unionByName(twice)


def filtered(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows by optional conditions: None asks for nothing, True and False for filled and empty columns, a list for any of its values, anything
    else for equality."""
    for c, v in wanted.items():
        if v is None:
            continue
        df = df.where(F.col(c).isNotNull() if v is True else F.col(c).isNull() if v is False else F.col(c).isin(v) if isinstance(v, (list, tuple)) else F.col(c) == v)
    return df


def reconcile(backlogs: dict[str, DataFrame], files: DataFrame, registry: DataFrame) -> DataFrame:
    """(slug, check, finding, status): five checks of backlogs (discovery, research, downloads, indexing; each slug, status, file_path, sha256)
    against files (file_path, sha256) and the registry (file_path, status).

    promoted: found further on but not marked so (update); downloaded: the file is there (update); drift: its digest differs, the entry is
    stale (update); orphan: the entry's file is nowhere; indexed: the registry has it (update), or it says indexed and the registry
    doesn't (info).
    """
    sets = {k: b.select("slug", "status", "file_path", "sha256").dropDuplicates(["slug"]) for k, b in backlogs.items()}
    f = files.select("file_path", F.col("sha256").alias("now")).dropDuplicates(["file_path"])
    r = registry.select("file_path", F.lit(True).alias("known")).where("status = 'indexed'").dropDuplicates(["file_path"])
    row = lambda df, check, finding, status: df.select("slug", F.lit(check).alias("check"), F.lit(finding).alias("finding"), F.lit(status).alias("status"))
    d = sets["downloads"].join(f, "file_path", "left")
    i = sets["indexing"].join(r, "file_path", "left")
    further = sets["research"].select("slug").union(sets["downloads"].select("slug")).distinct()
    return reduce(DataFrame.unionByName, [
        row(sets["discovery"].where("status <> 'promoted'").join(further, "slug", "left_semi"), "promoted", "update", "promoted"),
        row(d.where("status <> 'downloaded' and now is not null"), "downloaded", "update", "downloaded"),
        row(d.where("status = 'downloaded' and now is not null and sha256 is not null and sha256 <> now"), "drift", "update", "stale"),
        row(d.where("status = 'downloaded' and now is null"), "orphan", "orphan", "missing"),
        row(i.where("status <> 'indexed' and known"), "indexed", "update", "indexed"), row(i.where("status = 'indexed' and known is null"), "indexed", "info", "pending"),
    ])


def applied(backlog: DataFrame, findings: DataFrame, checks: list[str]) -> DataFrame:
    """A backlog with the updates among findings of ``checks``; orphans and infos change nothing."""
    u = findings.where((F.col("finding") == "update") & F.col("check").isin(checks)).groupBy("slug").agg(F.max("status").alias("new"))
    return backlog.join(u, "slug", "left").select(*[F.coalesce("new", "status").alias("status") if c == "status" else F.col(c) for c in backlog.columns])


def parity(left: DataFrame, right: DataFrame, top: int = 5, jaccard: float = 0.3) -> DataFrame:
    """(query, overlap, jaccard, agrees): how far two ranked results (query, item, rank) agree: shared items among the ``top`` first, likeness
    of the whole sets, and whether it reaches ``jaccard``. A query that one side lacks has none."""
    sets = lambda df, n: df.groupBy("query").agg(F.collect_set("item").alias(n), F.collect_set(F.when(F.col("rank") <= top, F.col("item"))).alias(n + "_top"))
    b = sets(left, "a").join(sets(right, "b"), "query", "full")
    empty = F.array().cast(left.select(F.array("item")).schema[0].dataType)
    a, c = F.coalesce("a", empty), F.coalesce("b", empty)
    j = F.round(F.size(F.array_intersect(a, c)) / F.greatest(F.lit(1), F.size(F.array_union(a, c))), 6)
    return b.select("query", F.size(F.array_intersect(F.coalesce("a_top", empty), F.coalesce("b_top", empty))).alias("overlap"), j.alias("jaccard"), (j >= jaccard).alias("agrees"))


def inventory(books: DataFrame, known: DataFrame, k: int = 3) -> DataFrame:
    """(title, author, verdict, match): books against those at hand, by slug of title and author (duplicate), by the title within ``k`` edits
    and the same author (likely), else new. Both have title, author, language; only one language is compared."""
    from lorekiln.operators.search import within_edits

    key = lambda df: df.select("title", F.coalesce("language", F.lit("")).alias("l"), N.slug(F.col("title")).alias("t"), F.coalesce(N.author_key(F.col("author")), F.lit("")).alias("a"))
    b = key(books).select("title", "l", "t", "a", F.struct("title", "l", "a").alias("k"))
    h = key(known).select(F.col("title").alias("match"), "l", "t", "a")
    same = b.join(h, ["l", "t", "a"]).groupBy("k").agg(F.min("match").alias("same"))
    pairs = within_edits(b.select("t").union(h.select("t")), "t", k)
    near = pairs.select(F.col("a").alias("t"), F.col("b").alias("t2")).union(pairs.select("b", "a"))
    likely = b.select("k", "l", "t", "a").join(near, "t").drop("t").withColumnRenamed("t2", "t").join(h, ["l", "t", "a"]).groupBy("k").agg(F.min("match").alias("near"))
    authors = books.select("title", "author", F.struct("title", F.coalesce("language", F.lit("")).alias("l"), F.coalesce(N.author_key(F.col("author")), F.lit("")).alias("a")).alias("k"))
    out = authors.join(same, "k", "left").join(likely, "k", "left")
    return out.select("title", "author", F.when(F.col("same").isNotNull(), "duplicate").when(F.col("near").isNotNull(), "likely").otherwise("new").alias("verdict"), F.coalesce("same", "near").alias("match"))


def built_gazetteer(sources: list[DataFrame]) -> DataFrame:
    """(term, name, entity_type, languages, sources): names (name, entity_type, language, source) of several lists put together by type and
    normalised name; the writing of the first source stands."""
    every = reduce(DataFrame.unionByName, [s.select("name", "entity_type", "language", "source", F.lit(i).alias("i")) for i, s in enumerate(sources)])
    e = every.withColumn("term", T.entity_name(F.col("name"))).where("term <> ''")
    return e.groupBy("term", "entity_type").agg(F.min_by("name", F.struct("i", "name")).alias("name"), F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def translated_titles(titles: DataFrame, known: dict[str, str], rules: list[tuple[str, str]]) -> DataFrame:
    """(title, translation, how): by an explicit list (exact), else by the first rule (pattern, replacement) that fits (rule), else null (none)."""
    t = F.col("title")
    exact = N.first_rule([(t == k, v) for k, v in known.items()], None)
    out = F.lit(None).cast("string")
    for p, r in reversed(rules):
        out = F.when(t.rlike(p), F.regexp_replace(t, p, r)).otherwise(out)
    return titles.select("title").distinct().select("title", F.coalesce(exact, out).alias("translation"), F.when(exact.isNotNull(), "exact").when(out.isNotNull(), "rule").otherwise("none").alias("how"))


#: Relations that a model's answer may state.
RELATIONS = "FATHER_OF MOTHER_OF SPOUSE_OF BROTHER_OF SISTER_OF TEACHES LIVED_IN RULED TRAVELED_TO LOCATED_IN PART_OF MEMBER_OF ASSOCIATED_WITH".split()
RELATION = "struct<from_name:string,from_type:string,rel_type:string,to_name:string,to_type:string,confidence:string,source_ref:string>"


def salvaged(responses: DataFrame, key: str, text: str, relations: list[str] = RELATIONS) -> DataFrame:
    """(key, src, src_type, rel_type, dst, dst_type, confidence): relations in a model's answers, which ought to be JSON with ``relations``: the
    whole answer, what stands in a code fence, what stands between the outer braces, or each complete object of a broken one. Unknown
    relations are left out; a confidence other than llm_high is llm_low."""
    t = F.col(text)
    parse = lambda c: F.from_json(c, f"struct<relations:array<{RELATION}>>")["relations"]
    fence = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    outer = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    each = F.transform(F.regexp_extract_all(t, F.lit(r'(?s)\{[^{}]*"from_name"[^{}]*"rel_type"[^{}]*"to_name"[^{}]*\}'), F.lit(0)), lambda x: F.from_json(x, RELATION))
    found = F.coalesce(parse(t), parse(fence), parse(outer), each)
    r = responses.where(t.isNotNull()).select(key, F.explode(found).alias("r")).where(F.col("r.rel_type").isin(relations) & F.col("r.from_name").isNotNull() & F.col("r.to_name").isNotNull())
    return r.select(key, F.col("r.from_name").alias("src"), F.coalesce("r.from_type", F.lit("unknown")).alias("src_type"), "r.rel_type", F.col("r.to_name").alias("dst"), F.coalesce("r.to_type", F.lit("unknown")).alias("dst_type"), F.when(F.col("r.confidence") == "llm_high", "llm_high").otherwise("llm_low").alias("confidence"))


def capped(level: DataFrame, order: list, most: int = 5_000) -> DataFrame:
    """A level of a search cut to its first ``most`` rows in order, as hub guards do; the full search is ``within_hops``."""
    return level.orderBy(*order).limit(most)


def event_dates(events: DataFrame, text: str) -> DataFrame:
    """Adds date_sort: the year a phrase such as 'c. 600 BC', 'a. C. 90' or 'AD 33' names, negative before the era; 0 without one."""
    t = F.col(text)
    year = F.coalesce(F.regexp_extract(t, r"(\d{1,4})", 1).try_cast("int"), F.lit(0))
    return events.withColumn("date_sort", F.when(t.rlike(r"(?i)\b(?:b\.?\s?c\.?|a\.\s?(?:de\s)?c\.?)(?:\W|$)"), -year).otherwise(year))


def prefix_places(counts: Column) -> Column:
    """Where each of several lists begins when they are put one after another."""
    return before(counts)


def summarised(df: DataFrame, key: str, text: str, model=None, sentences: int = 2) -> DataFrame:
    """(key, summary): ``model`` is a hook (DataFrame of key, text -> key, summary); without one the first sentences stand for the text. Null and
    blank texts have a null summary."""
    if model is not None:
        return model(df.select(key, text))
    first = F.array_join(F.slice(T.sentences(F.col(text)), 1, sentences), " ")
    return df.select(key, F.nullif(first, F.lit("")).alias("summary"))


def stated_by_model(passages: DataFrame, key: str, text: str, budget: int, model=None) -> DataFrame:
    """Relations that a model states of passages: the ``budget`` first by key are given to ``model`` (DataFrame of key, text -> key, response), its
    answers are read by ``salvaged``. Without a model there are none."""
    some = passages.orderBy(key).limit(budget).select(key, text)
    answers = model(some) if model is not None else some.where("false").select(key, F.col(text).alias("response"))
    return salvaged(answers, key, "response")
