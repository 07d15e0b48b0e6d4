"""From text to entities and relations: dictionary matches, co-occurrence, references, chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from lorekiln.functions.arrays import let
from lorekiln.functions.text import FOLD


#: The relation that two entities of one text have by their types, in either order. Two of the same type are a rule too.
TYPE_RULES = {
    ("person", "place"): "ASSOCIATED_WITH", ("person", "concept"): "TEACHES", ("person", "people"): "BELONGS_TO", ("person", "object"): "ASSOCIATED_WITH", ("concept", "scripture"): "REFERENCED_IN", ("person", "scripture"): "REFERENCED_IN",
    ("person", "person"): "CO_OCCURS_WITH", ("concept", "concept"): "RELATED_TO", ("person", "period"): "LIVED_DURING", ("place", "period"): "EXISTS_DURING", ("role", "organization"): "PRESIDES_OVER", ("role", "unit"): "PRESIDES_OVER",
    ("role", "ordinance"): "AUTHORIZED_TO_PERFORM", ("role", "council"): "MEMBER_OF", ("role", "meeting"): "CONDUCTS_INTERVIEW", ("role", "fund"): "MANAGES_FUND", ("role", "program"): "OVERSEES", ("organization", "unit"): "ORGANIZED_UNDER",
    ("ordinance", "ordinance"): "PREREQUISITE_FOR", ("ordinance", "concept"): "COVENANT_OF", ("policy", "ordinance"): "GOVERNS_POLICY", ("role", "role"): "REPORTS_TO", ("unit", "unit"): "UNIT_CONTAINS", ("organization", "organization"): "RELATED_TO",
    ("program", "organization"): "ORGANIZED_UNDER", ("document", "concept"): "RELATED_TO",
}
#: Up to so many different first words become literals of a filter; more meet the texts in a join.
FIRST_WORDS = 5_000


def gazetteer(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(term, entity_id, entity_type, n): normalised names and aliases with all their senses."""
    from lorekiln.functions.text import normalised

    names = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("label"), "entity_type")
    more = aliases.join(entities.select(F.col("id").alias("entity_id"), "entity_type"), "entity_id").select("entity_id", F.col("alias").alias("label"), "entity_type")
    g = names.unionByName(more).withColumn("term", normalised(F.col("label"))).where("term <> ''")
    return g.select("term", "entity_id", "entity_type").distinct().withColumn("n", F.size(F.split("term", " ")))


def mentions(docs: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(key, entity_id, entity_type, pos, n): dictionary terms on whole words, read from the left, the longest at a place, without
    overlaps; all senses of a term count, and an entity once a text, at its first place.

    Only places whose word opens a term are looked at, and only grams of lengths the dictionary has, however long; they meet it in an
    equi-join. A term directly before chapter and verse is a citation's book and no mention. Null texts give none.
    """
    from lorekiln.functions.text import CITATION, normalised

    g = dictionary.select("term", "n", "entity_id", "entity_type").where("term <> ''")
    lengths = sorted(r["n"] for r in g.select("n").distinct().collect())  # at most as many as the longest term has words
    firsts = g.select(F.substring_index("term", " ", 1).alias("w")).distinct()
    some = [r["w"] for r in firsts.limit(FIRST_WORDS + 1).collect()]
    cited = F.regexp_replace(F.lower(F.col(text)), CITATION, " \x01 ")  # a mark in place of chapter and verse
    words = F.split(F.trim(F.regexp_replace(F.translate(cited, *FOLD), "[^a-z0-9\x01]+", " ")), " ")
    d = docs.where(F.col(text).isNotNull()).select(key, words.alias("w"))
    sizes = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")

    def grams(w: Column, p: Column) -> Column:
        gram = lambda n: F.struct(p.cast("int").alias("pos"), n.alias("n"), F.array_join(F.slice(w, p + 1, n), " ").alias("term"), F.coalesce(F.get(w, p + n) == "\x01", F.lit(False)).alias("cited"))
        return F.filter(F.transform(sizes, gram), lambda x: (x["pos"] + x["n"] <= F.size(w)) & ~x["cited"])

    if len(some) <= FIRST_WORDS:
        # the words are bound once, else they would be made anew for each place
        opening = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(some))
        # outer, here and elsewhere: for an inner explode Spark makes the array twice, to leave out empty ones first
        found = d.select(key, F.explode_outer(let(F.col("w"), lambda w: F.flatten(F.transform(opening(w), lambda p: grams(w, p))))).alias("x")).where("x is not null")
    else:  # too many first words for a filter: the places meet them by a join
        at = d.select(key, "w", F.posexplode("w").alias("p", "first")).join(firsts.withColumnRenamed("w", "first"), "first", "left_semi")
        found = at.select(key, F.explode(grams(F.col("w"), F.col("p"))).alias("x"))
    hits = found.select(key, "x.pos", "x.n", "x.term").join(g, ["term", "n"]).select(key, "pos", "n", "entity_id", "entity_type")
    # the hits of one text, a fold from the left
    senses = hits.groupBy(key, "pos", "n").agg(F.collect_set(F.struct("entity_id", "entity_type")).alias("senses"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", (-F.col("n")).alias("k"), "senses")))
    kind = hits.schema["entity_type"].dataType.simpleString()
    ids = hits.schema["entity_id"].dataType.simpleString()
    row = f"array<struct<pos:int,n:int,senses:array<struct<entity_id:{ids},entity_type:{kind}>>>>"
    step = lambda a, x: F.when(x["pos"] >= a["end"], F.struct((x["pos"] - x["k"]).alias("end"), F.concat(a["out"], F.array(F.struct(x["pos"].alias("pos"), (-x["k"]).alias("n"), x["senses"].alias("senses")))).alias("out"))).otherwise(a)
    kept = senses.groupBy(key).agg(ordered.alias("h")).select(key, F.explode(F.aggregate("h", F.struct(F.lit(0).alias("end"), F.array().cast(row).alias("out")), step, lambda a: a["out"])).alias("x"))
    each = kept.select(key, F.col("x.pos").alias("pos"), F.col("x.n").alias("n"), F.explode("x.senses").alias("s")).select(key, "pos", "n", "s.entity_id", "s.entity_type")
    return each.groupBy(key, "entity_id", "entity_type").agg(F.min(F.struct("pos", "n")).alias("at")).select(key, "entity_id", "entity_type", F.col("at.pos").alias("pos"), F.col("at.n").alias("n"))


def cooccurrence(found: DataFrame, key: str, rules: dict[tuple[str, str], str], default: str = "CO_OCCURS_WITH", curated: DataFrame | None = None) -> DataFrame:
    """(a, b, rel_type, texts): pairs of different entities of one text with their relation and the number of texts.

    ``curated`` (src, dst, rel_type, one row a pair) goes before the rules and gives the direction; other pairs are typed by their
    types and stand smaller id first. A text's entities are listed once and paired within its row, so no join multiplies
    them; pairs are counted before they are shuffled. Types that no rule names have the default.
    """
    one = found.groupBy(key).agg(F.sort_array(F.collect_set(F.struct(F.col("entity_id").alias("e"), F.col("entity_type").alias("t")))).alias("es"))
    pairs = one.select(key, "es", F.posexplode("es").alias("i", "x")).select(key, "x", F.explode(F.slice("es", F.col("i") + 2, F.greatest(F.lit(0), F.size("es") - F.col("i") - 1))).alias("y")).where("x.e <> y.e")
    kind = F.lit(default)
    for (s, t), r in reversed(list(rules.items())):
        kind = F.when(((F.col("x.t") == s) & (F.col("y.t") == t)) | ((F.col("x.t") == t) & (F.col("y.t") == s)), F.lit(r)).otherwise(kind)
    counts = pairs.select(F.col("x.e").alias("a"), F.col("y.e").alias("b"), kind.alias("rel_type")).groupBy("a", "b", "rel_type").agg(F.count("*").alias("texts"))
    if curated is None:
        return counts
    c = curated.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.struct("src", "dst", "rel_type").alias("c")).groupBy("a", "b").agg(F.min("c").alias("c"))
    both = counts.groupBy("a", "b").agg(F.sum("texts").alias("all_texts"), F.collect_list(F.struct("rel_type", "texts")).alias("by")).join(c, ["a", "b"], "left")
    typed = both.withColumn("r", F.explode(F.when(F.col("c").isNotNull(), F.array(F.struct(F.col("c.rel_type").alias("rel_type"), F.col("all_texts").alias("texts")))).otherwise(F.col("by"))))
    return typed.select(F.coalesce("c.src", "a").alias("a"), F.coalesce("c.dst", "b").alias("b"), "r.rel_type", "r.texts")


def chain(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """Adds ``previous``: the value before in the order of each key (PRECEDED_BY)."""
    return df.withColumn("previous", F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def verse_ranges(df: DataFrame, key: str, reference: str) -> DataFrame:
    """(key, book, chapter, lo, hi) of references such as 'Book 9:1-6', 'Book 9:1–6', 'Book 9, 1-6' and 'Book 9:1', which is a
    range of one verse; what isn't a verse (pages, null) is left out, repeated rows count once."""
    r = F.col(reference)
    number = lambda p: F.regexp_extract(r, p, 1).try_cast("int")
    lo = number(r"[:,] ?([0-9]+)")
    x = df.where(r.isNotNull()).select(key, F.trim(F.regexp_extract(r, r"^(.*[^0-9 ,:])[ ]+[0-9]+[:,]", 1)).alias("book"), number(r" ([0-9]+)[:,]").alias("chapter"), lo.alias("lo"), F.coalesce(number(r"[-–]([0-9]+)$"), lo).alias("hi"))
    return x.where("chapter is not null and lo is not null").distinct()


def _overlaps(ranges: DataFrame, width: int) -> DataFrame:
    """(x, y): different ranges (book, chapter, lo, hi) that overlap, both ways, and each with itself. Distinct ranges meet in buckets of ``width``
    verses; a pair is looked at only in the bucket where the later of the two begins."""
    cells = ranges.select("book", "chapter", "lo", "hi").distinct().withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    other = cells.select("book", "chapter", "cell", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = cells.join(other, ["book", "chapter", "cell"]).where((F.col("lo") <= F.col("hi2")) & (F.col("lo2") <= F.col("hi")) & (F.col("cell") == F.floor(F.greatest("lo", "lo2") / width)))
    return pairs.select(F.struct("book", "chapter", "lo", "hi").alias("x"), F.struct("book", "chapter", F.col("lo2").alias("lo"), F.col("hi2").alias("hi")).alias("y"))


def overlapping(ranges: DataFrame, key: str, width: int = 8) -> DataFrame:
    """(a, b): keys of overlapping ranges, the smaller first. Every pair is a row, so this is for ranges that few keys share; see
    ``overlap_counts``. A range turned round overlaps none."""
    r = ranges.where("lo <= hi")
    own = r.select(key, F.struct("book", "chapter", "lo", "hi").alias("r"))
    left, right = own.select(F.col(key).alias("a"), F.col("r").alias("x")), own.select(F.col(key).alias("b"), F.col("r").alias("y"))
    return left.join(_overlaps(r, width), "x").join(right, "y").where("a < b").select("a", "b").distinct()


def overlap_counts(ranges: DataFrame, key: str, width: int = 8) -> DataFrame:
    """(key, links): how many other keys each key's range overlaps. A key with several ranges counts another key once for each of its
    ranges that it overlaps. Pairs are made of distinct ranges only, with the number of their keys."""
    r = ranges.where("lo <= hi").select(key, F.struct("book", "chapter", "lo", "hi").alias("x")).distinct()
    n = r.groupBy("x").agg(F.count("*").alias("n"))
    links = _overlaps(ranges.where("lo <= hi"), width).join(n.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.sum("n").alias("n"))
    return r.join(links, "x").groupBy(key).agg((F.sum("n") - F.count("*")).alias("links"))


def crossrefs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rel_type, target), distinct: what a reference work points to: 'See X; Y.' and 'Véase X.' give SEE_ALSO, 'cf. X' and 'Compare X' give
    COMPARE_WITH; targets are parted at semicolons and begin their words with capitals."""
    p = r"(?:^|[\s(])(See also|See|Véase también|Véase|[Cc]f\.|[Cc]ompare|[Cc]ompárese)\s+(\p{Lu}[^.()\n]{1,120}?)(?=[.()\n]|$)"
    one = lambda i: F.regexp_extract_all(text, F.lit(p), F.lit(i))
    hit = docs.where(F.col(text).isNotNull()).select(key, F.explode_outer(F.arrays_zip(one(1).alias("how"), one(2).alias("what"))).alias("m")).where("m is not null")
    hit = hit.select(key, F.when(F.lower("m.how").rlike("^(cf|comp)"), "COMPARE_WITH").otherwise("SEE_ALSO").alias("rel_type"), F.explode(F.split("m.what", r"\s*;\s*")).alias("target"))
    return hit.select(key, "rel_type", F.initcap(F.trim(F.regexp_replace("target", r"^(?:and|y|also)\s+|[\s,:]+$", ""))).alias("target")).where("target <> ''").distinct()


#: Relations that are noise where nothing surer says them, by how much is to go; tiers and sources that are never touched.
NOISE = {"conservative": ("CO_OCCURS_WITH",), "aggressive": ("CO_OCCURS_WITH", "ASSOCIATED_WITH", "RELATED_TO", "BELONGS_TO", "LIVED_DURING", "EXISTS_DURING", "REFERENCED_IN", "TEACHES")}
PRESERVED = ("curated", "metadata", "llm_high")


def is_noise(tier: str = "conservative"):
    """Whether an edge (rel_type, confidence) is noise: of the conservative tier any co-occurrence that nothing surer backs, of the aggressive
    one also weakly stated relations (llm_low). A null confidence counts as nothing sure."""
    sure = F.coalesce(F.col("confidence"), F.lit("")).isin(*PRESERVED)
    weak = F.col("rel_type").isin(*NOISE["aggressive"][1:]) & (F.coalesce(F.col("confidence"), F.lit("")) == "llm_low")
    noise = F.col("rel_type").isin(*NOISE["conservative"])
    return ((noise | weak) if tier == "aggressive" else noise) & ~sure


#: A line that opens a verse.
OPENS = r"^[0-9]{1,3}[ \t\f\x0B]+[^ \t\n\r\f\x0B]"


def running_verses(chunks: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """The chunks, ``text`` with its lines joined by a blank, and all their verses (file_path, verse, body): an opening line together with the
    lines that go on with it up to the next one, joined likewise, so that a chunk's text holds its verses. Blank lines are passed over."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.rtrim(x, F.lit(" \t\f\x0B\r"))), lambda x: x != "")
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.ltrim(x, F.lit(" \t\f\x0B"))), " ")
    opens = lambda xs: F.filter(F.transform(xs, lambda x, i: F.when(x.rlike(OPENS), i + 1)), lambda i: i.isNotNull())
    each = let(lines, lambda xs: let(opens(xs), lambda at: F.transform(at, lambda i, j: joined(F.slice(xs, i, F.coalesce(F.get(at, j + 1), F.size(xs) + 1) - i)))))
    v = chunks.where(F.col(text).rlike("(?m)" + OPENS)).select("file_path", F.explode(each).alias("v"))
    v = v.select("file_path", F.regexp_extract("v", r"^([0-9]{1,3})", 1).cast("int").alias("verse"), F.regexp_extract("v", r"(?s)^[0-9]{1,3}[ \t\f\x0B]+(.*)\z", 1).alias("body"))
    return chunks.withColumn(text, joined(lines)), v


#: Characters by which a verse's beginning is looked for, and bits of the filter of all that are looked for: 16 MB, the one thing of
#: ``verse_spans`` that comes to the driver. With more verses than bits more candidates travel; the result stays the same.
ANCHOR, FILTER_BITS = 20, 1 << 27
SLICE_BITS = 1 << 20
SPACES = np.array([9, 10, 11, 12, 13, 32], "u4")


def _anchors(texts: list[str], files: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the rows' files, and (row, place, key) of the ANCHOR characters that follow white space in a text; a key is of the file
    and the characters."""
    of = {f: int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "little") for f in set(files)}
    own = np.array([of[f] for f in files], "u8")
    c = np.frombuffer("".join(texts).encode("utf-32-le"), "u4")
    n = np.array([len(t) for t in texts], int)
    ends = np.cumsum(n)
    space = np.isin(c, SPACES)
    at = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    row = np.searchsorted(ends, at, "right")
    within = (at > (ends - n)[row]) & (at + ANCHOR <= ends[row]) if len(at) else np.zeros(0, bool)
    at, row = at[within], row[within]
    key = own[row]
    for j in range(ANCHOR):
        key = key * np.uint64(0x9E3779B97F4A7C15) + c[at + j]
        key ^= key >> np.uint64(29)
    return own, row, at - (ends - n)[row], key


def verse_spans(chunks: DataFrame, verses: DataFrame, key: str, snippet: int = 60) -> DataFrame:
    """(key, first_verse, last_verse): the verses of a chunk's file whose first ``snippet`` characters it holds. ``chunks``: key, file_path, text;
    ``verses``: file_path, verse, body. Chunks that hold none have no row.

    A verse is looked for by the last ANCHOR characters of its beginning that follow white space. A filter of bits tells in which places of the
    texts such characters stand, and only the surroundings of these places travel and meet the file's verses in an equi-join, so that neither
    texts are multiplied nor a file's chunks with its verses. Beginnings without such characters, short ones say, meet all texts of their file.
    """
    v = verses.where("body <> '' and file_path is not null").select("file_path", "verse", F.substring("body", 1, snippet).alias("head"))
    c = chunks.where("text is not null and file_path is not null").select(F.col(key).alias("key"), "file_path", "text")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, row, _, found = _anchors(b.column(2).to_pylist(), b.column(0).to_pylist())
            k[row] = found  # of several the last
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k.view("i8"))], names=["file_path", "verse", "head", "k"])

    def bits_of(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(SLICE_BITS, bool)
        bits[pdf.bit.to_numpy() % SLICE_BITS] = True
        return pd.DataFrame({"part": [int(pdf.bit.iloc[0]) // SLICE_BITS], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    v = v.mapInArrow(keyed, StructType([*v.schema.fields, StructField("k", LongType())]))
    wanted = v.select(F.col("k").bitwiseAND(FILTER_BITS - 1).alias("bit")).distinct()
    table = np.zeros(FILTER_BITS // 8, "u1")
    for r in wanted.groupBy(F.floor(F.col("bit") / SLICE_BITS)).applyInPandas(bits_of, "part int, bits binary").collect():
        table[r.part * SLICE_BITS // 8 : (r.part + 1) * SLICE_BITS // 8] = np.frombuffer(r.bits, "u1")
    sent = chunks.sparkSession.sparkContext.broadcast(table)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        is_wanted = lambda k: np.flatnonzero(table[(k & np.uint64(FILTER_BITS - 1)) >> np.uint64(3)] >> (k & np.uint64(7)).astype("u1") & 1)
        for b in (w.slice(lo, 512) for w in batches for lo in range(0, w.num_rows, 512)):
            files, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
            own, row, at, k = _anchors(texts, files)
            hit, whole = is_wanted(k), is_wanted(own)
            rows = [*row[hit].tolist(), *whole.tolist()]
            parts = [texts[i][max(0, p + ANCHOR - snippet) : p + snippet] for i, p in zip(rows, at[hit].tolist())] + [texts[i] for i in whole.tolist()]
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate([k[hit], own[whole]]).view("i8")), pa.array(parts, pa.string())], names=["key", "file_path", "k", "part"])

    found = c.mapInArrow(places, StructType([c.schema["key"], c.schema["file_path"], StructField("k", LongType()), StructField("part", StringType())]))
    heads = v.repartition("file_path", "k").groupBy("file_path", "k", "head").agg(F.min("verse").alias("lo"), F.max("verse").alias("hi"))
    hit = found.join(heads, ["file_path", "k"]).where(F.col("part").contains(F.col("head")))
    return hit.groupBy(F.col("key").alias(key)).agg(F.min("lo").alias("first_verse"), F.max("hi").alias("last_verse"))


def ner_candidates(names: DataFrame, known: DataFrame, stop: list[str]) -> DataFrame:
    """(name, reason): names found by a model or by capitals, with why each is dropped: garbage, canonical (a dictionary has it, ``known``: term),
    numeric, verse_number, stopword; null where it may be a new entity."""
    from lorekiln.functions.text import entity_name, garbage_reason

    n = names.select("name").distinct().withColumn("k", entity_name(F.col("name")))
    n = n.join(known.select(F.col("term").alias("k"), F.lit(True).alias("known")).distinct(), "k", "left")
    reason = F.coalesce(garbage_reason(F.col("name")), F.when(F.col("known"), "canonical"), F.when(F.col("name").rlike(r"^[\d\s.,:–-]+$"), "numeric"), F.when(F.col("name").rlike(r"^\d+\s"), "verse_number"), F.when(F.lower("name").isin(stop), "stopword"))
    return n.select("name", reason.alias("reason"))
