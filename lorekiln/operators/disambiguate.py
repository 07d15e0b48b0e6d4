"""Which entity a mention means: rule tables over the text around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.functions.arrays import small
from lorekiln.functions.names import window_around
from lorekiln.operators.graph import first_by

SURE = ["high", "medium", "low"]
#: What is said of a name tells what it names: (language, pattern with {NAME}, type, how sure).
FRAMES = [
    ("en", r"(?:tribe|tribes)\s+of\s+{NAME}", "people", "high"), ("en", r"(?:children|sons|daughters|people|house|descendants)\s+of\s+{NAME}", "people", "high"), ("en", r"{NAME}ites?\b", "people", "high"), ("en", r"(?:the\s+)?{NAME}\s+(?:army|armies|people|nation|camp)", "people", "medium"),
    ("en", r"(?:land|territory|wilderness|desert|plains?|valleys?|hills?|mount(?:ain)?s?|borders?|waters?|river|sea|gates?|city|cities|region|coast)\s+of\s+{NAME}", "place", "high"), ("en", r"(?:in|to|from|at|toward|through|near|beyond)\s+{NAME}(?:\s|[,.]|$)", "place", "low"),
    ("en", r"{NAME}\s+(?:gate|valley|road|brook|river|plain|forest|wood|spring|well|wall|tower)", "place", "medium"), ("en", r"(?:kingdom?|king|kings)\s+of\s+{NAME}", "polity", "high"), ("en", r"(?:ruler|prince|judge|governor)\s+(?:of|over)\s+{NAME}", "polity", "high"),
    ("en", r"{NAME}\s+(?:begat|begot|bore|conceived)", "person", "high"), ("en", r"(?:begat|begot|bore)\s+{NAME}", "person", "high"), ("en", r"{NAME}\s+(?:the\s+)?(?:son|daughter)\s+of", "person", "high"), ("en", r"(?:son|daughter|wife|husband|brother|sister|mother|father)\s+of\s+{NAME}", "person", "high"),
    ("en", r"{NAME}\s+(?:said|spake|spoke|answered|replied|cried|prayed|went|came|arose|died|slew|smote|fought|built|offered)", "person", "medium"),
    ("es", r"(?:tribu|tribus)\s+de\s+{NAME}", "people", "high"), ("es", r"(?:hijos|hijas|pueblo|casa|descendientes)\s+de\s+{NAME}", "people", "high"), ("es", r"(?:tierra|territorio|desierto|llanos?|valles?|monte|río|mar|puertas?|ciudad(?:es)?|región|costa)\s+de\s+{NAME}", "place", "high"),
    ("es", r"(?:en|a|desde|hacia|hasta|por|cerca\s+de)\s+{NAME}(?:\s|[,.]|$)", "place", "low"), ("es", r"(?:reino|rey|reyes)\s+de\s+{NAME}", "polity", "high"), ("es", r"{NAME}\s+engendró", "person", "high"), ("es", r"engendró\s+a\s+{NAME}", "person", "high"),
    ("es", r"(?:hijo|hija|esposa|esposo|hermano|hermana|madre|padre)\s+de\s+{NAME}", "person", "high"), ("es", r"{NAME}\s+(?:dijo|habló|respondió|contestó|clamó|oró|fue|vino|murió|edificó|ofreció)", "person", "medium"), ("es", r"(?:llamado|nombrado|conocido\s+como|que\s+(?:es|era))\s+{NAME}", "person", "high"),
]


def by_rules(mentions: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, name, resolved, confidence, entity_type): what named rules say of mentions, the one of least priority first.

    ``mentions``: key, name, text, file_path. ``rules``: name, priority, pattern, path_pattern (null: any), resolved, confidence,
    entity_type (null: unsaid); patterns are matched against the lower-case window around the name. Rules meet mentions by
    name in an equi-join, broadcast while the table is small.
    """
    w = mentions.select("key", "name", F.lower("name").alias("k"), "file_path", window_around(F.col("text"), F.col("name")).alias("window"))
    hit = w.join(small(rules.withColumn("k", F.lower("name")).drop("name")), "k")
    hit = hit.where(F.expr("window rlike pattern") & (F.col("path_pattern").isNull() | F.expr("file_path rlike path_pattern")))
    return first_by(hit, ["key", "name"], [F.col("priority"), F.col("resolved")]).select("key", "name", "resolved", "confidence", "entity_type")


def by_frames(mentions: DataFrame, frames: list[tuple[str, str, str, str]] = FRAMES) -> DataFrame:
    """(key, name, resolved, confidence, entity_type): the surest frame of the mention's language around a name, the first of equally
    sure ones; 'NAME (type)'. A path with /es/ or es/ in front is Spanish, any other English."""
    w = mentions.select("key", "name", F.lower("name").alias("k"), F.when(F.coalesce("file_path", F.lit("")).rlike("(^|/)es/"), "es").otherwise("en").alias("lang"), window_around(F.col("text"), F.col("name")).alias("window"))
    quoted = F.regexp_replace("k", r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    table = F.array(*[F.struct(F.lit(la).alias("lang"), F.lit(p).alias("pattern"), F.lit(t).alias("entity_type"), F.lit(c).alias("confidence")) for la, p, t, c in sorted(frames, key=lambda f: SURE.index(f[3]))])
    fits = F.filter(table, lambda f: (f["lang"] == F.col("lang")) & F.regexp_like("window", F.replace(f["pattern"], F.lit("{NAME}"), F.col("q"))))
    hit = w.withColumn("q", quoted).withColumn("r", F.get(fits, F.lit(0))).where("r is not null")
    return hit.select("key", "name", F.concat("name", F.lit(" ("), "r.entity_type", F.lit(")")).alias("resolved"), "r.confidence", "r.entity_type").distinct()


def disambiguated(mentions: DataFrame, rules: DataFrame, keep: tuple[str, ...] = ("high", "medium")) -> DataFrame:
    """(key, name, resolved, confidence, entity_type): named rules first, frames for the rest; only what is sure enough is kept."""
    named = by_rules(mentions, rules)
    rest = mentions.join(named.select("key", "name"), ["key", "name"], "left_anti")
    return named.unionByName(by_frames(rest)).where(F.col("confidence").isin(*keep))


def in_context(docs: DataFrame, key: str, text: str, phrases: DataFrame) -> DataFrame:
    """(key, entity): names that are also common words, found only in the phrases that tell them: ``phrases`` has entity, pattern and
    language (null: any), held against the text's language. The table is of fixed size and broadcast."""
    return docs.where(F.col(text).isNotNull()).join(small(phrases), F.expr(f"`{text}` rlike pattern") & (F.col("language").isNull() | (F.col("language") == F.col("lang")))).select(key, "entity").distinct()


def related_by_pattern(docs: DataFrame, key: str, text: str, found: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(key, src, rel_type, dst): relations stated by patterns with two captures (subject, object), both of which must be entities of the
    text: ``found`` has (key, name)."""
    hits = None
    for pattern, relation in patterns:
        p = F.lit(pattern)
        h = docs.where(F.col(text).rlike(pattern)).select(key, F.explode(F.arrays_zip(F.regexp_extract_all(text, p, F.lit(1)).alias("a"), F.regexp_extract_all(text, p, F.lit(2)).alias("b"))).alias("m")).select(key, F.lower("m.a").alias("a"), F.lit(relation).alias("rel_type"), F.lower("m.b").alias("b"))
        hits = h if hits is None else hits.unionByName(h)
    n = found.select(key, F.lower("name").alias("k"), "name").distinct()
    one = hits.join(n.withColumnRenamed("k", "a").withColumnRenamed("name", "src"), [key, "a"])
    return one.join(n.withColumnRenamed("k", "b").withColumnRenamed("name", "dst"), [key, "b"]).where("src <> dst").select(key, "src", "rel_type", "dst").distinct()


def name_sequences(docs: DataFrame, key: str, text: str, skip: list[str], encode=None) -> DataFrame:
    """(key, name): capitalised sequences that may name something; the fallback where no model for names is plugged in as ``encode``
    (DataFrame -> DataFrame of key, name). A word that merely opens a sentence isn't one, nor are those of ``skip``."""
    if encode is not None:
        return encode(docs)
    words = F.regexp_extract_all(text, F.lit(r"(?<![.!?\"“¿¡]\s)(?<!^)\b\p{Lu}\p{Ll}+(?:\s\p{Lu}\p{Ll}+){0,3}"), F.lit(0))
    return docs.where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(words)).alias("name")).where(~F.lower("name").isin([s.lower() for s in skip]))
