"""Family relations stated in sentences: kinship nouns in a few frames, one pass over the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinship nouns with the relation they state and its direction. ``back``: "X, son of Y" states that Y is X's father.
KIN = {
    "son": ("FATHER_OF", "back"), "daughter": ("FATHER_OF", "back"), "hijo": ("FATHER_OF", "back"), "hija": ("FATHER_OF", "back"),
    "father": ("FATHER_OF", "on"), "padre": ("FATHER_OF", "on"), "mother": ("MOTHER_OF", "on"), "madre": ("MOTHER_OF", "on"),
    "wife": ("SPOUSE_OF", "back"), "husband": ("SPOUSE_OF", "back"), "esposa": ("SPOUSE_OF", "back"), "esposo": ("SPOUSE_OF", "back"), "mujer": ("SPOUSE_OF", "back"),
    "brother": ("BROTHER_OF", "on"), "hermano": ("BROTHER_OF", "on"), "sister": ("SISTER_OF", "on"), "hermana": ("SISTER_OF", "on"),
}
#: Verbs that state a father.
VERBS = {"begat": "begat", "engendró": "engendró a", "engendro": "engendró à"}
#: Spouses are stated after a comma only; the other nouns also with their article alone.
COMMA_ONLY = {"wife", "husband", "esposa", "esposo", "mujer"}
ENGLISH = {"son", "daughter", "father", "mother", "wife", "husband", "brother", "sister"}
#: Words that open a sentence before a name; words that are no person's name at its beginning.
OPENERS = "And But Now Then For So Yet Also O Behold Verily Likewise Otherwise Furthermore Moreover However Nevertheless Thus Hence Therefore Meanwhile Besides Indeed Truly Wherefore Y Pero Entonces Luego Porque Mas Sino Asimismo Además".split()
OPENING_PHRASES = ("Por tanto", "Por lo tanto", "Por eso", "Por ende", "Al contrario", "Sin embargo", "No obstante", "He aquí")
NOT_PERSONS = (
    "Mount City Land Valley River Sea Lake Plains North South East West Great Lesser New Old Upper Lower King Queen Lord Sir Lady Saint Prince Princess Captain General Elder Brother Sister Father Mother "
    "Monte Ciudad Tierra Valle Río Mar Lago Llanura Norte Sur Este Oeste Grande Menor Nueva Nuevo Viejo Alto Bajo Rey Reina Señor Señora San Santa Príncipe Princesa Capitán "
    "Syrian SYRIAN Egyptian Greek Roman Jew Jewish Sirio Egipcio Griego Romano Judío Reubenite Reubenites Rubenita"
).split()
#: Captures that are no names; siblings' names that are standing titles.
NO_NAMES = "And But Now Then For So Yet Also Behold Verily Y Pero Entonces Luego Porque Mas Sino Shared Named".split()
TITLES = ("Jared",)

_CAPITAL = r"[A-ZÁÉÍÓÚÑÇ][A-Za-zÁÉÍÓÚÑáéíóúñÇç'-]{1,30}"
NAME = rf"{_CAPITAL}(?:\s+{_CAPITAL}){{0,3}}"


def _connector() -> str:
    """All connectors as one alternation; the noun or verb is its second group."""
    en, es = sorted(set(KIN) & ENGLISH), sorted(set(KIN) - ENGLISH)
    bare_en, bare_es = [n for n in en if n not in COMMA_ONLY], [n for n in es if n not in COMMA_ONLY]
    frames = [
        rf",\s+(?:the\s+)?(?:{'|'.join(en)})\s+of\s+", rf"\s+the\s+(?:{'|'.join(bare_en)})\s+of\s+",
        rf",\s+(?:el\s+|la\s+)?(?:{'|'.join(es)})\s+de\s+", rf"\s+(?:el\s+|la\s+)?(?:{'|'.join(bare_es)})\s+de\s+",
        r"\s+begat\s+", r"\s+engendró\s+[aà]\s+",
    ]
    return "|".join(frames)


def _cleaned(name: Column) -> Column:
    opening = rf"^(?:{'|'.join([*OPENERS, *[p.replace(' ', r'\s+') for p in OPENING_PHRASES]])})\s+"
    s = F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), opening, ""), opening, ""))
    return F.when(~s.isin(NO_NAMES), s).otherwise("")


def _is_person(name: Column) -> Column:
    words = F.split(name, r"\s+")
    capitals = F.forall(words, lambda w: (w == F.upper(w)) & (F.length(w) > 1))
    return (name != "") & ~capitals & ~F.element_at(words, 1).isin(NOT_PERSONS)


def family_edges(docs: DataFrame, key: str, text: str, not_names: list[str] = ()) -> DataFrame:
    """(key, src, rel_type, dst), distinct: who is the FATHER_OF, MOTHER_OF, SPOUSE_OF, BROTHER_OF or SISTER_OF whom.

    One regular expression finds all connectors in one scan; a name is up to four capitalised words. Left out are names all in
    capitals, those that begin with a place or title, those of ``not_names``, pairs of which one contains the other, and
    siblings of a standing title. A name may end one statement and begin the next. Null texts give nothing.
    """
    c = _connector()
    # a look-ahead keeps the second name for the statement that it begins
    pattern = rf"({NAME})((?i:{c}))(?=({NAME}))"
    one = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    hit = docs.where(F.col(text).rlike(rf"(?i:{c})")).select(key, F.explode_outer(F.arrays_zip(one(1).alias("a"), one(2).alias("c"), one(3).alias("b"))).alias("m")).where("m is not null")
    noun = F.regexp_extract(F.lower("m.c"), rf"({'|'.join([*KIN, 'begat', 'engendró'])})", 1)
    hit = hit.select(key, _cleaned(F.col("m.a")).alias("a"), _cleaned(F.col("m.b")).alias("b"), noun.alias("noun"))
    relation, turned = F.lit("FATHER_OF"), F.lit(False)
    for n, (r, d) in KIN.items():
        relation, turned = F.when(F.col("noun") == n, r).otherwise(relation), F.when(F.col("noun") == n, d == "back").otherwise(turned)
    hit = hit.withColumn("rel_type", relation).withColumn("turned", turned).where(_is_person(F.col("a")) & _is_person(F.col("b")))
    inside = F.lower("a").contains(F.lower("b")) | F.lower("b").contains(F.lower("a"))
    hit = hit.where(~inside & ~(F.col("rel_type").isin("BROTHER_OF", "SISTER_OF") & F.col("b").isin(*TITLES)))
    if not_names:
        hit = hit.where(~F.col("a").isin(list(not_names)) & ~F.col("b").isin(list(not_names)))
    return hit.select(key, F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")).alias("src"), "rel_type", F.when(F.col("turned"), F.col("a")).otherwise(F.col("b")).alias("dst")).distinct()
