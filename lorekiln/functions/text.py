"""Column builders for text, names and paths; all stay within code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and their plain forms.
FOLD = ("áàâãäéèêëíìîïóòôõöúùûüñç", "aaaaaeeeeiiiiooooouuuunc")
#: Pronouns and archaic verbs that are no names; words that open Spanish sentences; measures; top-level domains.
PRONOUNS = "thou thee thy thine ye he she it him her us we they them el él ella ellos ellas nos nosotros yo tú tu su mi me te se".split()
ARCHAIC = "hath saith spake smote doth shalt wilt cometh goeth maketh taketh dwelt begat".split()
OPENERS = "Así Entonces Cuando Cuándo Mientras Aunque Porque Pues Desde Hasta Luego Conforme Mas Sino Tampoco También Quizás Quizá Acaso Apenas Después Antes Siempre Nunca Jamás Quien Quienes Quién Quiénes".split()
UNITS = r"meter metro kilometer kil[oó]metro mile milla foot feet pie inch pulgada degree grado percent por\s*ciento cent[ií]metro cent[ií]grade yard yarda ounce onza pound libra gram gramo liter litro second segundo minute minuto hour hora year a[ñn]o day d[ií]a cubit codo".split(" ")
DOMAINS = "org com net edu gov io".split()
#: Names and abbreviations of books, English and Spanish, as patterns of the part they share and its endings.
BOOKS = (
    "gen(esis)? génesis exod(us|o)? ex éxodo lev(iticus|[íi]tico)? num(bers|eros)? n[uú]meros deut(eronom(y|io))? josh(ua)? josu[ée] judg(es)? jueces ruth rut sam(uel)? k(in)?gs? reyes chr(on(icles)?)? cr[oó]n(icas)? "
    "ezra esdras neh(emiah|em[íi]as)? esth(er)? ester job ps(alms?|\\.)? salmos? prov(erbs|erbios)? eccl(esiastes|esiast[eé]s)? song(s)? cant(ares)? isa(iah|[íi]as)? jer(emiah|em[íi]as)? lam(entations|entaciones)? "
    "ezek(iel)? ezequiel dan(iel)? hos(ea)? oseas joel amos am[oó]s obad(iah|[íi]as)? abd[íi]as jon(ah|[aá]s)? mic(ah)? miqueas nah(um|[uú]m)? hab(akkuk|acuc)? zeph(aniah)? sofon[íi]as hag(gai|eo)? zech(ariah)? zec zacar[íi]as mal(achi|aqu[íi]as)? "
    "matt(hew)? mt mateo mark mk marcos luke lk lucas john jn juan acts hechos rom(ans|anos)? ro cor(inthians|intios)? gal(atians|atas|átas)? eph(esians|esios)? phil(ippians|ipenses)? col(ossians|osenses)? thess(alonians)? tesalonicenses "
    "tim(othy|oteo)? tit(us|o)? phlm filem[oó]n heb(rews|reos)? jas james jms santiago pet(er)? pedro jude judas rev(elation)? rv apocalipsis "
    "nephi nefi jacob enos en[óo]s jarom omni mosiah mos[íi]ah alma hel(aman|am[áa]n)? mormon morm[óo]n ether [ée]ter moroni d(&|y)c dc dyc moses mois[ée]s abr(aham)? jsh jsm js-h js-m"
).split()
#: Chapter and verse right after a name, which make it a citation's book.
CITATION = r"\.?\s+\d{1,3}:\d{1,3}(?:[-–]\d{1,3})?"
STOP_WORDS = "a al an and are as at be but by con de del el en es for from had has have he her his in is it la las lo los más no of on or para pero por que se she sin su the their they this to un una was were who with y".split()


def normalised(c: Column) -> Column:
    """Lower case without accents, other signs as single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), *FOLD), "[^a-z0-9]+", " "))


def entity_name(c: Column) -> Column:
    """The key under which spellings of a name meet: lower case, without a leading honorific or article, single blanks."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"^(señor|su\s+hijo|the\s+lord|el\s+señor)\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"^(the|el|la|los|las|un|una)\s+", ""), r"\s+", " "))


def sentences(c: Column) -> Column:
    """Sentences: cut after . ! ? before white space, and at blank lines; trimmed, without empty ones."""
    parts = F.split(c, r"(?<=[.!?])\s+|\n\n+")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


#: Pairs of characters that double decoding leaves; signs that begin no name.
MOJIBAKE = "Ã[¡¢£¤¥¦§¨©ª«®¯°±²³´µ¶·¸¹º»Ã]|â€[™œ\u009d\u009ctm\\s]|Â[\u00ad·¦¥]|Ï[Î€¬†]|[ÏÎ]{2,}"
LEADING = r"^[\x{2022}\x{2023}\x{25E6}\x{2043}\x{2219}\x{B7}\x{21A9}\x{2190}-\x{21FF}\x{2070}-\x{209F}\[({<*+=|\\/~_\-\x{2010}-\x{2015}]"


def _word(words: list[str], end: str = "") -> str:
    """A pattern for one of the words between signs that are no letters, figures or underscores."""
    return rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(words)}){end}([^\p{{L}}\p{{N}}_]|$)"


def garbage_rules(c: Column) -> list[tuple[str, Column]]:
    """(reason, condition) in order of precedence, for a trimmed name."""
    n = F.length(c)
    alnum = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    digits = F.length(F.regexp_replace(c, r"[^0-9]", ""))
    low = F.lower(c)
    return [
        ("empty", n == 0),
        ("nul_bytes", F.instr(c, "\x00") > 0),
        ("too_short", n < 3),
        ("too_long", n > 80),
        ("all_punct", alnum == 0),
        ("url_like", low.rlike(rf"https?://|www\.|[a-z0-9][a-z0-9-]*\.({'|'.join(DOMAINS)})\b")),
        ("html_fragment", c.rlike(r"<\s*/?\s*[a-z][a-z0-9]*(\s+[^>]*)?>|\b(id|class|href|src|rel|style|data-\w+)\s*=\s*[\"']|&(amp|lt|gt|quot|nbsp|#[0-9]+);")),
        ("mojibake", c.rlike(MOJIBAKE)),
        ("scripture_ref", low.rlike(rf"^\s*((read|ver|véase|see)\s+)?(\d\s+)?({'|'.join(BOOKS)})\.?\s+\d+")),
        ("archaic_verb", low.rlike(_word(ARCHAIC))),
        ("xref_fragment", low.rlike("^(see |véase )")),
        ("pronoun_stopword", low.isin(PRONOUNS)),
        ("leading_punct", c.rlike(LEADING)),
        ("markdown_heading", c.rlike(r"^#{1,6}\s|\s#{2,}\s*$|^#{2,}$")),
        ("measurement", low.rlike(_word(UNITS, "s?")) & (digits >= 0.18 * alnum)),
        ("sentence_fragment_es", c.rlike("^(" + "|".join(OPENERS) + r")\s+[\p{L}\p{N}_]")),
        ("lowercase_token", c.rlike("^[a-záéíóúñüç]+$")),
    ]


def garbage_reason(c: Column) -> Column:
    """The first reason why a name is none, else null; a null name is empty."""
    s = F.coalesce(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
    rules = garbage_rules(s)
    out = F.when(rules[0][1], F.lit(rules[0][0]))
    for reason, cond in rules[1:]:
        out = out.when(cond, F.lit(reason))
    return out


def garbage_reasons(c: Column) -> Column:
    """All of the set-based clean-up's reasons that hold for a name, as an array."""
    keep = ("all_punct", "url_like", "too_long", "too_short", "archaic_verb", "xref_fragment", "pronoun_stopword")
    return F.array_compact(F.array(*[F.when(cond, F.lit(reason)) for reason, cond in garbage_rules(c) if reason in keep]))


def snippet(text: Column, needle: Column, width: int = 120) -> Column:
    """``width`` characters around the first mention, without regard to case, with ellipses where it was cut; null without one."""
    at = F.instr(F.lower(text), F.lower(needle))
    start = F.greatest(F.lit(1), at - width // 2)
    cut = F.substring(text, start, F.lit(width))
    return F.when(at > 0, F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(start + width <= F.length(text), "...").otherwise("")))


def path_part(path: Column, k: int) -> Column:
    """language, category, file name and suffix of ``{lang}/{category}/{name}``; the language may be missing."""
    lang = F.regexp_extract(path, r"^([a-z]{2})/", 1)
    rest = F.regexp_replace(path, r"^[a-z]{2}/", "")
    return (F.nullif(lang, F.lit("")), F.regexp_extract(rest, r"^(.*)/[^/]*$", 1), F.regexp_extract(rest, r"([^/]*)$", 1), F.regexp_extract(rest, r"\.([a-z0-9]+)$", 1))[k]


def trigrams(c: Column) -> Column:
    """The set of trigrams of a name's words, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))
    return F.array_distinct(grams)


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two trigram sets."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def ranked(value: Column, order: list[str]) -> Column:
    """The place of a value in an ordered list; values outside come last."""
    out = F.when(value == order[0], 0)
    for i, v in enumerate(order[1:], 1):
        out = out.when(value == v, i)
    return out.otherwise(len(order))


def scripture_path(path: Column) -> Column:
    """(lang, volume, book, chapter) of '{lang}/scriptures/{volume}/[{book}/]{chapter}.txt', whichever slashes it has; null for another path.
    Sections of the volume dc have no book."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    pattern = r"(?:^|/)([a-z]{2})/scriptures/([a-z]+)/(?:([a-z0-9-]+)/)?([0-9]+)\.txt$"
    part = lambda i: F.regexp_extract(p, pattern, i)
    book = F.when(part(2) != "dc", F.nullif(part(3), F.lit("")))
    return F.when(p.rlike(pattern), F.struct(part(1).alias("lang"), part(2).alias("volume"), book.alias("book"), part(4).cast("int").alias("chapter")))


def is_below(path: Column, folder: str) -> Column:
    """Whether a folder (of one or more parts) is among a path's."""
    return F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/"))).contains(f"/{folder}/")


def references(text: Column) -> Column:
    """The citations of a text in order: (book, chapter, verses), verses as written ('3, 5–7', or empty for a chapter). Longer book names go
    before their abbreviations."""
    book = rf"(?i)((?:[1-4]\s)?(?<![\p{{L}}])(?:{'|'.join(BOOKS).replace('(', '(?:')})\.?)\s+(\d{{1,3}})(?::(\d{{1,3}}(?:\s*[,–-]\s*\d{{1,3}}(?!\d*:))*))?"
    one = lambda i: F.regexp_extract_all(text, F.lit(book), F.lit(i))
    return F.zip_with(F.arrays_zip(one(1).alias("book"), one(2).alias("chapter")), one(3), lambda b, v: F.struct(F.regexp_replace(b["book"], r"\s+|\.$", " ").alias("book"), b["chapter"].cast("int").alias("chapter"), v.alias("verses")))


def verse_list(verses: Column) -> Column:
    """'3, 5–7 (4-9)' as ranges [(3, 3), (5, 7), (4, 9)]; what isn't a number or range is passed over, an empty text gives none."""
    items = F.regexp_extract_all(verses, F.lit(r"\d+\s*(?:[–-]\s*\d+)?"), F.lit(0))
    lo = lambda x: F.regexp_extract(x, r"^(\d+)", 1).try_cast("int")
    return F.transform(items, lambda x: F.struct(lo(x).alias("lo"), F.coalesce(F.regexp_extract(x, r"[–-]\s*(\d+)$", 1).try_cast("int"), lo(x)).alias("hi")))


def footnote_references(text: Column) -> Column:
    """The citations of a footnote as (book, chapter, lo, hi): lists and parenthesised ranges apart, a chapter alone with null verses; a part
    after ';' that names no book belongs to the book before ('Alma 5:3; 7:2')."""
    filled = F.regexp_replace(text, r";\s*(?=\d+:)", "; \u0001 ")
    cited = rf"(?i)(?:((?:[1-4]\s)?(?<![\p{{L}}])(?:{'|'.join(BOOKS).replace('(', '(?:')})\.?)|\x01)\s+(\d{{1,3}})(?::(\d{{1,3}}(?:\s*[,–-]\s*\d{{1,3}}(?!\d*:)|\s*\(\d{{1,3}}\s*[–-]\s*\d{{1,3}}\))*))?"
    one = lambda i: F.regexp_extract_all(filled, F.lit(cited), F.lit(i))
    parts = F.zip_with(F.arrays_zip(one(1).alias("b"), one(2).alias("c")), one(3), lambda x, v: F.struct(F.nullif(F.trim(F.regexp_replace(x["b"], r"\.$", "")), F.lit("")).alias("b"), x["c"].cast("int").alias("c"), v.alias("v")))
    row = "array<struct<book:string,chapter:int,lo:int,hi:int>>"
    ranges = lambda a, x: F.when(x["v"] == "", F.array(F.struct(F.coalesce(x["b"], a["last"]).alias("book"), x["c"].alias("chapter"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi")))).otherwise(F.transform(verse_list(x["v"]), lambda r: F.struct(F.coalesce(x["b"], a["last"]).alias("book"), x["c"].alias("chapter"), r["lo"].alias("lo"), r["hi"].alias("hi")))).cast(row)
    step = lambda a, x: F.struct(F.coalesce(x["b"], a["last"]).alias("last"), F.concat(a["out"], ranges(a, x)).alias("out"))
    return F.aggregate(parts, F.struct(F.lit(None).cast("string").alias("last"), F.array().cast(row).alias("out")), step, lambda a: a["out"])


def composed(df, column: str):
    """A table with a text column in composed form (NFC), which no built-in function makes; one Arrow pass, nulls stay."""
    import unicodedata

    import pyarrow as pa

    at = df.columns.index(column)

    def run(batches):
        for b in batches:
            t = pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFC", x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], t, *b.columns[at + 1 :]], names=b.schema.names)

    return df.mapInArrow(run, df.schema)
