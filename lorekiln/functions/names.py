"""Column builders for names, titles, numerals, paths and short texts; all by ordered rules or patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekiln.functions import text as T

#: Malformed writings of a name in order of precedence: (kind, pattern of the whole, group that is the name).
VARIANTS = (
    ("bullet_prefix", r"^[\x{2022}\x{2023}\x{25E6}\x{2043}\x{2219}\x{B7}]\s+(.*)$", 1),
    ("arrow_prefix", r"^[\x{21A9}\x{2190}-\x{21FF}]\s+(.*)$", 1),
    ("possessive", r"^(.*)['\x{2019}][sS]$", 1),
    ("leading_quote", r"^[\"\x{201C}\x{201D}\x{2018}\x{2019}]+\s*(.*)$", 1),
    ("duplicated_word", r"(?i)^(\w+)\s+\1\s*$", 1),
    ("pronunciation_tail", r"^(\w+)\s+(?:\w*['\x{2019}]\w*[-\x{2010}\x{2014}]\w+|\w+[-\x{2010}\x{2014}]\w*['\x{2019}]\w*)$", 1),
    ("trailing_punct", r"^(.{3,}?)[,;:.\s]+$", 1),
)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def stripped_variant(name: Column) -> Column:
    """(candidate, pattern) of a malformed writing of a name, by the first pattern that fits; null where none does."""
    s = trimmed(name)
    out = None
    for kind, pattern, group in VARIANTS:
        found = F.struct(trimmed(F.regexp_extract(s, pattern, group)).alias("candidate"), F.lit(kind).alias("pattern"))
        out = F.when(s.rlike(pattern), found) if out is None else out.when(s.rlike(pattern), found)
    return out


#: Kinds of noise in names with their category, in order of precedence; 5 is garbage, 4 a common word, 3 a reference, 2 a
#: malformed name.
NOISE = (
    (5, "empty", r"^$"), (5, "mojibake", "[ÏÎÂâ½¬Ð·±µ]{2,}|Ã[¡©³º]|â[€™˜œ]"), (5, "control_char", r"[\x00-\x1f]"), (5, "html_fragment", r"</?[a-z]+\s*[^>]*>|\b(id|class|href|src)\s*=\s*[\"']"),
    (5, "numeric_only", r"^\s*[\d.\x{2013}:\s-]+\s*$"), (5, "overlong", r"(?s)^(?=.* ).{81,}$"), (5, "unbalanced_quotes", "^[^\"]*\"[^\"]*$|^[^']*'[^']*'[^']*'"), (5, "symbol", "√"), (5, "starts_nonword", r"^[^\p{L}\p{N}_\"'¿¡]"),
    (3, "scripture_ref", None), (3, "short_scripture", r"^\s*\d+\s*[:\x{2013}-]\s*\d+.{0,8}$"),
    (2, "possessive", r"['\x{2019}]s$"), (2, "duplicated_word", r"(?i)^(\w+)\s+\1\W*$"), (2, "trailing_punct", r"[,;:]$"), (2, "pronunciation_suffix", r"^\w+\s+\w+['-]\w+['-]\w+"), (2, "footnote_suffix", r"[\x{B2}\x{B3}\x{2070}-\x{2079}]+$"),
    (4, "single_lowercase", r"^\p{Ll}\S*$"),
    (4, "spanish_verb", r"(?i)(^|[^\p{L}\p{N}_])\w+(aba|abas|ábamos|aban|aría|arías|aríamos|arían|aré|arás|aremos|arán|é|ás|amos|án|ía|ías|íamos|ían|ió|iste|imos|ieron|ando|iendo|ado|ada|ido|ida)([^\p{L}\p{N}_]|$)"),
    (5, "sentence_fragment", r"(?i)\b(did|bare|was|were|has|had|debe|puede|pudo|viene)\b"),
)


def noise_category(name: Column) -> Column:
    """(category, reason) of a name: the first kind of noise that fits, else (1, clean). A null name is empty."""
    s = F.coalesce(trimmed(name), F.lit(""))
    low = F.lower(s)
    cites = low.rlike(rf"^\s*\(?\s*(\d\s+)?({'|'.join(T.BOOKS)})\.?\s*\d+([:.]\d|\s*$)")
    out = F.struct(F.lit(1).alias("category"), F.lit("clean").alias("reason"))
    for category, reason, pattern in reversed(NOISE):
        out = F.when(cites if pattern is None else s.rlike(pattern), F.struct(F.lit(category).alias("category"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def citation(book: Column, chapter: Column, first: Column, last: Column) -> Column:
    """'Book c:v-w', 'Book c:v' or 'Book c'; without a chapter the book alone."""
    verses = F.when(first.isNull(), "").when(last.isNull() | (last == first), F.concat(F.lit(":"), first.cast("string"))).otherwise(F.concat_ws("", F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string")))
    return F.when(chapter.isNull(), book).otherwise(F.concat(book, F.lit(" "), chapter.cast("string"), verses))


def slug(c: Column) -> Column:
    """Lower case without accents, words joined by hyphens."""
    return F.replace(T.normalised(c), F.lit(" "), F.lit("-"))


#: Numerals in words.
NUMERALS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def numeral(c: Column) -> Column:
    """The number that figures, an English word up to twenty or a Roman numeral stands for; null for anything else."""
    s = F.lower(trimmed(c))
    word = F.when(s == NUMERALS[0], 1)
    for i, w in enumerate(NUMERALS[1:], 2):
        word = word.when(s == w, i)
    values = F.transform(F.split(s, ""), lambda x: reduce(lambda a, kv: F.when(x == kv[0], kv[1]).otherwise(a), ROMAN.items(), F.lit(0)))
    # a smaller figure before a greater one is taken away
    signed = F.zip_with(values, F.concat(F.slice(values, 2, 1 << 20), F.array(F.lit(0))), lambda v, after: F.when(v < after, -v).otherwise(v))
    roman = F.aggregate(signed, F.lit(0), lambda a, v: a + v)
    return F.when(s.rlike(r"^\d{1,9}$"), s.try_cast("int")).when(word.isNotNull(), word).when(s.rlike("^[ivxlcdm]+$"), roman)


def event_name(series: Column, month: Column) -> Column:
    """'Series Month Year' of a 'YYYY-MM' date; without a month the year alone, unknown months as they are."""
    names = "January February March April May June July August September October November December".split()
    m = F.element_at(F.split(month, "-"), 2)
    name = reduce(lambda a, im: F.when(m == f"{im[0]:02d}", im[1]).otherwise(a), enumerate(names, 1), m)
    return F.trim(F.concat_ws(" ", series, F.when(F.size(F.split(month, "-")) > 1, name), F.element_at(F.split(month, "-"), 1)))


#: Questions that want a list of all; English and Spanish.
ENUMERATION = (r"\bcu[aá]nt[ao]s\b", r"\bhow many\b", r"\btod[ao]s l[ao]s\b", r"\ball the\b", r"\bevery\b", r"\blista\b.*\bmencion", r"\blist\b.*\bmention", r"\bqu[ée] .*\bse mencionan\b", r"\bwho .*\bare mentioned\b", r"\benumera\b", r"\benumerate\b")


def wants_all(question: Column) -> Column:
    """Whether a question asks for an exhaustive list."""
    return F.coalesce(reduce(lambda a, p: a | p, [F.lower(question).rlike(p) for p in ENUMERATION]), F.lit(False))


def is_specific(question: Column) -> Column:
    """Whether a question names enough for a full-text search as it stands: a citation, two names, or one among six words."""
    names = F.size(F.regexp_extract_all(question, F.lit(r"\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})*\b"), F.lit(0)))
    cites = F.lower(question).rlike(rf"(^|[^\p{{L}}])({'|'.join(T.BOOKS)})\.?\s+\d")
    return F.coalesce(cites | (names >= 2) | ((names >= 1) & (F.size(F.split(trimmed(question), r"\s+")) >= 6)), F.lit(False))


def pattern_score(c: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur in a text."""
    return reduce(lambda a, p: a + p, [c.rlike(p).cast("int") for p in patterns], F.lit(0))


def best_kind(c: Column, kinds: list[tuple[str, list[str]]], none: str) -> Column:
    """The kind of which most patterns occur, the first of equal ones; ``none`` where none does."""
    scores = [(k, pattern_score(c, ps)) for k, ps in kinds]
    top = F.greatest(*[s for _, s in scores], F.lit(0))
    out = F.when(top == 0, none)
    for k, s in scores:
        out = out.when(s == top, k)
    return out


def complexity(question: Column, hard: list[str], easy: list[str], short: int = 12, long: int = 30) -> Column:
    """fast, balanced or quality: patterns of hard and easy questions vote, so do length and several question marks."""
    q = F.lower(trimmed(question))
    words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    h = pattern_score(q, hard) + (words >= long).cast("int") + (F.regexp_count(question, F.lit(r"\?")) >= 2).cast("int")
    e = pattern_score(q, easy) + (words <= short).cast("int")
    return F.when((h >= 2) | ((h == 1) & (e == 0)), "quality").when((e >= 2) | ((e >= 1) & (h == 0)), "fast").otherwise("balanced")


def first_rule(rules: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first condition that holds."""
    out = F.lit(otherwise)
    for cond, value in reversed(rules):
        out = F.when(cond, value).otherwise(out)
    return out


#: Bounds of authority labels.
LABELS = ((100, "Canon"), (90, "Quasi-canonical"), (78, "Prophetic"), (65, "Normative"), (57, "Correlated"), (45, "GA Official"), (35, "GA Unofficial"), (25, "Institutional"), (15, "Scholarly"), (10, "Historical"))
#: Factors of the setting and of consensus; boosts by importance; importance that a kind of question lowers.
CONTEXT = {"canon": 1.0, "general-conference": 1.0, "official-letter": 1.0, "stake-conference": 0.9, "devotional": 0.85, "book-official": 0.8, "book-unofficial": 0.7, "interview": 0.5}
CONSENSUS = {"fp-q12": 1.15, "first-presidency": 1.10, "individual": 1.0}
IMPORTANCE = {"imprescindible": 1.0, "importante": 0.7, "interesante": 0.4, "irrelevante": 0.0}
LOWERED = {("doctrinal", "interesante"): "irrelevante", ("soteriological", "importante"): "interesante", ("soteriological", "interesante"): "irrelevante"}


def authority_label(authority: Column) -> Column:
    return first_rule([(authority >= least, name) for least, name in LABELS], "Reference")


def effective_authority(authority: Column, context: Column, consensus: Column) -> Column:
    """Authority by setting and consensus; unknown ones count fully."""
    by = lambda c, d: first_rule([(c == k, v) for k, v in d.items()], 1.0)
    return authority.cast("double") * by(context, CONTEXT) * by(consensus, CONSENSUS)


def lowered_importance(importance: Column, kind: Column) -> Column:
    """Importance in view of the question's kind; it is never raised."""
    return F.coalesce(first_rule([((kind == k) & (importance == i), v) for (k, i), v in LOWERED.items()], None), importance)


def window_around(text: Column, name: Column, size: int = 200) -> Column:
    """Lower-case text of ``size`` characters on either side of a name's first mention, without markup and control characters; the
    whole text where the name isn't found."""
    at = F.instr(F.lower(text), F.lower(name))
    start = F.greatest(F.lit(1), at - size)
    part = F.when(at > 0, F.substring(text, start, at + F.length(name) + size - start)).otherwise(text)
    noise = r"(?is)[\x00-\x08\x0b\x0c\x0e-\x1f]|<[^>]{0,80}>|\{[^}]{0,80}\}|\[(?:footnote|fn|note)\s*\d*\]|&[a-z]{2,8};|[\x{200B}\x{A0}\x{FEFF}]"
    return F.regexp_replace(F.lower(part), noise, " ")


def concept_words(text: Column, least: int = 4) -> Column:
    """Capitalised words of a text that may name concepts, each once, in order, without stop words."""
    words = F.regexp_extract_all(text, F.lit(rf"\b\p{{Lu}}\p{{Ll}}{{{least - 1},}}\b"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~F.lower(w).isin(T.STOP_WORDS)))


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Cost of a model call, prices a million tokens."""
    return tokens_in / 1_000_000 * price_in + tokens_out / 1_000_000 * price_out


def url_verdict(url: Column, rules: list[tuple[str, str, list[str]]]) -> Column:
    """(category, reason) by ordered rules (category, reason, parts of a URL, one of which must occur; '=x' is the whole last part)."""
    last = F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), r"\.html$", "")
    hit = lambda p: last == p[1:] if p.startswith("=") else url.contains(p)
    out = F.struct(F.lit("UNCLASSIFIED").alias("category"), F.lit("needs-review").alias("reason"))
    for category, reason, parts in reversed(rules):
        out = F.when(reduce(lambda a, b: a | b, [hit(p) for p in parts]), F.struct(F.lit(category).alias("category"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


#: Tribute before an author's name.
TRIBUTE = r"(?i)^(?:by\s+|por\s+)?(?:(?:elder|élder|president|presidente|presidenta|sister|hermana|brother|hermano|bishop|obispo|dr|prof)\.?\s+)+"


def author_key(name: Column) -> Column:
    """'Last, First' turned round, without tribute, accents, dots and years: the key under which writings of an author meet."""
    s = F.regexp_replace(F.regexp_replace(trimmed(name), TRIBUTE, ""), r"\s*[(\[]?\d{4}.*$", "")
    s = F.when(s.rlike(r"^[^,]+,\s*[^,]+$"), F.concat_ws(" ", F.regexp_extract(s, r",\s*(.+)$", 1), F.regexp_extract(s, "^([^,]+),", 1))).otherwise(s)
    return T.normalised(s)


def unwrapped(text: Column) -> Column:
    """Hard-wrapped lines flow together: a single line break becomes a blank, blank lines stay; a word divided by a hyphen is joined."""
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?<=\p{Ll})-\n(?=\p{Ll})", "")
    t = F.regexp_replace(t, r"[ \t]*\n[ \t]*(?!\s)(?<!\n[ \t]{0,20}\n[ \t]{0,20})", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]*(?:\n[ \t]*)+", "\n\n"), "[ \t]{2,}", " "))


def without_boilerplate(text: Column) -> Column:
    """What stands between a library's start and end marks, without transcriber's notes and a trailing index."""
    t = F.regexp_replace(text, r"(?is)^.*?\*\*\*\s*START OF [^\n]*\n", "")
    t = F.regexp_replace(t, r"(?is)\*\*\*\s*END OF .*$", "")
    t = F.regexp_replace(t, r"(?is)\[Transcriber[’']?s?[’']? notes?[^\]]*\]", "")
    t = F.regexp_replace(t, r"(?im)^Transcriber[’']?s?[’']? notes?[^\n]*(?:\n(?!\s*\n)[^\n]+)*", "")
    return trimmed(F.regexp_replace(t, r"(?s)\n\s*INDEX\s*\n.*$", ""))


def footnotes(text: Column) -> Column:
    """The bracketed footnotes of a text: [(mark, note)], in order."""
    p = F.lit(r"\[(?:Footnote\s+)?(\d{1,4}|[*†‡]):?\s+([^\]]+)\]")
    return F.arrays_zip(F.regexp_extract_all(text, p, F.lit(1)).alias("mark"), F.transform(F.regexp_extract_all(text, p, F.lit(2)), lambda n: F.regexp_replace(n, r"\s+", " ")).alias("note"))


def without_footnotes(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s*\[(?:Footnote\s+)?(?:\d{1,4}|[*†‡]):?\s+[^\]]+\]", ""), r"(?<=\S)\[\d{1,4}\]", "")


def without_page_artefacts(text: Column, running: list[str] = ()) -> Column:
    """Text taken from a printed page's file: lines that are only a page number or one of the ``running`` titles go, form feeds are line breaks, words
    divided at a line's end are joined, ligatures are letters again."""
    t = F.replace(text, F.lit("\f"), F.lit("\n"))
    for ligature, letters in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        t = F.replace(t, F.lit(ligature), F.lit(letters))
    t = F.regexp_replace(t, r"(?m)^[ \t]*[-–—]?[ \t]*(?:\d{1,4}|[ivxlc]{1,7})[ \t]*[-–—]?[ \t]*$\n?", "")
    for title in running:
        t = F.regexp_replace(t, r"(?im)^[ \t]*(?:\d{1,4}[ \t]+)?\Q" + title + r"\E(?:[ \t]+\d{1,4})?[ \t]*$\n?", "")
    return unwrapped(t)
