"""Repair of text from scanned pages: divided words, misread letters, running headers and page numbers, reflow."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekiln.session import cut

#: Fixed values. Marks that scanning puts into words; hyphens that divide a word at a line's end.
SPECKS = r"|·~^*•¦_`°¨"
#: Fixed values. Thin blanks that tear a word apart.
THIN = r"\x{2009}\x{200A}\x{200B}\x{202F}"
HYPHENS = r"-‐‑¬–­"
#: Fixed values. Letters and figures that are mistaken for each other, first those of one glyph (from, to), then glyphs that look
#: like two. Everything is spelled out to strokes, so that it doesn't matter where the pairs lie.
ACCENTS = ("áàâãäåéèêëíìîïóòôõöúùûüçñý", "aaaaaaeeeeiiiiooooouuuucny")
ONE_GLYPH = ("0@4569!1jlcfsq8", "oaatogiiiiettgb")
TWO_GLYPHS = (("m", "rn"), ("n", "ri"), ("d", "ei"), ("u", "ii"), ("h", "ii"), ("b", "ii"), ("w", "vv"))
ROMAN = r"(?:[ivxlc]{1,8}|[IVXLC]{1,8})"
PAGE_WORDS = ("p", "pp", "pg", "pag", "page", "pagina", "folio", "fol")
TERMINAL = r"[.?!…:;,][\"'”»›’)\]]*$"
DIVIDED = rf"\p{{L}}\p{{M}}*[{SPECKS}]?[{HYPHENS}]$"
CHAPTER = r"(?iu)^\s*(?:chapter|cap[ií]tulo|chapitre|part|parte|book|libro|livre|section|secci[oó]n)\s+(?:[ivxlc]+|\d+)\s*$"
#: A file counts as scanned where at least this part of its lines break off within a sentence, and a page shows besides: a word
#: divided at a line's end, a line that holds only a number, a number apart from a title, a title amid a sentence, or a mark inside
#: a word. Neither sign depends on the file's size.
BROKEN_LINES = 0.3
SIGN = (
    rf"\p{{Ll}}[{HYPHENS}][ \t]*\n[ \t]*\p{{Ll}}|\p{{L}}[{SPECKS}{THIN}]\p{{L}}|\p{{Ll}}[\p{{Lu}}0-9]\p{{Ll}}|[\p{{Ll}}\p{{N}},;][ \t]*\n\s*\p{{Lu}}[^.?!;:\n]{{2,80}}\n\s*\p{{Ll}}"
    r"|(?m)^[^\p{L}\p{N}\n]*(?:[Pp][.\p{L}]{0,5} ?)?[0-9lIOoSB]{0,2}[0-9][0-9lIOoSB]{0,2}[^\p{L}\p{N}\n]*$|^[ \t]*[0-9]{1,4}[ \t]{2,}\p{Lu}|\p{L}[ \t]{2,}[0-9]{1,4}[ \t]*$"
)
#: A title's first strokes by which its cut-off forms meet.
KEY_LENGTH = 14
#: The most frequent forms of all, which are certainly no misreadings: tokens of these are left out before a shuffle. It is a
#: bound on what the driver holds, not on the result.
COMMON = 2_000
#: Tables of so many rows at most are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def skeleton(c: Column) -> Column:
    """A word's strokes: words that differ by confusable glyphs only have the same."""
    s = F.regexp_replace(F.lower(c), rf"['’{SPECKS}{THIN}\x{{300}}-\x{{36F}}\x{{AD}}]", "")
    s = F.translate(F.translate(s, *ACCENTS), *ONE_GLYPH)
    return reduce(lambda a, p: F.replace(a, F.lit(p[0]), F.lit(p[1])), TWO_GLYPHS, s)


WORD = r"[^\s.,?!;:()«»“”\"¿¡…\[\]—]+"


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def _small(df: DataFrame) -> DataFrame:
    """A checkpointed table for a join: broadcast where its measured size allows it."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _form(w: Column) -> Column:
    """How a word counts in the vocabulary: without case, unless capitals stand within it."""
    odd = w.rlike(r"\p{Ll}\p{M}*\p{Lu}|\p{Lu}{2,}\p{Ll}|^\p{Lu}\p{Ll}*[-'’]?\p{Ll}*\p{Lu}\p{Lu}\p{Ll}")
    return F.when(w == F.lower(w), w).when(odd, w).otherwise(F.lower(w))


def scanned_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks (id, file, chunk_index, text) of scanned files; see BROKEN_LINES. A chunk without a file_path is a file of its own."""
    # all patterns begin at the line's end, which most offsets fail at once
    broken = rf"\n(?<=[\p{{L}}\p{{N}},;:)][{HYPHENS}]?[ \t]{{0,4}}\n)[ \t]*\p{{Ll}}"
    chunks = chunks.select("id", F.coalesce("file_path", F.concat(F.lit("\0"), F.col("id").cast("string"))).alias("file"), "chunk_index", "text").where("text is not null")
    per_chunk = chunks.select("file", "text", F.regexp_count("text", F.lit(broken)).alias("broken"), F.regexp_count("text", F.lit(r"\n\s*\S")).alias("ends"))
    per_file = per_chunk.groupBy("file").agg(F.sum("broken").alias("broken"), F.max(F.when(F.col("broken") > 0, F.col("text").rlike(SIGN)).otherwise(False)).alias("sign"), F.sum(F.col("ends") + 1).alias("lines"))
    scanned = cut(per_file.where(F.col("sign") & (F.col("broken") >= BROKEN_LINES * F.col("lines"))).select("file"))
    return chunks.join(_small(scanned), "file", "left_semi")


def _features(scanned: DataFrame) -> DataFrame:
    """Lines of scanned chunks with what each shows by itself."""
    rows = scanned.select("id", "file", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line")).withColumn("l", F.regexp_replace("line", r"^[\s\x{A0}\x{2000}-\x{200B}]+|[\s\x{A0}\x{2000}-\x{200B}]+$", ""))
    digits = r"[0-9lIOoSB|]{0,3}[0-9][0-9lIOoSB|]{0,3}"
    number = rf"(?:{digits}|{ROMAN})"
    edge = r"[^\p{L}\p{N}.,;:?!]*"
    few = F.length("l") <= 40
    bare = few & F.col("l").rlike(rf"^{edge}{number}{edge}$")
    worded = few & F.col("l").rlike(rf"^{edge}[\p{{L}}@0-9]{{1,7}}[.]?\s*{digits}{edge}$") & skeleton(F.regexp_extract("l", rf"^{edge}([\p{{L}}@0-9]{{1,7}}?)[.]?\s*{digits}{edge}$", 1)).isin([_skeleton_of(w) for w in PAGE_WORDS])
    rows = rows.withColumn("blank", F.col("l") == "").withColumn("only_number", bare | worded)
    gap = r"(?:[ \t\x{A0}]{2,}|[ \t]*[|·•][ \t]*)"
    mark = rf"(?:[\[(·|–-][ ]?)?(?:p\.|pp\.|p[aá]g\.|[Pp]age|P[aá]gina)?[ ]?{number}(?:[ ]?[\])·|–-])?"
    lead, tail = rf"^{mark}{gap}(?=\p{{L}})", rf"(?<=\p{{L}}){gap}{mark}$"
    has_number = (F.col("l").rlike(lead) | F.col("l").rlike(tail)) & ~F.col("only_number")
    rows = rows.withColumn("has_number", has_number)
    title = F.when(F.col("has_number"), F.regexp_replace(F.regexp_replace("l", tail, ""), lead, "")).otherwise(F.col("l"))
    spaced = title.rlike(r"^\S(?: {1,2}\S)+(?: {2,}\S(?: {1,2}\S)*)*$") & title.rlike(r"^\S \S \S|^\S\s{2,}\S \S")
    return rows.withColumn("spaced", spaced & ~F.col("only_number")).withColumn("title", F.when(F.col("spaced"), F.regexp_replace(F.regexp_replace(F.regexp_replace(title, r" {2,}", "\x01"), " ", ""), "\x01", " ")).otherwise(title))


def lines_of(scanned: DataFrame) -> DataFrame:
    """Lines of scanned chunks with what is on them: (id, line_no, l, blank, is_header, is_number, body, divided, continues,
    next_body, prev_body, w, before).

    A running header has the shape of a title, and the page shows that it is none of the author's: its letters, figures masked and
    glyphs as strokes, come again in the file or run through other scanned files, or a page number is on the line or beside it, or
    it stands between two parts of one sentence. A title that occurs once between finished sentences is the author's. Windows run within a chunk; what its first and
    last lines continue comes from the neighbouring chunks of the file, by their index.
    """
    rows = cut(_features(scanned))  # else the expressions are repeated in each that follows
    letters = F.regexp_replace("title", r"[^\p{L}]", "")
    upper = F.length(F.regexp_replace(letters, r"\P{Lu}", ""))
    shape = (~F.col("blank")) & (~F.col("only_number")) & (F.length("l") <= 120) & (~F.col("title").rlike(TERMINAL)) & F.col("title").rlike(r"^[\p{Lu}0-9@]|^\S?\p{Lu}") & (F.length(letters) >= 3) & (~F.col("title").rlike(CHAPTER)) & (~F.col("title").rlike(rf"[{HYPHENS}]$"))
    capitals = (F.length(letters) >= 5) & (upper >= 0.8 * F.length(letters))
    titled = F.col("title").rlike(r"^(?:[\p{Lu}][^\s]*\s+){2,}[\p{Lu}][^\s]*$")
    rows = rows.withColumn("shape", shape).withColumn("strong", F.col("shape") & (F.col("spaced") | F.col("has_number") | capitals | titled | F.col("line").rlike(r"^[ \t]{4,}\S")))
    down, up = Window.partitionBy("id").orderBy("line_no"), Window.partitionBy("id").orderBy(F.desc("line_no"))
    past = (Window.unboundedPreceding, -1)
    plain = F.when(~F.col("blank") & ~F.col("only_number") & ~F.col("strong"), F.col("l"))
    rows = rows.withColumn("prev_plain", F.last(plain, ignorenulls=True).over(down.rowsBetween(*past))).withColumn("number_before", F.lag("only_number").over(down)).withColumn("blank_before", F.lag("blank").over(down))
    rows = rows.withColumn("next_plain", F.last(plain, ignorenulls=True).over(up.rowsBetween(*past))).withColumn("number_after", F.lag("only_number").over(up)).withColumn("blank_after", F.lag("blank").over(up))
    within = F.col("prev_plain").isNotNull() & F.col("next_plain").isNotNull() & ~F.coalesce(F.col("prev_plain").rlike(r"[.?!…][\"'”»›’)\]]*$"), F.lit(True)) & F.col("next_plain").rlike(r"^[\p{Ll}0-9]")
    none = F.lit(False)
    rows = rows.withColumn("beside", F.coalesce("number_before", none) | F.coalesce("number_after", none)).withColumn("within", within).withColumn("alone", F.coalesce("blank_before", F.lit(True)) | F.coalesce("blank_after", F.lit(True)))
    rows = rows.withColumn("first_word", F.length(F.regexp_extract(F.coalesce("next_plain", F.lit("")), r"^\S*", 0)))
    rows = cut(rows.select("id", "file", "line_no", "l", "blank", "only_number", "has_number", "title", "shape", "strong", "beside", "within", "alone", "first_word"))
    # the file's width counts its plain lines; titles are few, so only they meet it
    width = rows.where("not blank and not only_number and not strong").groupBy("file").agg(F.percentile_approx(F.length("l"), 0.9).alias("width"))
    titles = rows.where("shape").withColumn("key", F.substring(skeleton(F.regexp_replace(F.regexp_replace("title", r"\d", "9"), r"[^\p{L}\p{N}]+", "")), 1, KEY_LENGTH)).join(width, "file", "left")
    weak = ~F.col("strong") & F.coalesce(F.length("l") + 1 + F.col("first_word") <= F.col("width") - 1, F.lit(False)) & (F.length("title") <= 60)
    titles = titles.withColumn("weak", weak).where("strong or weak").withColumn("shown", (F.col("beside") | F.col("within") | F.col("has_number")).cast("int"))
    seen = titles.groupBy("file", "key").agg(F.count("*").alias("n"), F.sum("shown").alias("n_shown"), F.count_if("strong").alias("n_strong"))
    titles = cut(titles.join(seen, ["file", "key"]))
    header = (F.col("shown") == 1) | (F.col("strong") & (F.col("n") >= 2)) | (F.col("weak") & ((F.col("n_shown") + F.col("n_strong") >= 2) | ((F.col("n_shown") + F.col("n_strong") >= 1) & F.col("alone"))))
    titles = titles.withColumn("header", F.coalesce(header, none))
    elsewhere = titles.where("header and n_shown > 0").groupBy("key").agg(F.countDistinct("file").alias("files")).where("files > 1").select("key")
    again = titles.where("strong and not header").join(elsewhere, "key", "left_semi")
    headers = titles.where("header").select("id", "line_no").unionByName(again.select("id", "line_no")).groupBy("id").agg(F.collect_set("line_no").alias("headers"))  # the lines of a chunk
    rows = rows.join(headers, "id", "left").withColumn("is_header", F.coalesce(F.array_contains("headers", F.col("line_no")), none))
    rows = rows.withColumn("is_number", F.col("only_number") | (F.col("has_number") & F.col("is_header"))).withColumn("body", ~F.col("blank") & ~F.col("is_header") & ~F.col("is_number"))
    b = F.when(F.col("body"), F.col("l"))
    rows = rows.withColumn("prev_body", F.last(b, ignorenulls=True).over(down.rowsBetween(*past))).withColumn("next_body", F.last(b, ignorenulls=True).over(up.rowsBetween(*past)))
    rows = cut(rows.select("id", "line_no", "l", "blank", "is_header", "is_number", "body", "prev_body", "next_body"))
    # what a chunk's last line goes on with stands in the file's next chunk, unless the chunks overlap
    ends = rows.where("body and (prev_body is null or next_body is null)").groupBy("id").agg(F.max(F.when(F.col("prev_body").isNull(), F.col("l"))).alias("first"), F.max(F.when(F.col("next_body").isNull(), F.col("l"))).alias("last"))
    ends = ends.join(scanned.select("id", "file", "chunk_index").where("chunk_index is not null"), "id")
    one = ends.groupBy("file", "chunk_index").agg(F.min_by(F.struct("first", "last"), "id").alias("e"))
    goes_on = F.col("a.e.last").rlike(DIVIDED) & F.col("b.e.first").rlike(r"^\p{Ll}")
    across = one.alias("a").join(one.withColumn("chunk_index", F.col("chunk_index") - 1).alias("b"), ["file", "chunk_index"]).where(goes_on).select("file", "chunk_index", F.col("a.e.last").alias("last"), F.col("b.e.first").alias("first"))
    into = ends.join(across, ["file", "chunk_index", "last"]).select("id", across["first"].alias("after_chunk"))
    onto = ends.join(across.withColumn("chunk_index", F.col("chunk_index") + 1), ["file", "chunk_index", "first"]).select("id", across["last"].alias("before_chunk"))
    borders = into.join(onto, "id", "full").groupBy("id").agg(F.max("after_chunk").alias("after_chunk"), F.max("before_chunk").alias("before_chunk"))
    rows = rows.join(borders, "id", "left").withColumn("next_body", F.when(F.col("body"), F.coalesce("next_body", "after_chunk")).otherwise(F.col("next_body"))).withColumn("prev_body", F.when(F.col("body"), F.coalesce("prev_body", "before_chunk")).otherwise(F.col("prev_body")))
    rows = rows.withColumn("divided", F.col("body") & F.col("l").rlike(DIVIDED) & F.coalesce(F.col("next_body").rlike(r"^[^\s\p{N}]*\p{L}"), F.lit(True)))
    rows = rows.withColumn("continues", F.coalesce(F.col("body") & F.col("prev_body").rlike(DIVIDED), none)).drop("after_chunk", "before_chunk")
    # a body line's words, and the word before them: taken once here, as they are gone through several times
    return rows.withColumn("w", F.when(F.col("body"), _words(F.regexp_replace("l", rf"[{HYPHENS}]$", "")))).withColumn("before", F.when(F.col("body"), F.element_at(_words(F.right("prev_body", F.lit(40))), -1)))


def _skeleton_of(w: str) -> str:
    """``skeleton`` of a plain word, for literals."""
    s = w.translate(str.maketrans(ACCENTS[0], ACCENTS[1])).translate(str.maketrans(ONE_GLYPH[0], ONE_GLYPH[1]))
    return reduce(lambda a, p: a.replace(*p), TWO_GLYPHS, s)


def tokens_of(lines: DataFrame, common: list[str] = ()) -> DataFrame:
    """Words of body lines where they begin: (id, line_no, pos, word, whole, hyphened, form, follows, precedes). A divided word is
    given whole: ``word`` is its part on the line, ``whole`` both parts without the hyphen, ``hyphened`` with it. Words of ``common`` before
    another such word are left out before anything is made of them, but at a line's end."""
    w = lines.where("body")
    words = F.transform("w", lambda x, i: F.struct(i.cast("int").alias("pos"), x.alias("word"), F.get("w", i + 1).alias("follows"), F.when(i == 0, F.col("before")).otherwise(F.get("w", i - 1)).alias("precedes")))
    if common:
        every = [*common, *(c.capitalize() for c in common)]
        words = F.filter(words, lambda x: ~x["word"].isin(every) | ~F.coalesce(x["follows"].isin(every), F.lit(False)))
    body = w.select("id", "line_no", "divided", "continues", "next_body", (F.size("w") - 1).alias("end"), F.explode_outer(words).alias("x")).where("x is not null").select("id", "line_no", "divided", "continues", "next_body", "end", "x.*")
    rest = F.regexp_extract("next_body", rf"^{WORD}", 0)
    last = F.col("divided") & (F.col("pos") == F.col("end"))
    body = body.where(~(F.col("continues") & (F.col("pos") == 0))).where(~(last & F.col("next_body").isNull()))
    whole = F.when(last, F.concat("word", rest)).otherwise(F.col("word"))
    body = body.select("id", "line_no", "pos", "word", whole.alias("whole"), F.when(last, F.concat("word", F.lit("-"), rest)).alias("hyphened"), "follows", F.lower("precedes").alias("precedes"))
    return body.where(F.col("whole").rlike(r"\p{L}")).withColumn("form", _form(F.col("whole")))


#: Different words that a task counts before it hands them on.
COUNTED = 500_000
_APART = dict.fromkeys(map(ord, ".,?!;:()«»“”\"¿¡…[]—"), " ")


def _counted(texts: DataFrame) -> DataFrame:
    """(w, n): the words of texts and how often a task met them; a word may come several times. Counting where the text is read,
    without a row for each word, takes a fifth of the time of an explode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()

        def words() -> pa.RecordBatch:
            own: Counter[str] = Counter()
            for w, k in n.items():
                for part in w.decode().translate(_APART).split(" "):
                    own[part] += k
            return pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["w", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                n.update(t.split())  # bytes part at ASCII blanks only
            if len(n) > COUNTED:
                yield words()
                n.clear()
        yield words()

    return texts.where("text is not null").select(F.col("text").cast("binary")).mapInArrow(run, "w string, n long")


def word_counts(chunks: DataFrame, scanned: DataFrame, tokens: DataFrame) -> DataFrame:
    """(form, n_clean, n_scan, k, total) over all chunks: how often files that weren't scanned have a form, how often scanned ones
    do, and its strokes. Unscanned counts are those of all texts less those of the scanned ones."""
    zero = F.lit(0).cast("long")
    every = _counted(chunks).select("w", F.col("n").alias("n_clean"), zero.alias("n_scan"), zero.alias("n_div"))
    raw = _counted(scanned).select("w", (-F.col("n")).alias("n_clean"), zero.alias("n_scan"), zero.alias("n_div"))
    own = tokens.select(F.col("whole").alias("w"), zero.alias("n_clean"), F.when(F.col("hyphened").isNull(), 1).otherwise(0).cast("long").alias("n_scan"), F.when(F.col("hyphened").isNull(), 0).otherwise(1).cast("long").alias("n_div"))
    total = [F.sum(c).alias(c) for c in ("n_clean", "n_scan", "n_div")]
    words = every.unionByName(raw).unionByName(own).groupBy("w").agg(*total).where(F.col("w").rlike(r"\p{L}"))
    counts = words.groupBy(_form(F.col("w")).alias("form")).agg(*total).where("n_clean + n_scan + n_div > 0")
    return cut(counts.select("form", "n_clean", "n_scan", skeleton(F.col("form")).alias("k"), (F.col("n_clean") + F.col("n_scan")).alias("total")))


def misread_forms(counts: DataFrame) -> DataFrame:
    """(form, better, k): forms of scanned files that a far more frequent form of the same strokes explains.

    A form that unscanned files know in proportion is a word of its own; a form with specks or with capitals inside needs only a
    known reading.
    """
    speck = F.col("form").rlike(rf"[{SPECKS}@]|\p{{L}}\d|\d\p{{L}}")
    odd = speck | F.col("form").rlike(f"[{THIN}]") | (F.col("form") != F.lower("form"))
    best = F.max(F.when(~F.col("odd"), F.struct("n_clean", "n_scan", "form"))).over(Window.partitionBy("k"))
    both = counts.withColumn("odd", odd).withColumn("m", best).withColumn("better", F.col("m.form")).withColumn("top", F.col("m.n_clean") + F.col("m.n_scan"))
    odd, rare = F.col("odd"), F.col("n_clean") * 2 <= F.col("n_scan")
    known = F.col("better").isNotNull() & (F.col("better") != F.col("form"))
    wrong = (odd & rare & F.col("form").rlike(rf"[{SPECKS}]") & F.col("form").rlike(r"\p{L}")) | (odd & known & rare & (F.col("top") >= 3)) | (~odd & known & rare & (F.col("top") >= 10 * F.greatest(F.lit(1), F.col("total"))) & (F.col("top") >= 10))
    return cut(both.where(wrong & ~F.col("form").rlike(r"^[ivxlcdm]+$")).select("form", F.when(known, F.col("better")).otherwise(F.regexp_replace(F.lower("form"), rf"[{SPECKS}{THIN}]", "")).alias("better"), "k"))


PLACE = ["id", "line_no", "pos"]


def torn_words(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, line_no, pos, mended): a word torn in two by a blank, at its first part: together the parts are a known word, while
    one of them is hardly a word in files that weren't scanned."""
    pairs = tokens.where("hyphened is null and follows is not null").select(*PLACE, F.explode(F.array("form", F.lower("follows"))).alias("form"), F.lower(F.concat("whole", "follows")).alias("mended"))
    known = counts.where("n_clean >= 3").select(F.col("form").alias("mended"))
    stray = counts.where("n_clean * 2 <= n_scan").select("form")
    return pairs.join(known, "mended", "left_semi").join(stray, "form", "left_semi").select(*PLACE, "mended").distinct()


def analysed(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lines, found, counts, tokens): the lines of scanned files, and of their tokens those that need repair: misread ones have a
    reading ``better``, those of which a torn word begins ``mended``, divided ones ``hyphened``; the counts of all forms."""
    scanned = cut(scanned_chunks(chunks))
    lines = cut(lines_of(scanned))
    tokens = tokens_of(lines)
    counts = word_counts(chunks, scanned, tokens)
    wrong = misread_forms(counts)
    # the most frequent forms of all, neither misread nor stray, meet none of the tables below: tokens of these, most of all, are
    # left out, but for those before another word
    frequent = counts.join(wrong, "form", "left_anti").where("n_clean * 2 > n_scan").orderBy(F.desc("total"), "form").limit(COMMON)
    common = [r["form"] for r in frequent.select("form").collect()]
    seldom = cut(tokens_of(lines, common))
    misread = seldom.join(wrong.select("form", "better", "k"), "form").select(*PLACE, "better", "k")
    # a compound divided at its own hyphen is a known word, whatever its joined letters look like
    kept = counts.where("total >= 2 and form like '%-%'").select(F.col("form").alias("compound_form"))
    compound = seldom.where("hyphened is not null").select(*PLACE, F.lower("hyphened").alias("compound_form")).join(kept, "compound_form", "left_semi").select(*PLACE, F.lit(True).alias("compound"))
    marks = [misread.select(*PLACE, "better", "k", F.lit(None).cast("boolean").alias("compound"), F.lit(None).cast("string").alias("mended"))]
    marks.append(compound.select(*PLACE, F.lit(None).cast("string").alias("better"), F.lit(None).cast("string").alias("k"), "compound", F.lit(None).cast("string").alias("mended")))
    marks.append(torn_words(seldom, counts).select(*PLACE, F.lit(None).cast("string").alias("better"), F.lit(None).cast("string").alias("k"), F.lit(None).cast("boolean").alias("compound"), "mended"))
    marks = reduce(DataFrame.unionByName, marks).groupBy(*PLACE).agg(*[F.max(c).alias(c) for c in ("better", "k", "compound", "mended")])
    found = seldom.join(marks, PLACE, "left").where("better is not null or mended is not null or hyphened is not null")
    return lines, found.withColumn("compound", F.coalesce("compound", F.lit(False))).withColumn("better", F.when(~F.col("compound"), F.col("better"))), counts, tokens


def with_readings(found: DataFrame, counts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Misread tokens with the reading that the context supports: among several of the same strokes the one most often found after
    the same word, then the most frequent."""
    found = cut(found)
    readings = counts.where("n_clean >= 3").select("k", F.col("form").alias("reading"), "n_clean").join(found.where("better is not null").select("k").distinct(), "k", "left_semi")
    several = cut(readings.join(readings.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "k", "left_semi"))
    context = tokens.where("hyphened is null and precedes is not null").select("precedes", F.col("form").alias("reading")).join(_small(several.select("reading").distinct()), "reading", "left_semi").groupBy("precedes", "reading").agg(F.count("*").alias("n"))
    some = found.where("better is not null").select(*PLACE, "precedes", "k").join(several, "k").join(context, ["precedes", "reading"], "left")
    chosen = some.groupBy(*PLACE).agg(F.max_by("reading", F.struct(F.coalesce("n", F.lit(0)), "n_clean", "reading")).alias("reading"))
    return found.join(chosen, PLACE, "left").withColumn("better", F.when(F.col("better").isNotNull(), F.coalesce("reading", "better"))).drop("reading")


def defects(chunks: DataFrame) -> DataFrame:
    """(chunk_id, line_no, defect) of every scanned line; see the problem's statement. Null texts and files that weren't scanned
    give none; repeated chunk ids give one row; an empty table gives no rows."""
    lines, tokens, _, _ = analysed(chunks)
    of = lambda d, name: d.select(F.col("id").alias("chunk_id"), "line_no", F.lit(name).alias("defect"))
    parts = [of(lines.where("divided"), "hyphen"), of(lines.where("is_header"), "header"), of(lines.where("is_number"), "page_number"), of(tokens.where("better is not null or mended is not null"), "misread")]
    return reduce(DataFrame.unionByName, parts).distinct()


def _cased(better: Column, word: Column) -> Column:
    first = F.upper(F.substring(better, 1, 1))
    return F.when(word.rlike(r"^\p{Lu}"), F.concat(first, F.expr("substring(better, 2)"))).otherwise(better)


def repaired(chunks: DataFrame) -> DataFrame:
    """(chunk_id, paragraph_no, text): scanned chunks as continuous paragraphs.

    Headers and page numbers go; misread words take their better reading; a divided word is joined, with its hyphen where the
    compound is known elsewhere; lines flow together until a blank line that no sentence runs across.
    """
    lines, found, counts, every = analysed(chunks)
    tokens = with_readings(found, counts, every)
    fixes = tokens.where("better is not null or hyphened is not null or mended is not null").groupBy("id", "line_no").agg(F.collect_list(F.struct(F.when(F.col("mended").isNotNull(), F.concat("word", F.lit(" "), "follows")).otherwise(F.col("word")).alias("a"), F.when(F.col("mended").isNotNull(), F.concat("word", "follows")).when(F.col("better").isNotNull(), _cased(F.col("better"), F.col("word"))).alias("b"), F.col("hyphened").isNotNull().alias("last"), F.col("whole").alias("whole"), F.col("compound").alias("compound"))).alias("fixes"))
    body = lines.where("body").join(fixes, ["id", "line_no"], "left")
    # within the line each misread word is replaced; at its end the divided word is completed, and cut from the next line
    start = F.when(F.col("continues"), F.regexp_replace("l", rf"^{WORD}", "")).otherwise(F.col("l"))
    body = body.withColumn("t", start).withColumn("t", F.expr(rf"""aggregate(coalesce(fixes, array()), t, (t, f) -> CASE
        WHEN f.last THEN concat(regexp_replace(t, '\\S+[{HYPHENS}]$', ''), coalesce(f.b, if(f.compound, concat(f.a, '-', substring(f.whole, length(f.a) + 1)), f.whole)))
        ELSE replace(t, f.a, f.b) END)"""))
    w = Window.partitionBy("id").orderBy("line_no")
    starts = F.when(F.lag("line_no").over(w).isNull(), 1).when((F.col("line_no") - F.lag("line_no").over(w) > 1) & F.col("prev_body").rlike(r"[.?!…:][\"'”»›’)\]]*$|^[\p{Lu}\s\d]+$") & ~F.col("l").rlike(r"^\p{Ll}"), 1).otherwise(0)
    body = body.withColumn("starts", starts).withColumn("paragraph_no", (F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "t"))), lambda x: x["t"]), " ")
    return body.groupBy(F.col("id").alias("chunk_id"), "paragraph_no").agg(F.regexp_replace(F.trim(text), r"\s+([.,;:?!)»”])|\s+", "$1 ").alias("text")).withColumn("text", F.trim(F.regexp_replace("text", r" +", " ")))
