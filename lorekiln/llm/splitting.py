"""Splitting oversized items at natural boundaries by bounded regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekiln.session import cut

#: White space with the blanks that Java's \s lacks.
WS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
OPEN = r"[\"'“«‹‘(\[¿¡]"
CLOSE = r"[\"'”»›’)\]]"
#: Abbreviations whose full stop ends no sentence; single letters are handled by the pattern.
ABBREVIATIONS = (
    "Dr Dra Mr Mrs Ms Sr Sra Srta St Sta Sto Ste Sts Prof Rev Hno Hna Mme Mlle Fr Bro Jr Lic Gen Col Capt Mt Ave Avda "
    "No Nos núm núms nº n° cap caps chap chaps ch chs cf vv vol vols pág págs pag pp fig figs art arts sec ed eds trad vs "
    "ej ex etc approx ca esp tel Tel Apt"
).split()
_ABBREVIATED = rf"(?<!(?<!\p{{L}})(?:{'|'.join(ABBREVIATIONS)}|\p{{L}})\.{WS}{{0,3}})"
#: A mark that begins a unit at the start of a line: heading, numbered verse, list item.
MARK = r"(?:#{1,6}[ \t]|\d{1,3}(?:\.\d{1,3}){0,3}[.)]?[ \t]{1,4}[^\s\d]|[-*•–—+·][ \t]|\([A-Za-z0-9]{1,3}\)[ \t]|[a-z][.)][ \t])"
#: Before a unit that opens a paragraph or a marked line, or that follows a heading's line.
LINE = (
    rf"(?:(?<=\n[ \t]{{0,4}})(?={MARK})"
    rf"|(?<=\n{WS}{{0,4}}\n{WS}{{0,4}})(?!{WS})"
    rf"|(?<=(?:^|\n)(?:#{{1,6}}[ \t]|\d{{1,3}}\.\d{{1,3}}[ \t])[^\n?!]{{1,160}}\r?\n[ \t]{{0,4}})(?!{WS}))"
)
#: Before a sentence: a stop with its closing marks, then perhaps white space, then a capital, perhaps after opening marks.
#: No sentence begins after an abbreviation, an initial, an ellipsis or a list number.
SENTENCE = (
    rf"(?:(?<=[.?!]{CLOSE}{{0,3}}{WS}{{0,4}})(?=(?:[-–—/]{WS}{{1,2}})?{OPEN}{{0,3}}\p{{Lu}})"
    rf"{_ABBREVIATED}(?<!(?:\.\.|…){CLOSE}{{0,2}}{WS}{{0,3}})(?<!(?:^|\n)[ \t]{{0,4}}\d{{1,3}}\.[ \t]{{1,3}}))"
)
#: What any start of a unit has: something but white space after white space, a stop or a closing mark. Most offsets fail here.
_AT_START = rf"(?<=[.?!\"'”»›’)\]\s\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200B}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}])(?!{WS})"
LINE, SENTENCE = rf"(?:{_AT_START}{LINE})", rf"(?:{_AT_START}{SENTENCE})"
UNIT = rf"(?:{_AT_START}(?:{LINE}|{SENTENCE}))"
MARK_CHARACTER = "\x01"
#: Prefix sums run in blocks of so many items, so that a text of n units costs n times this at most, not n squared.
BLOCK = 256


def marked(text: Column) -> Column:
    """The text with a mark before each natural unit but the first. U+0001 of the text itself is masked to U+0002 beforehand, which
    keeps every offset; only lengths are taken from the marked text, never characters."""
    return F.regexp_replace(F.regexp_replace(text, MARK_CHARACTER, "\x02"), rf"(?<!^){UNIT}", MARK_CHARACTER)


def piece_pattern(limit: int) -> str:
    """Bounded alternatives over a marked text by strength of what follows: all that is left, up to a line's unit, up to any unit, up
    to a unit however early, after white space, and at last any character. Marks count, so a piece is shorter by its units."""
    half = max(1, limit // 2)
    mark = MARK_CHARACTER
    return rf"(?s)(?:.{{1,{limit}}}\z|.{{{half},{limit}}}(?<=\n[ \t]{{0,4}})(?={mark})|.{{{half},{limit}}}(?={mark})|.{{1,{limit}}}(?={mark})|.{{1,{limit}}}(?<={WS})|.{{1,{limit}}})"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named: expressions within a lambda are evaluated anew for each
    item otherwise."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before(lengths: Column) -> Column:
    """For each of an array's numbers the sum of those before it."""
    none = F.array().cast("array<int>")

    def sums(xs: Column, start: Column) -> Column:
        step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(xs, F.struct(start.cast("int").alias("at"), none.alias("out")), step, lambda a: a["out"])

    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, n: a + n)
    blocks = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))
    whole = lambda xs: _let(blocks(xs), lambda bs: F.flatten(F.zip_with(bs, sums(F.transform(bs, total), F.lit(0)), sums)))
    return _let(lengths, lambda xs: F.when(F.size(xs) == 0, none).when(F.size(xs) <= BLOCK, sums(xs, F.lit(0))).otherwise(whole(xs)))


def pieces(text: Column, max_size: int, overlap: int, whole_units: bool = True) -> Column:
    """Pieces of one text as an array of (piece_no, piece_start, piece_end, unit_starts).

    The extraction's cuts, each piece after the first beginning ``overlap`` code points before its cut (or at the piece before, if
    that is shorter); ``unit_starts`` are the offsets in the text of the natural units that begin at or after the cut, the first
    one of a text at 0. A text within the limit is one piece; an empty one too; null gives null. ``whole_units`` false leaves
    out the units of texts within the limit.
    """
    size = lambda p: F.length(F.replace(p, F.lit(MARK_CHARACTER), F.lit("")))

    def placed(found: Column) -> Column:
        return _let(F.transform(found, size), lambda ns: F.transform(F.arrays_zip(found.alias("p"), ns.alias("n"), before(ns).alias("at"), F.concat(F.array(F.lit(0)), ns).alias("last")), piece))

    def piece(p: Column, i: Column) -> Column:
        # what stands before a piece's first mark belongs to a unit of the piece before; at the text's start it is a unit
        starts = F.transform(before(F.transform(F.split(p["p"], MARK_CHARACTER), lambda u: F.length(u))), lambda x: x + p["at"])
        starts = _let(starts, lambda s: F.when(i == 0, s).otherwise(F.slice(s, 2, F.greatest(F.lit(1), F.size(s)))))
        return F.struct(i.cast("int").alias("piece_no"), (p["at"] - F.least(F.lit(overlap), p["last"])).cast("int").alias("piece_start"), (p["at"] + p["n"]).cast("int").alias("piece_end"), starts.alias("unit_starts"))

    found = lambda m: F.when(F.length(text) <= max_size, F.array(m)).otherwise(F.regexp_extract_all(m, F.lit(piece_pattern(max_size - overlap)), F.lit(0)))
    # the pieces are those before the zipped array's end: ``last`` is one longer
    many = F.filter(_let(_let(marked(text), found), placed), lambda q: q["piece_end"].isNotNull())
    if whole_units:
        return many
    one = F.struct(F.lit(0).alias("piece_no"), F.lit(0).alias("piece_start"), F.length(text).alias("piece_end"), F.lit(None).cast("array<int>").alias("unit_starts"))
    return F.when(F.length(text) <= max_size, F.array(one)).otherwise(many)


def split_chunks(chunks: DataFrame, max_size: int, overlap: int, bucket: int = 256) -> DataFrame:
    """All chunks with oversized ones divided: (chunk_id, file_path, chunk_index, piece_no, start_char, end_char, text).

    chunk_index counts the pieces of a file in order (copies of a chunk share its numbers); it is a two-level prefix sum over
    buckets of old indexes, so that no task orders a whole large file. A chunk without an old index comes after those of its file
    that have one, by id; a chunk without a file_path is a file of its own. start_char and end_char are the old start plus the
    piece's offsets; where the old start is missing or negative they count from the chunk's own text. Null texts give no piece.
    """
    divided = chunks.where("text is not null").select(F.col("id").alias("chunk_id"), "file_path", F.col("chunk_index").alias("old_index"), "start_char", "text", pieces(F.col("text"), max_size, overlap, False).alias("p"))
    own = F.coalesce(F.col("chunk_id").cast("long"), F.xxhash64("text"))
    divided = divided.withColumn("file", F.coalesce("file_path", F.concat(F.lit("\0"), own.cast("string")))).withColumn("place", F.coalesce(F.col("old_index").cast("decimal(38,0)"), F.lit(1 << 62).cast("decimal(38,0)") + own))
    # counts by chunk are kept, as they are needed twice and the texts would be divided again for each
    per_index = cut(divided.groupBy("file", "place").agg(F.max(F.size("p")).alias("n")).withColumn("b", F.floor(F.col("place") / bucket)))
    per_bucket = per_index.groupBy("file", "b").agg(F.sum("n").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(Window.partitionBy("file").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    within = F.coalesce(F.sum("n").over(Window.partitionBy("file", "b").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = per_index.withColumn("within", within).join(per_bucket, ["file", "b"]).select("file", "place", (F.col("base") + F.col("within")).alias("first_index"))
    # an outer explode, as every text has a piece: for an inner one Spark would divide the texts once more to filter them
    out = divided.join(first, ["file", "place"]).withColumn("q", F.explode_outer("p"))
    origin = F.when(F.col("start_char") >= 0, F.col("start_char")).otherwise(0).cast("int")
    return out.select(
        "chunk_id", "file_path", (F.col("first_index") + F.col("q.piece_no")).cast("int").alias("chunk_index"), F.col("q.piece_no").alias("piece_no"), (origin + F.col("q.piece_start")).cast("int").alias("start_char"), (origin + F.col("q.piece_end")).cast("int").alias("end_char"),
        F.substring(F.col("text"), F.col("q.piece_start") + 1, F.col("q.piece_end") - F.col("q.piece_start")).alias("text"),
    )
