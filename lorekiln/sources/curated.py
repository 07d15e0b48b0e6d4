"""Curated files as tables: dictionaries, seeds, structures, cross-references; and exports of tables as files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.functions import text as T
from lorekiln.operators.graph import first_by

PARTY = "struct<name:string,type:string>"


def _whole(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, j): JSON files read whole and parsed; broken ones are left out, a missing path gives no rows."""
    try:
        files = spark.read.option("wholetext", True).text(path)
        rows = files.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", schema).alias("j"))
    except Exception as e:  # noqa: BLE001 - Spark has no class of its own for a missing path
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], f"file string, j {schema}")
    return rows.where("j is not null")


def gazetteer_file(spark: SparkSession, path: str) -> DataFrame:
    """(term, name, entity_type): a dictionary file {type: [{name, aliases}]} by normalised name and alias; of several entries of a term
    the first written stays, names before their aliases. Stop words are no terms."""
    j = _whole(spark, path, "map<string,array<struct<name:string,aliases:array<string>>>>")
    types = j.select("file", F.posexplode(F.map_entries("j")).alias("t", "e")).select("file", "t", F.col("e.key").alias("entity_type"), F.posexplode("e.value").alias("i", "x")).where("x.name is not null")
    labels = types.select("file", "t", "i", "entity_type", F.col("x.name").alias("name"), F.posexplode(F.concat(F.array("x.name"), F.coalesce("x.aliases", F.array().cast("array<string>")))).alias("k", "label"))
    terms = labels.withColumn("term", T.entity_name(F.col("label"))).where(F.col("term").isNotNull() & (F.col("term") != "") & ~F.col("term").isin(T.STOP_WORDS))
    return first_by(terms, ["term"], [F.col("file"), F.col("t"), F.col("i"), F.col("k")]).select("term", "name", "entity_type")


def seed_relations(spark: SparkSession, path: str) -> DataFrame:
    """(src, src_type, rel_type, dst, dst_type, source_ref, confidence, source): seed files {relation: [{from, to, source_ref, confidence,
    bidirectional}]}; what holds both ways comes twice. Confidence is curated where it isn't given."""
    j = _whole(spark, path, f"map<string,array<struct<`from`:{PARTY},`to`:{PARTY},source_ref:string,confidence:string,bidirectional:boolean>>>")
    r = j.select(F.explode("j").alias("rel_type", "xs")).select("rel_type", F.explode("xs").alias("x")).where("x.from.name is not null and x.to.name is not null")
    row = lambda a, b, df: df.select(F.col(f"x.{a}.name").alias("src"), F.col(f"x.{a}.type").alias("src_type"), "rel_type", F.col(f"x.{b}.name").alias("dst"), F.col(f"x.{b}.type").alias("dst_type"), "x.source_ref", F.coalesce("x.confidence", F.lit("curated")).alias("confidence"), F.lit("curated_seed").alias("source"))
    return row("from", "to", r).unionByName(row("to", "from", r.where("x.bidirectional"))).distinct()


def seed_triples(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object, file): files of triples, a list or an object with ``triples``; incomplete ones are left out."""
    t = "array<struct<subject:string,predicate:string,object:string>>"
    rows = _whole(spark, path, f"struct<triples:{t}>").select("file", F.explode("j.triples").alias("x")).unionByName(_whole(spark, path, t).select("file", F.explode("j").alias("x")))
    return rows.select("x.*", "file").where("subject is not null and predicate is not null and object is not null").distinct()


def structure_tables(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """The dimension tables ``{root}/{name}.json``, each a list of objects."""
    return {n: spark.read.option("multiLine", True).json(f"{root}/{n}.json") for n in names}


def footnote_links(spark: SparkSession, path: str, languages: tuple[str, ...] = ("en", "es")) -> DataFrame:
    """(src, dst): chapters that footnotes join, as file paths in each language, both ways. Files are lists of {from, to} whose ends are
    'volume/book/chapter'."""
    j = _whole(spark, path, "array<struct<`from`:string,`to`:string>>").select(F.explode("j").alias("x")).where("x.from is not null and x.to is not null and x.from <> x.to")
    path_of = lambda c: F.concat_ws("/", F.col("lang"), F.lit("scriptures"), F.concat(c, F.lit(".txt")))
    one = j.select("x.*").withColumn("lang", F.explode(F.array(*[F.lit(x) for x in languages]))).select(path_of(F.col("from")).alias("src"), path_of(F.col("to")).alias("dst"))
    return one.union(one.select("dst", "src")).distinct()


# offline readers -----------------------------------------------------------------------------------------------------
class _Blocks(HTMLParser):
    """Headings and paragraphs of a page, in order."""

    KINDS = {"h1", "h2", "h3", "h4", "p", "li", "blockquote", "aside"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.kind: str | None = None
        self.text: list[str] = []

    def flush(self) -> None:
        t = " ".join("".join(self.text).split())
        if t:
            self.out.append((self.kind or "p", t))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in self.KINDS:
            self.flush()
            self.kind = tag

    def handle_endtag(self, tag):
        if tag in self.KINDS:
            self.flush()
            self.kind = None

    def handle_data(self, data):
        self.text.append(data)


def blocks(html: str) -> list[tuple[str, str]]:
    """(element, text) of a page's headings, paragraphs, items, quotes and side bars."""
    p = _Blocks()
    p.feed(html)
    p.close()
    p.flush()
    return p.out


def structured_text(html: str) -> str:
    """A page as text: headings marked by #, side bars by >."""
    mark = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "aside": "> ", "blockquote": "> ", "li": "- "}
    return "\n\n".join(mark.get(k, "") + t for k, t in blocks(html))


class _Marked(HTMLParser):
    """Text of elements of one class, each with the text of the element of another class within it."""

    VOID = {"br", "img", "hr", "meta", "link", "input"}

    def __init__(self, whole: str, mark: str, skipped: set[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.whole, self.mark, self.skipped = whole, mark, skipped
        self.open: list[tuple[str, set[str]]] = []
        self.out: list[tuple[str, str]] = []
        self.parts: tuple[list[str], list[str]] | None = None

    def _end(self) -> None:
        if self.parts is not None:
            one = lambda x: " ".join("".join(x).split())
            self.out.append((one(self.parts[0]).rstrip("."), one(self.parts[1])))
            self.parts = None

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        classes = set((dict(attrs).get("class") or "").split())
        if self.whole in classes:
            self._end()
            self.parts = ([], [])
        self.open.append((tag, classes))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if any(self.whole in c for _, c in self.open[i:]):
                    self._end()
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.parts is None or any(c & self.skipped for _, c in self.open):
            return
        self.parts[0 if any(self.mark in c for _, c in self.open) else 1].append(data)


def _marked(html: str, whole: str, mark: str, skipped: set[str]) -> list[tuple[str, str]]:
    p = _Marked(whole, mark, skipped)
    p.feed(html)
    p.close()
    p._end()
    return p.out


def page_verses(html: str) -> list[tuple[int, str]]:
    """(number, text) of a page's verses, without the marks of their notes; what has no number is left out."""
    return [(int(n), t) for n, t in _marked(html, "verse", "verse-number", {"marker", "study-note-ref"}) if n.isdigit()]


def page_footnotes(html: str) -> list[tuple[str, str]]:
    """(mark, note) of a page's footnotes."""
    return [(m, t) for m, t in _marked(html, "footnote", "footnote-marker", set()) if t]


BOILERPLATE = re.compile(r"(?i)all rights reserved|copyright|isbn[ \d-]|table of contents|^contents$|^índice$|derechos reservados")


def epub_blocks(content: bytes) -> list[tuple[int, int, str, str]]:
    """(chapter, place, element, text) of an EPUB in the order of its spine; boilerplate and empty documents are left out."""
    out = []
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        opf = next(r.get("full-path") for r in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if r.tag.endswith("rootfile"))
        package = ElementTree.fromstring(z.read(opf))
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
        return []
    base = opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
    files = {i.get("id"): i.get("href") for i in package.iter() if i.tag.endswith("}item") or i.tag == "item"}
    chapter = 0
    for ref in (r.get("idref") for r in package.iter() if r.tag.endswith("itemref")):
        try:
            page = z.read(base + files[ref]).decode("utf-8", errors="replace")
        except KeyError:
            continue
        own = [(k, t) for k, t in blocks(re.sub(r"(?is)<head\b.*?</head>", "", page)) if not BOILERPLATE.search(t)]
        if own:
            out += [(chapter, i, k, t) for i, (k, t) in enumerate(own)]
            chapter += 1
    return out


def epubs(spark: SparkSession, root: str) -> DataFrame:
    """(path, chapter, place, element, text) of the EPUB files below ``root``; broken ones give no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.epub").load(root).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *b) for p, c in zip(pdf.path, pdf.content) for b in epub_blocks(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "chapter", "place", "element", "text"])

    return files.mapInPandas(run, "path string, chapter int, place int, element string, text string")


_VALUE = re.compile(r"\s*(?:'((?:[^'\\]|\\.|'')*)'|([^,()'\s]+))\s*([,)])", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def insert_rows(statement: str) -> list[tuple[str, list[str | None]]]:
    """(table, values) of the rows of an INSERT statement; NULL is null, quotes and backslashes are undone."""
    head = re.match(r"\s*INSERT\s+INTO\s+[`\"]?([\w.]+)[`\"]?\s*(?:\([^)]*\))?\s*VALUES\s*", statement, re.I)
    out: list[tuple[str, list[str | None]]] = []
    at = head.end() if head else len(statement)
    while at < len(statement) and (at := statement.find("(", at)) >= 0:
        at += 1
        row: list[str | None] = []
        while m := _VALUE.match(statement, at):
            at = m.end()
            quoted, bare = m.group(1), m.group(2)
            row.append(re.sub(r"\\(.)|''", lambda e: _ESCAPES.get(e.group(1), e.group(1)) if e.group(1) else "'", quoted, flags=re.S) if quoted is not None else None if bare.upper() == "NULL" else bare)
            if m.group(3) == ")":
                out.append((head.group(1), row))
                break
        else:
            break
    return out


def dump_rows(spark: SparkSession, path: str) -> DataFrame:
    """(table, row): the rows of a SQL dump's INSERT statements, values as strings. Statements end at a semicolon before a line break and
    are read as records, so a dump is split over tasks."""
    lines = spark.read.option("lineSep", ";\n").text(path).where(F.col("value").rlike(r"(?is)^\s*INSERT\s+INTO"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for v in pdf.value for r in insert_rows(v)], columns=["table", "row"])

    return lines.mapInPandas(run, "table string, row array<string>")


def dictionary_entries(xml: str, entry: str = "entry", term: str = "term", definition: str = "def") -> list[tuple[str, str, str]]:
    """(initial, term, text) of a dictionary in XML; entries without a term or text are left out, broken XML gives none."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return []
    flat = lambda e: " ".join("".join(e.itertext()).split()) if e is not None else ""
    out = []
    for e in root.iter(entry):
        t, d = flat(e.find(term)), flat(e.find(definition))
        if t and d:
            out.append((t[0].upper(), t, d))
    return out


def table_rows(html: str) -> list[list[str]]:
    """The cells of a page's tables, row by row."""

    class Cells(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.rows: list[list[str]] = []
            self.inside = False

        def handle_starttag(self, tag, attrs):
            if tag == "tr":
                self.rows.append([])
            self.inside = self.inside or tag in ("td", "th")
            if tag in ("td", "th") and self.rows:
                self.rows[-1].append("")

        def handle_endtag(self, tag):
            if tag in ("td", "th"):
                self.inside = False

        def handle_data(self, data):
            if self.inside and self.rows and self.rows[-1]:
                self.rows[-1][-1] += data

    p = Cells()
    p.feed(html)
    p.close()
    return [[" ".join(c.split()) for c in r] for r in p.rows if r]


# exports -------------------------------------------------------------------------------------------------------------
def audit(df: DataFrame, path: str) -> None:
    """A table as CSV with a header, one folder, written whole or not at all."""
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str, order: list) -> None:
    """A small table as one JSON file in order, for people."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").json(path)
