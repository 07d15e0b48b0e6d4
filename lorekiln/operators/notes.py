"""Notes and talks: structured fields of notes, talks from pages or sidecars, the relations they state."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.functions import names as N
from lorekiln.functions import text as T

NUMBER = r"^\s*\(?(\d{1,3})[.)]?\s+"
SEE = r"(?i)^(?:see also|see|véase también|véase|ver)\s+"
QUOTED = r"[“\"]([^”\"]+?),?[”\"]"
CITED = rf"(?i)(?:[123]\s+)?(?<!\p{{L}})(?:{'|'.join(T.BOOKS)})\.?\s+\d+(?::\d+(?:\s*[,–-]\s*\d+)*)?"
#: Kinds of notes in order of precedence, with the pattern that tells each.
GUIDE = r"(?:Guide to the Scriptures|Gospel Topics|Topical Guide|Bible Dictionary|Guía para el Estudio de las Escrituras|Temas del Evangelio),\s*" + QUOTED
HYMN = QUOTED + r",?\s*(?:Hymns|Himnos),?\s*(?:no\.|n\.º|núm\.)?\s*\d+"
TALK = r"^((?:\p{Lu}[\p{L}.’'-]*\s+){1,4}\p{Lu}[\p{L}’'-]+),\s*" + QUOTED + r",?\s*(?:in\s+|en\s+)?([\p{Lu}][\p{L} ]+?),\s*((?:\p{L}+\.?\s+(?:de\s+)?)?\d{4})"
TITLE_ONLY = r"^" + QUOTED + r",?\s*([\p{Lu}][\p{L} ]+?),\s*((?:\p{L}+\.?\s+(?:de\s+)?)?\d{4})"
REPORT = r"(?:[Ii]n\s+)?Conference Report,\s*([A-Za-z]+\.?\s+\d{4})"
TEACHINGS = r"((?:The )?Teachings of(?: the Prophet)? [\p{Lu}][\p{L}. ]+|Enseñanzas de(?: los presidentes de la Iglesia:)? [\p{Lu}][\p{L}. ]+)"
BOOK = r"([\p{Lu}][^()\d]{3,80}?)\s*\((?:[^()]*?)(\d{4})\)"


def parsed_note(note: Column) -> Column:
    """A note's fields: note_index, note_type, cited_author, cited_title, cited_publication, cited_date, concept_name, scripture_refs,
    clean_text. The kinds are tried in order: guide_ref, hymn_ref, talk_ref (author, title, publication, date; or without author; or a
    report), book_ref (a compilation; or title and year), scripture, other. A null note is other, without fields."""
    s = F.coalesce(note, F.lit(""))
    t = N.trimmed(F.regexp_replace(N.trimmed(F.regexp_replace(s, NUMBER, "")), SEE, ""))
    refs = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(CITED), F.lit(0)), lambda r: F.regexp_replace(r, r"[\s.,;]+$", "")))
    none = F.lit(None).cast("string")
    clean = lambda c: F.nullif(F.regexp_replace(c, r"^[\s]+|[\s,;.]+$", ""), F.lit(""))
    rx = lambda p, i: clean(F.regexp_extract(t, p, i))

    def fields(kind: str, author=none, title=none, publication=none, date=none, concept=none, text=F.lit("")) -> Column:
        return F.struct(F.nullif(F.regexp_extract(s, NUMBER, 1), F.lit("")).cast("int").alias("note_index"), F.lit(kind).alias("note_type"), author.alias("cited_author"), title.alias("cited_title"), publication.alias("cited_publication"), date.alias("cited_date"), concept.alias("concept_name"), refs.alias("scripture_refs"), text.alias("clean_text"))

    author = N.trimmed(F.regexp_replace(rx(TALK, 1), N.TRIBUTE, ""))
    person = clean(F.regexp_extract(F.regexp_extract(t, TEACHINGS, 1), r"(?:Teachings of(?: the Prophet)?|Enseñanzas de(?: los presidentes de la Iglesia:)?) (.*)$", 1))
    rest = F.regexp_replace(F.regexp_replace(t, CITED, ""), r"(?i)(?:^|\s)(?:see also|see|véase también|véase|ver|and|y|also)(?:\s|$)", " ")
    return (
        F.when(t.rlike(GUIDE), fields("guide_ref", concept=rx(GUIDE, 1), text=rx(GUIDE, 1)))
        .when(t.rlike(HYMN), fields("hymn_ref", title=rx(HYMN, 1), text=rx(HYMN, 1)))
        .when(t.rlike(TALK), fields("talk_ref", author, rx(TALK, 2), rx(TALK, 3), rx(TALK, 4)))
        .when(t.rlike(TITLE_ONLY), fields("talk_ref", title=rx(TITLE_ONLY, 1), publication=rx(TITLE_ONLY, 2), date=rx(TITLE_ONLY, 3)))
        .when(t.rlike(REPORT), fields("talk_ref", title=rx(QUOTED, 1), publication=F.lit("Conference Report"), date=rx(REPORT, 1)))
        .when(t.rlike(TEACHINGS), fields("book_ref", author=person, title=rx(TEACHINGS, 1)))
        .when(t.rlike(BOOK) & (F.size(refs) == 0), fields("book_ref", title=rx(BOOK, 1), date=rx(BOOK, 2)))
        .when((F.size(refs) > 0) & rest.rlike(r"^[\s,;.()–-]*$"), fields("scripture"))
        .otherwise(fields("other", text=N.trimmed(t)))
    )


def split_notes(text: Column) -> Column:
    """(body, notes) of a talk: notes follow a line that says Notes, Notas, References or Referencias, one to a line; a note that goes on
    without a number belongs to the one before."""
    heading = r"(?im)^\s*#{0,4}\s*(?:notes|notas|references|referencias)\s*:?\s*$"
    body = N.trimmed(F.element_at(F.split(text, heading), 1))
    tail = F.when(F.size(F.split(text, heading)) > 1, F.array_join(F.slice(F.split(text, heading), 2, 1 << 20), "\n")).otherwise("")
    joined = F.regexp_replace(tail, r"\n(?!\s*\(?\d{1,3}[.)]?\s+)\s*(?=\S)", " ")
    return F.struct(body.alias("body"), F.filter(F.transform(F.split(joined, "\n"), N.trimmed), lambda n: n != "").alias("notes"))


def note_relations(notes: DataFrame, talk: str, note: str) -> DataFrame:
    """(src, src_type, rel_type, dst, dst_type, confidence): what notes (talk, note) state: a talk REFERENCES a talk or book, CITES a hymn,
    DISCUSSES a concept; a cited talk is DELIVERED_BY its author. Distinct; notes of other kinds state nothing."""
    p = notes.select(F.col(talk).alias("t"), parsed_note(F.col(note)).alias("p")).where("t is not null")
    one = lambda cond, s, st, r, d, dt: F.when(cond & d.isNotNull() & s.isNotNull(), F.struct(s.alias("src"), F.lit(st).alias("src_type"), F.lit(r).alias("rel_type"), d.alias("dst"), F.lit(dt).alias("dst_type")))
    kind, title = F.col("p.note_type"), F.col("p.cited_title")
    t = F.col("t")
    stated = F.array(
        one(kind == "talk_ref", t, "talk", "REFERENCES", title, "talk"), one(kind == "talk_ref", title, "talk", "DELIVERED_BY", F.col("p.cited_author"), "person"), one(kind == "hymn_ref", t, "talk", "CITES", title, "hymn"),
        one(kind == "guide_ref", t, "talk", "DISCUSSES", F.col("p.concept_name"), "concept"), one(kind == "book_ref", t, "talk", "REFERENCES", title, "book"),
    )
    return p.select(F.explode(F.array_compact(stated)).alias("r")).select("r.*", F.lit("note_reference").alias("confidence")).distinct()


#: A speaker's calling as it stands on pages, and the one it means.
CALLINGS = {
    "of the quorum of the twelve apostles": "Quorum of the Twelve Apostles", "del cuórum de los doce apóstoles": "Quorum of the Twelve Apostles", "first counselor in the first presidency": "First Presidency", "second counselor in the first presidency": "First Presidency",
    "primer consejero de la primera presidencia": "First Presidency", "segundo consejero de la primera presidencia": "First Presidency", "of the seventy": "Seventy", "de los setenta": "Seventy",
}


def calling(c: Column) -> Column:
    """A calling in its canonical form; unknown ones without outer blanks."""
    s = N.trimmed(F.replace(c, F.lit(" "), F.lit(" ")))
    return F.coalesce(N.first_rule([(F.lower(s) == k, v) for k, v in CALLINGS.items()], None), s)


class _Talk(HTMLParser):
    """Where the parser is on a page: the open elements decide which field takes the text."""

    FIELDS = {"h1": "title"}
    CLASSES = {"author-name": "author", "author": "author", "byline": "author", "author-role": "calling", "calling": "calling", "date": "date", "notes": "notes", "footnotes": "notes", "body-block": "content", "body": "content"}
    VOID = {"br", "img", "hr", "meta", "link", "input"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str | None]] = []
        self.got: dict[str, list[str]] = {}
        self.lang = self.url = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "html":
            self.lang = (a.get("lang") or "")[:2].lower() or None
        if tag == "link" and a.get("rel") == "canonical":
            self.url = a.get("href")
        if tag in self.VOID:
            return
        field = self.FIELDS.get(tag) or next((self.CLASSES[c] for c in (a.get("class") or "").split() if c in self.CLASSES), None)
        self.open.append((tag, field))
        if tag in ("p", "li", "h2", "h3"):
            for where in ("content", "notes"):
                if any(f == where for _, f in self.open):
                    self.got.setdefault(where, []).append("\n")

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        field = next((f for _, f in reversed(self.open) if f), None)
        if field and data.strip() and not any(t in ("script", "style") for t, _ in self.open):
            self.got.setdefault(field, []).append(data)

    def row(self) -> dict:
        one = lambda k: " ".join("".join(self.got.get(k, [])).split()) or None
        many = lambda k: [" ".join(x.split()) for x in "".join(self.got.get(k, [])).split("\n") if x.strip()]
        return {"title": one("title"), "author": one("author"), "calling": one("calling"), "date": one("date"), "lang": self.lang, "notes": many("notes"), "content": "\n\n".join(many("content")), "url": self.url}


TALK_SCHEMA = "title string, author string, calling string, date string, lang string, notes array<string>, content string, url string"


def talks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, author, calling, date, lang, notes, content, url) of talk pages, read in Arrow batches; broken markup gives what is
    there, a null page no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for h in pdf["_h"]:
                p = _Talk()
                p.feed(h)
                p.close()
                rows.append(p.row())
            out = pd.DataFrame(rows, columns=["title", "author", "calling", "date", "lang", "notes", "content", "url"])
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    rows = pages.where(F.col(html).isNotNull()).select(key, F.col(html).alias("_h")).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, {TALK_SCHEMA}")
    return rows.withColumn("author", N.trimmed(F.regexp_replace("author", N.TRIBUTE, ""))).withColumn("calling", calling(F.col("calling")))


def talks_from_sidecars(sidecars: DataFrame) -> DataFrame:
    """The same columns from metadata maps (stem, metadata): what pages don't tell is null."""
    m = lambda k: F.element_at("metadata", k)
    return sidecars.select("stem", m("title").alias("title"), N.trimmed(F.regexp_replace(F.coalesce(m("author"), m("speaker")), N.TRIBUTE, "")).alias("author"), calling(m("calling")).alias("calling"), m("date").alias("date"), F.lower(F.substring(m("lang"), 1, 2)).alias("lang"), m("url").alias("url"))


def talk_relations(found: DataFrame, series: str = "Conference") -> DataFrame:
    """(src, rel_type, dst, context), distinct: a talk is DELIVERED_BY its author, PART_OF its event, CITES what its notes cite (with the
    note, 500 characters at most); an author is CALLED_AS a calling. ``found``: title, author, calling, date, notes."""
    t = found.where("title is not null")
    rel = lambda df, s, r, d, c=None: df.select(s.alias("src"), F.lit(r).alias("rel_type"), d.alias("dst"), (F.lit(None).cast("string") if c is None else c).alias("context")).where("src is not null and dst is not null and dst <> ''")
    cites = t.select("title", F.explode_outer("notes").alias("n")).where("n is not null").select("title", "n", F.explode(parsed_note(F.col("n"))["scripture_refs"]).alias("ref"))
    out = rel(t, F.col("title"), "DELIVERED_BY", F.col("author")).unionByName(rel(t.where("date rlike '^[0-9]{4}'"), F.col("title"), "PART_OF", N.event_name(F.lit(series), F.substring("date", 1, 7))))
    return out.unionByName(rel(cites, F.col("title"), "CITES", F.col("ref"), F.substring("n", 1, 500))).unionByName(rel(t, F.col("author"), "CALLED_AS", F.col("calling"))).distinct()
