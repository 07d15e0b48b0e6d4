"""Corpus files as tables: scan, parse by suffix, sidecars, hashes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("txt", "md", "html", "json")
#: Elements and classes whose text isn't the document's.
SKIPPED_TAGS = {"head", "style", "script", "footer"}
SKIPPED_CLASSES = {"header", "extraction-info", "notes", "study-note-ref"}
SKIPPED_PAIRS = {("sup", "marker")}
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.open: list[tuple[str, bool]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        classes = set((dict(attrs).get("class") or "").split())
        self.open.append((tag, tag in SKIPPED_TAGS or bool(classes & SKIPPED_CLASSES) or any((tag, c) in SKIPPED_PAIRS for c in classes)))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if data.strip() and not any(s for _, s in self.open):
            self.parts.append(data.strip())


def html_text(raw: str) -> str:
    """Text of a page, a line for each run; unclosed and stray tags are tolerated."""
    p = _Text()
    p.feed(raw)
    p.close()
    return "\n".join(p.parts)


_INLINE = [
    (re.compile(r"!?\[([^\[\]]*)\]\((?:[^()]|\([^()]*\))*\)"), r"\1"), (re.compile(r"!?\[([^\[\]]*)\]\[[^\]]*\]"), r"\1"), (re.compile(r"<(https?://[^>\s]+)>"), r"\1"), (re.compile(r"</?[A-Za-z][^<>]*>"), ""),
    (re.compile(r"(?<![\w*])(\*{1,3})(?=\S)(.+?)(?<=\S)\1(?![\w*])"), r"\2"), (re.compile(r"(?<![\w_])(_{1,3})(?=\S)(.+?)(?<=\S)\1(?![\w_])"), r"\2"), (re.compile(r"~~(.+?)~~"), r"\1"),
]


def _inline(t: str) -> str:
    """A line without inline marks, however they are nested; what stands between backticks stays as it is."""
    parts = re.split(r"(`+)(.+?)\1", t)
    out = []
    for i in range(0, len(parts), 3):
        one = re.sub(r"\\([\\`*_{}\[\]()#+.!|>~-])", lambda m: chr(0xE000 + ord(m.group(1))), parts[i])  # what is escaped is no mark
        for _ in range(8):
            before = one
            for p, r in _INLINE:
                one = p.sub(r, one)
            if one == before:
                break
        out += [re.sub(r"[\uE000-\uE07F]", lambda m: chr(ord(m.group()) - 0xE000), one), parts[i + 2] if i + 2 < len(parts) else ""]
    return "".join(out)


def markdown_text(raw: str) -> str:
    """Markdown as text, a line for each of its blocks' lines: headings (also underlined ones), quotes, items, tables cell by cell; fenced
    code stays as it is; rules, comments, link definitions and front matter go."""
    raw = re.sub(r"(?s)\A---\n.*?\n---\n", "", re.sub(r"\r\n?", "\n", raw))
    raw = re.sub(r"(?s)<!--.*?-->", "", raw)
    out: list[str] = []
    fence = None
    for line in raw.split("\n"):
        mark = re.match(r"\s{0,3}(`{3,}|~{3,})", line)
        if fence:
            if mark and mark.group(1).startswith(fence):
                fence = None
            else:
                out.append(line)
            continue
        if mark:
            fence = mark.group(1)
            continue
        if re.match(r"\s{0,3}(?:=+|(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$", line) or re.match(r"\s{0,3}\[[^\]]+\]:\s*\S+", line) or (re.match(r"[\s|:-]+$", line) and "-" in line):
            continue
        line = re.sub(r"^\s{0,3}(?:>\s?)+", "", line)
        line = re.sub(r"^\s*(?:[-*+]|\d{1,9}[.)])\s+(?:\[[ xX]\]\s+)?", "", line)
        line = re.sub(r"^\s{0,3}#{1,6}\s+(.*?)(?:\s+#+)?\s*$", r"\1", line)
        if re.match(r"\s*\|.*\|\s*$", line):
            line = "\n".join(c.strip() for c in re.split(r"(?<!\\)\|", line.strip().strip("|")))
        out.append(_inline(line).rstrip())
    return re.sub(r"\n{2,}", "\n", "\n".join(out)).strip()


def json_text(raw: str, depth: int = 20) -> str:
    """All string values, depth first, a line each; numbers and truth values are left out; broken JSON gives nothing."""
    out: list[str] = []

    def walk(x: object, d: int) -> None:
        if d > depth:
            return
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, dict):
            for v in x.values():
                walk(v, d + 1)
        elif isinstance(x, list):
            for v in x:
                walk(v, d + 1)

    try:
        walk(json.loads(raw), 0)
    except ValueError:
        return ""
    return "\n".join(out)


PARSERS = {"txt": lambda t: t, "md": markdown_text, "html": html_text, "json": json_text}


def parse(name: str, raw: bytes) -> str:
    """A file's text by its suffix; another suffix raises."""
    suffix = name.rsplit(".", 1)[-1].lower()
    if suffix not in PARSERS:
        raise ValueError(f"no parser for {name}")
    return PARSERS[suffix](raw.decode("utf-8", errors="replace"))


#: Helper files that are no documents.
SKIPPED_FILES = ("bilingual-concept-bridge.json",)


def scan(spark: SparkSession, root: str, skip: tuple[str, ...] = SKIPPED_FILES, paths: list[str] | None = None) -> DataFrame:
    """(path, sha256, file_size, text) of the corpus files below ``root``, or of the files and folders ``paths`` only; sidecars ``*.meta.json`` and
    files whose name is in ``skip`` are no documents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(paths or root).where(~F.col("path").endswith(".meta.json"))
    files = files.where(~F.element_at(F.split("path", "/"), -1).isin(list(skip)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf.path, "sha256": pdf.sha256, "file_size": pdf.file_size, "text": [parse(p, bytes(c)) for p, c in zip(pdf.path, pdf.content)]})

    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("file_size"), "content").mapInPandas(run, "path string, sha256 string, file_size long, text string")


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(path, metadata) of the documents that have a sidecar; broken ones give an empty map."""
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").load(root)
    text = F.decode("content", "UTF-8")
    return meta.select(F.regexp_replace("path", r"\.meta\.json$", "").alias("stem"), F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>")).alias("metadata"))


def with_sidecars(documents: DataFrame, meta: DataFrame) -> DataFrame:
    """Documents (path, ...) with the metadata of the sidecar that has their name without the suffix; without one an empty map."""
    d = documents.withColumn("stem", F.regexp_replace("path", r"\.[^./]+$", ""))
    none = F.create_map().cast("map<string,string>")
    return d.join(meta.select("stem", "metadata").dropDuplicates(["stem"]), "stem", "left").withColumn("metadata", F.coalesce("metadata", none)).drop("stem")
