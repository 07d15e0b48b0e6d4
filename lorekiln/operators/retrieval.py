"""Retrieval beyond one ranked list: query language, hints, expansions, look-ups, variants, contexts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekiln.functions import text as T
from lorekiln.functions.arrays import let, small
from lorekiln.operators import search
from lorekiln.operators.graph import TIERS, both_ways, first_by


def light_stem(w: Column) -> Column:
    """A word without plural and gender endings of English and Spanish; a hook for ``find`` and ``cover_rank``."""
    return F.when(F.length(w) > 4, F.regexp_replace(F.regexp_replace(w, "(ies|ces)$", "i"), "(es|as|os|s|a|o|e)$", "")).otherwise(w)


def parse_query(query: str, stop_words: list[str] = T.STOP_WORDS) -> list[list[tuple[str, bool]]]:
    """Alternatives of a query, each a list of (words, wanted): words all follow one another, ``-`` before them excludes.

    Quotes hold a phrase together, ``or`` parts alternatives and binds less than standing side by side. Signs and accents don't
    count, nor do stop words; an alternative that wants nothing is left out.
    """
    out: list[list[tuple[str, bool]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query or ""):
        if word.lower() == "or" and not minus:
            out.append([])
            continue
        plain = re.sub("[^a-z0-9]+", " ", (phrase or word).lower().translate(str.maketrans(*T.FOLD))).split()
        kept = [w for w in plain if w not in stop_words]
        if kept:
            out[-1].append((" ".join(kept), not minus))
    return [a for a in out if any(wanted for _, wanted in a)]


def _holds(words: Column, item: str, token) -> Column:
    parts = [F.lit(w) if token is None else token(F.lit(w)) for w in item.split()]
    if len(parts) == 1:
        return F.array_contains(words, parts[0])
    whole = F.array(*parts)
    return F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - len(parts) + 1)), lambda i: F.slice(words, i, len(parts)) == whole)


def _all_of(items: list[tuple[str, bool]], token):
    return lambda words: reduce(lambda x, y: x & y, [_holds(words, item, token) if wanted else ~_holds(words, item, token) for item, wanted in items])


def find(docs: DataFrame, key: str, text: str, query: str, k: int | None = 20, only: Column | None = None, token=None) -> DataFrame:
    """(key, score, rank): full-text search. A blank query finds nothing; ``only`` filters the documents, ``token`` stems.

    A document must hold all that one alternative wants and nothing it excludes, and scores the best of its alternatives' cover
    densities. Stop words of texts aren't counted as distance.
    """
    alternatives = parse_query(query)
    d = docs.where(F.col(text).isNotNull()) if only is None else docs.where(F.col(text).isNotNull() & only)
    if not alternatives:
        return d.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("false")
    words = F.filter(F.split(T.normalised(F.col(text)), " "), lambda w: (w != "") & ~w.isin(T.STOP_WORDS))
    d = d.select(key, (words if token is None else F.transform(words, token)).alias("_w"))
    scored = []
    for a in alternatives:
        # the words are bound once: a filter is moved before the projection that makes them
        hit = let(F.col("_w"), _all_of(a, token))
        terms = list(dict.fromkeys(w for item, wanted in a if wanted for w in item.split()))
        scored.append(search.cover_words(d.where(hit), key, "_w", terms, token))
    best = reduce(DataFrame.unionByName, scored).groupBy(key).agg(F.max("score").alias("score")) if len(scored) > 1 else scored[0]
    return search.top(best, "score", key, k) if k else best


def best_per_file(docs: DataFrame, query: str, files: DataFrame, k: int, key: str = "id", text: str = "text") -> DataFrame:
    """(file_path, key, chunk_index, score, place): the k best hits of a query within each of ``files`` (file_path)."""
    inside = docs.join(small(files.select("file_path").distinct()), "file_path", "left_semi")
    hits = find(inside, key, text, query, None).join(inside.select(key, "file_path", "chunk_index"), key)
    hits = first_by(hits, ["file_path", "chunk_index"], [F.desc("score"), F.col(key)])
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("score"), key))).where(F.col("place") <= k)


def with_hints(hits: DataFrame, hints: DataFrame, docs: DataFrame, query: str, extra_files: int = 10) -> DataFrame:
    """(file_path, chunk_index, score, mode, text): hits with those of hinted files (file_path, label) boosted by half, and the two best
    hits of each of ``extra_files`` hinted files that aren't among them, at a thousandth of their score, their text labelled.

    ``hits``: file_path, chunk_index, score, text. Of several labels of a file the first in order counts; files are taken in order.
    """
    label = hints.groupBy("file_path").agg(F.min("label").alias("label"))
    own = hits.join(label, "file_path", "left").select("file_path", "chunk_index", F.when(F.col("label").isNull(), F.col("score")).otherwise(F.col("score") * 1.5).alias("score"), F.when(F.col("label").isNull(), "hybrid").otherwise("hybrid+kg").alias("mode"), "text")
    missing = label.join(hits.select("file_path").distinct(), "file_path", "left_anti").orderBy("file_path").limit(extra_files)
    more = best_per_file(docs, query, missing, 2).join(docs.select("id", "text"), "id").join(missing, "file_path")
    more = more.select("file_path", "chunk_index", (F.col("score") * 0.001).alias("score"), F.lit("kg-boost").alias("mode"), F.concat(F.lit("[KG: "), "label", F.lit("] "), "text").alias("text"))
    return own.unionByName(more)


def linked_files(files: DataFrame, links: DataFrame, each: int | None = None) -> DataFrame:
    """(file_path): files that links (src, dst, either way) lead to and that aren't given already; the first ``each`` of a source."""
    both = links.select("src", "dst").union(links.select("dst", "src")).where("src <> dst").distinct()
    out = both.join(files.select(F.col("file_path").alias("src")).distinct(), "src", "left_semi")
    if each:
        out = out.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("n") <= each)
    return out.select(F.col("dst").alias("file_path")).distinct().join(files.select("file_path"), "file_path", "left_anti")


def expanded(docs: DataFrame, query: str, files: DataFrame, links: DataFrame, mode: str, k: int, each: int | None = None) -> DataFrame:
    """(file_path, chunk_index, score, mode): the k best hits of each linked file that isn't retrieved yet, at a thousandth."""
    hits = best_per_file(docs, query, linked_files(files, links, each), k)
    return hits.select("file_path", "chunk_index", (F.col("score") * 0.001).alias("score"), F.lit(mode).alias("mode"))


def by_reference(ranges: DataFrame, wanted: DataFrame, key: str, before: int = 2, after: int = 3, languages: tuple[str, ...] = ("es", "en")) -> DataFrame:
    """(request, key, score): passages of a verse asked for (request, book, chapter, verse), from ``before`` verses to ``after`` later, in the
    first language of ``languages`` that has the book. Without a verse the first ten of the chapter.

    ``ranges``: key, lang, book, chapter, lo, hi. Requests are few and may be broadcast; passages meet them on book and chapter.
    """
    w = small(wanted)
    hit = ranges.join(w, ["book", "chapter"]).where((F.col("verse").isNull() & (F.col("lo") <= 10)) | ((F.col("lo") <= F.col("verse") + after) & (F.col("hi") >= F.col("verse") - before)))
    hit = hit.withColumn("turn", T.ranked(F.col("lang"), list(languages)))
    least = F.min("turn").over(Window.partitionBy("request"))
    return hit.withColumn("least", least).where("turn = least").select("request", key, F.lit(100.0).alias("score")).distinct()


def by_crossreference(ranges: DataFrame, wanted: DataFrame, links: DataFrame, key: str, most: int = 15) -> DataFrame:
    """(request, key, score): passages of what a verse's cross-references name: ``most`` targets, one a chapter, the first passage of
    each; a whole chapter gives its verses 1 to 5.

    ``links``: book, chapter, verse -> to_book, to_chapter, to_verse (null: the chapter).
    """
    t = links.join(small(wanted.where("verse is not null")), ["book", "chapter", "verse"]).select("request", "to_book", "to_chapter", "to_verse").distinct()
    t = first_by(t, ["request", "to_book", "to_chapter"], [F.asc_nulls_first("to_verse")])
    t = t.withColumn("n", F.row_number().over(Window.partitionBy("request").orderBy("to_book", "to_chapter"))).where(F.col("n") <= most)
    hit = ranges.join(t, (F.col("book") == F.col("to_book")) & (F.col("chapter") == F.col("to_chapter"))).where((F.col("to_verse").isNull() & (F.col("lo") <= 5)) | F.col("to_verse").between(F.col("lo"), F.col("hi")))
    return first_by(hit, ["request", "to_book", "to_chapter"], [F.col("lo"), F.col(key)]).select("request", key, F.lit(50.0).alias("score"))


def definitions(entries: DataFrame, terms: DataFrame, bridge: DataFrame, language: str, sources: list[str], most: int = 800) -> DataFrame:
    """(term, title, source, lang, text): the best entry of each term, by language, then by ``sources`` in order, then by entry id.

    ``entries``: entry, title, source, lang, text; ``bridge``: term, other. A term without an entry of its own takes those of its
    counterpart. Texts beyond ``most`` characters end at a paragraph in their second half, else with an ellipsis.
    """
    e = entries.where("text is not null and title is not null").withColumn("k", T.normalised(F.col("title"))).where("k <> ''")
    t = terms.select("term", T.normalised(F.col("term")).alias("k")).distinct()
    own = t.join(e, "k")
    other = t.join(own.select("term").distinct(), "term", "left_anti").join(bridge.select(T.normalised(F.col("term")).alias("k"), T.normalised(F.col("other")).alias("k2")).distinct(), "k").drop("k").withColumnRenamed("k2", "k")
    hit = own.select("term", "entry", "title", "source", "lang", "text").unionByName(other.join(e, "k").select("term", "entry", "title", "source", "lang", "text"))
    best = first_by(hit, ["term"], [F.when(F.col("lang") == language, 0).otherwise(1), T.ranked(F.col("source"), sources), F.col("entry")])
    at = F.locate("\n\n", F.col("text"), most // 2)
    cut = F.when(F.length("text") <= most, F.col("text")).when((at > 0) & (at <= most), F.substring(F.col("text"), F.lit(1), at - 1)).otherwise(F.concat(F.substring("text", 1, most), F.lit("...")))
    return best.select("term", "title", "source", "lang", cut.alias("text"))


def variants(ranges: DataFrame, couples: DataFrame, key: str) -> DataFrame:
    """(key, variant): passages of two editions (file_path a, b) whose verses overlap in chapter and verse."""
    x = ranges.select(F.col(key), F.col("file_path").alias("a"), "chapter", "lo", "hi")
    y = ranges.select(F.col(key).alias("variant"), F.col("file_path").alias("b"), F.col("chapter").alias("chapter2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return x.join(couples.select("a", "b").distinct(), "a").join(y, "b").where("chapter = chapter2 and lo <= hi2 and lo2 <= hi").select(key, "variant").distinct()


#: Relations that say little about an entity.
NOISE_RELATIONS = ("CO_OCCURS_WITH", "MENTIONED_IN", "RELATED_TO", "ASSOCIATED_WITH", "REFERENCED_IN", "SEE_ALSO")


def graph_context(entities: DataFrame, edges: DataFrame, ids: DataFrame, floor: str = "ner", most: int = 25) -> DataFrame:
    """(id, context): for each asked entity its telling relations as lines 'NAME -REL-> OTHER', surest first, ``most`` at most; where it
    has none, its first neighbours' names; null where it has no edge."""
    asked = small(ids.select(F.col("id").alias("a")).distinct())
    e = both_ways(edges.where(F.col("confidence").isin(TIERS[: TIERS.index(floor) + 1]))).join(asked, "a")
    names = entities.select("id", "name")
    e = e.join(names.select(F.col("id").alias("a"), F.col("name").alias("name_a")), "a").join(names.select(F.col("id").alias("b"), F.col("name").alias("name_b")), "b")
    telling = ~F.col("rel_type").isin(*NOISE_RELATIONS)
    arrow = F.when(F.col("outgoing"), F.concat_ws(" ", "name_a", F.concat(F.lit("-"), "rel_type", F.lit("->")), "name_b")).otherwise(F.concat_ws(" ", "name_b", F.concat(F.lit("-"), "rel_type", F.lit("->")), "name_a"))
    e = e.select("a", telling.alias("telling"), T.ranked(F.col("confidence"), TIERS).alias("tier"), "rel_type", "b", F.when(telling, arrow).otherwise(F.col("name_b")).alias("line")).distinct()
    best = F.max("telling").over(Window.partitionBy("a"))
    e = e.withColumn("best", best).where("telling = best").withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("tier", "rel_type", "b", "line"))).where(F.col("n") <= F.when(F.col("best"), most).otherwise(8))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return ids.select("id").distinct().join(e.groupBy(F.col("a").alias("id")).agg(text.alias("context")), "id", "left")


def assembled(hits: DataFrame, width: int = 600) -> DataFrame:
    """(context): one text of ranked hits (rank, file_path, text), each headed by its number and file and cut to ``width`` characters."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("file_path", F.lit("?")), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, width))
    return hits.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("context"))


def reranked(hits: DataFrame, most: int, pick=None) -> DataFrame:
    """The ``most`` first hits by rank; where there are over half as many again, ``pick`` (a model behind a function from hits and number to
    hits) chooses among them, if one is given."""
    if pick is not None and hits.limit(most * 3 // 2 + 1).count() > most * 3 // 2:
        return pick(hits, most)
    return hits.orderBy("rank").limit(most)


def expand_question(question: str, rewrite=None) -> str:
    """A question as a query; ``rewrite`` is a hook for a model, without one it stays as it is."""
    return rewrite(question) if rewrite else question


def hashed_vectors(docs: DataFrame, key: str, text: str, dim: int = 384, encode=None) -> DataFrame:
    """(key, embedding): vectors of unit length. ``encode`` (texts -> rows of numbers) is the hook for a model; without one words are
    hashed and counted with signs, which needs none. Null and wordless texts have a null embedding."""

    def hashed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), "f4")
        for row, t in zip(out, texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % dim] += 1 if h >> 63 else -1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray((encode or hashed)([t or "" for t in b.column(1).to_pylist()]), "f4")
            n = np.linalg.norm(x, axis=1, keepdims=True)
            rows = [None if not k else r.tolist() for r, k in zip(x / np.where(n > 0, n, 1), n[:, 0])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float32()))], names=[key, "embedding"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, embedding array<float>")
