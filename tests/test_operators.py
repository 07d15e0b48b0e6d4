"""Operators against brute force and on small cases."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lorekiln.functions import text as T
from lorekiln.operators import chunking, extract, graph, merge, search
from lorekiln.sources import readers
from lorekiln.streaming.ingest import ingest_once


@pytest.mark.parametrize("name,reason", [(None, "empty"), ("  ", "empty"), ("ab", "too_short"), ("x" * 81, "too_long"), ("...!", "all_punct"), ("www.some.org", "url_like"), ("<b>Bold</b>", "html_fragment"), ("Mary hath spoken", "archaic_verb"), ("see Alma", "xref_fragment"), ("They", "pronoun_stopword"), ("• Point", "leading_punct"), ("## Heading", "markdown_heading"), ("45 miles", "measurement"), ("Entonces dijo", "sentence_fragment_es"), ("word", "lowercase_token"), ("Nahum 2", "scripture_ref"), ("1 Alma 55:17", "scripture_ref"), ("class='x'", "html_fragment"), ("\u21a9 back", "leading_punct"), ("\u00b9Note", None), ("29 ounces", "measurement"), ("50 por ciento", "measurement"), ("Quién sabe", "sentence_fragment_es"), ("Jos Ã L", None), ("SÃ³ Ã©l", "mojibake"), ("Ana María", None), ("St. Orin", None)])
def test_garbage(spark, name, reason):
    df = spark.createDataFrame([(name,)], "name string").select(T.garbage_reason(F.col("name")).alias("r"))
    assert df.first().r == reason


def packed(text, size, overlap):
    """The rule in plain Python: (words, chunk) pairs."""
    out, held = [], []
    for sentence in re.split(r"(?<=[.!?])\s+|\n\n+", text):
        w = sentence.split()
        if held and w and len(held) + len(w) > size:
            out.append(" ".join(held))
            held = held[-overlap:] if overlap and len(held) > overlap else []
        held = held + w
    return [*out, " ".join(held)] if held else out


def test_chunking_against_brute_force(spark):
    rng = random.Random(1)
    sentence = lambda: " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 12))) + rng.choice([".", "!", "?", ".\n\n"])
    texts = [" ".join(sentence() for _ in range(rng.randint(0, 60))) for _ in range(25)] + ["", "  \n ", None, "one " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("w", F.lit("clash"))
    for size, overlap in ((30, 5), (5, 1), (500, 50), (20, 0)):
        got = {}
        for r in chunking.chunked(df, "id", "t", size, overlap).orderBy("id", "chunk_index").collect():
            got.setdefault(r.id, []).append(r.text)
            assert texts[r.id][r.start_char : r.end_char].split() == r.text.split() and r.n_words == len(r.text.split())
        assert got == {i: packed(t, size, overlap) for i, t in enumerate(texts) if t and t.strip()}


def test_verse_and_section_chunks(spark):
    verse = "Heading\n1 In the beginning\n  it was dark.\n\n2 Then came light.\n3 " + "word " * 40 + "\n4 End."
    got = chunking.verse_chunks(spark.createDataFrame([(1, verse), (2, "No verses. Only text."), (3, None)], "id long, t string"), "id", "t", 10, 30).orderBy("id", "chunk_index").collect()
    assert [(r.id, r.first_verse, r.last_verse) for r in got] == [(1, 1, 2), (1, 3, 3), (1, 4, 4), (2, None, None)]
    assert got[0].text == "1 In the beginning it was dark. 2 Then came light."
    book = "Preamble.\n\n## 1.1 First\n\nA b c.\n\n## 1.2 Second\n\nD e f.\n\n## 2.1 Long\n\n" + "\n\n".join("x " * 12 for _ in range(4))
    got = chunking.section_chunks(spark.createDataFrame([(1, book), (2, "Plain text only.")], "id long, t string"), "id", "t", 30, 5).orderBy("id", "chunk_index").collect()
    assert [(r.id, r.chunk_index, r.reference) for r in got] == [(1, 0, "1.1"), (1, 1, "2.1"), (1, 2, "2.1"), (1, 3, "2.1"), (2, 0, None)]
    assert got[0].text.startswith("## 1.1 First") and "## 1.2 Second" in got[0].text and all(r.text.startswith("## 2.1 Long\n\n") for r in got[1:4])
    assert sum(r.text.count("x") for r in got[1:4]) == 48 + 2 * 5


EDGES = [(1, 2, "A", "curated"), (2, 3, "A", "ner"), (3, 4, "B", "llm_low"), (4, 5, "B", "metadata"), (9, 9, "A", "ner")]


def test_hops_and_paths(spark):
    e = spark.createDataFrame(EDGES, "src long, dst long, rel_type string, confidence string")
    assert {(r.id, r.hops) for r in graph.within_hops(e, [1], 2).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert graph.shortest_path(e, 1, 4).first().path == "1,2,3,4"
    assert graph.shortest_path(e, 1, 9).count() == 0
    kids = graph.descendants(spark.createDataFrame([(2, 1), (3, 2), (1, 3)], "src long, dst long"), 1, 10).collect()
    assert {(r.id, r.level) for r in kids} == {(1, 0), (2, 1), (3, 2)}


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_pagerank_properties(spark, monkeypatch, bound):
    monkeypatch.setattr(graph, "ONE_TASK", bound)
    e = spark.createDataFrame([(a, b, "A", "ner") for a, b in ((1, 2), (2, 3), (1, 3))], "src long, dst long, rel_type string, confidence string")
    s = {r.id: r.score for r in graph.pagerank(e, [1], alpha=0.0).collect()}
    assert all(abs(v - 1 / 3) < 1e-4 for v in s.values())
    s = {r.id: r.score for r in graph.pagerank(e, [1], alpha=1.0).collect()}
    assert s[1] == pytest.approx(1) and s[2] == pytest.approx(0)
    assert sum(r.score for r in graph.pagerank(e, [1, 2]).collect()) == pytest.approx(1, abs=1e-4)
    assert graph.pagerank(e, [77]).count() == 0
    loops = spark.createDataFrame([(1, 2, "A", "ner"), (9, 9, "A", "ner")], "src long, dst long, rel_type string, confidence string")
    s = {r.id: r.score for r in graph.pagerank(loops, [1, 9]).collect()}
    assert set(s) == {1, 2, 9} and sum(s.values()) == pytest.approx(1, abs=1e-4) and s[9] == pytest.approx(0.5, abs=1e-3)
    assert graph.pagerank(e, [1], k=2).count() == 2


def test_closure(spark):
    f = spark.createDataFrame([(1, "S", 2), (2, "S", 3), (9, "F", 1), (4, "S", 4)], "src long, rel_type string, dst long")
    got = {(r.src, r.rel_type, r.dst) for r in graph.closure(f, ["S"], "S", "F").collect()}
    assert {(9, "F", 1), (9, "F", 2), (9, "F", 3), (2, "S", 1), (3, "S", 2)} <= got and (4, "S", 4) in got


def test_merge_algebra(spark):
    old = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(1, None), (None, "x"), (4, "d")], "k long, v string")
    got = {(r.k, r.v) for r in merge.upsert(old, new, ["k"], ["v"]).collect()}
    assert got == {(1, "a"), (None, "x"), (3, "c"), (4, "d")}
    once = merge.insert_absent(old, new, ["k"], [F.col("v")])
    assert {(r.k, r.v) for r in once.collect()} == {(1, "a"), (None, "b"), (3, "c"), (4, "d")}
    assert merge.insert_absent(once, new, ["k"], [F.col("v")]).count() == 4


@pytest.mark.parametrize("terms", [["ab"], ["ab", "cd"], ["ab", "cd", "ef"], ["ab", "cd", "ef", "gh"]])
def test_cover_rank_against_brute_force(spark, terms):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(rng.randint(0, 25)))) for i in range(80)] + [(99, None)]

    def brute(t):
        w = (t or "").split()
        spans = [(i, j) for i in range(len(w)) for j in range(i, len(w)) if set(terms) <= set(w[i : j + 1])]
        shortest = [(i, j) for i, j in spans if not any((x, y) != (i, j) and i <= x and y <= j for x, y in spans)]
        return round(sum(0.1 / (1 + sum(x not in terms for x in w[i : j + 1])) for i, j in shortest), 6) if shortest else None

    got = {r.id: r.score for r in search.cover_rank(spark.createDataFrame(docs, "id long, text string"), "id", "text", terms).collect()}
    assert got == pytest.approx({i: b for i, t in docs if (b := brute(t)) is not None}, abs=1e-5)


def test_mentions_take_the_longest(spark):
    d = spark.createDataFrame([(1, "The old bridge stood by the Old Bridge Inn.")], "id long, text string")
    g = spark.createDataFrame([("old bridge", 1, "object", 2), ("bridge", 2, "object", 1), ("old bridge inn", 3, "place", 3)], "term string, entity_id long, entity_type string, n int")
    assert {(r.entity_id, r.pos) for r in extract.mentions(d, "id", "text", g).collect()} == {(1, 1), (3, 6)}


def test_mentions_neither_overlap_nor_cite(spark, monkeypatch):
    d = spark.createDataFrame([(1, "By the red iron gate house. Orin 3:4 says so; Orin himself, of the very old house by the river of salt, not."), (2, None), (3, "")], "id long, text string")
    g = spark.createDataFrame([("red iron gate", 1, "object", 3), ("gate house", 2, "object", 2), ("orin", 3, "person", 1), ("orin", 4, "place", 1), ("the very old house by the river of salt", 5, "place", 9)], "term string, entity_id long, entity_type string, n int")
    want = {(1, 2), (3, 10), (4, 10), (5, 13)}  # chapter and verse are one place
    found = lambda: {(r.entity_id, r.pos) for r in extract.mentions(d, "id", "text", g).collect()}
    assert found() == want
    monkeypatch.setattr(extract, "FIRST_WORDS", 1)
    assert found() == want


def test_curated_relations_go_before_rules(spark):
    found = spark.createDataFrame([(1, 10, "person"), (1, 20, "place"), (1, 30, "thing"), (2, 10, "person"), (2, 20, "place")], "id long, entity_id long, entity_type string")
    curated = spark.createDataFrame([(20, "HOME_OF", 10)], "src long, rel_type string, dst long")
    got = {(r.a, r.rel_type, r.b, r.texts) for r in extract.cooccurrence(found, "id", extract.TYPE_RULES, curated=curated).collect()}
    assert got == {(20, "HOME_OF", 10, 2), (10, "CO_OCCURS_WITH", 30, 1), (20, "CO_OCCURS_WITH", 30, 1)}


def test_readers(spark, tmp_path):
    (tmp_path / "en").mkdir()
    (tmp_path / "en/a.txt").write_text("plain")
    (tmp_path / "en/b.html").write_text("<html><head><title>x</title></head><body><p>One<br>two<script>no()</script><div class='notes'>skip</div></body>")
    (tmp_path / "en/c.json").write_text(json.dumps({"t": "uno", "n": 3, "l": ["dos", {"z": "tres"}]}))
    (tmp_path / "en/d.md").write_text("# Head\n\nSome *bold* [link](http://x)")
    (tmp_path / "en/a.txt.meta.json").write_text("{broken")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in readers.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "plain", "b.html": "One\ntwo", "c.json": "uno\ndos\ntres", "d.md": "Head\nSome bold link"}
    assert readers.sidecars(spark, str(tmp_path)).first().metadata == {}
    with pytest.raises(ValueError):
        readers.parse("x.pdf", b"")


def test_markdown():
    raw = "---\ntitle: x\n---\n# Head #\n\nTitle\n=====\n> quoted **bold _and_ more**\n\n1. item [link](http://a/(b)) `co*de*`\n- [x] done ~~gone~~\n\n| A | B |\n|---|:-:|\n| 1 | *2* |\n\n```py\n# kept *as* is\n```\n***\n[ref]: http://x\n<!-- no\n--> snake_case_word 2 * 3 * 4 \\*star\\*"
    assert readers.markdown_text(raw) == "Head\nTitle\nquoted bold and more\nitem link co*de*\ndone gone\nA\nB\n1\n2\n# kept *as* is\n snake_case_word 2 * 3 * 4 *star*"
    assert readers.html_text("<p>a<sup class='marker'>1</sup><span class='marker'>b</span></p>") == "a\nb"


def test_sidecars_and_skipped_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    (tmp_path / "a.meta.json").write_text('{"title": "T"}')
    (tmp_path / "bilingual-concept-bridge.json").write_text("{}")
    d = readers.scan(spark, str(tmp_path))
    meta = readers.sidecars(spark, str(tmp_path))
    got = {r.text: r.metadata for r in readers.with_sidecars(d, meta).collect()}
    assert got == {"one": {"title": "T"}, "two": {}}
    assert readers.scan(spark, str(tmp_path), paths=[str(tmp_path / "b.txt")]).count() == 1


def test_references(spark):
    texts = ["See Alma 5:3; 7:2, 4–6 and 1 Nephi 3.", "p. 3:4", None, "Gen. 1:1 (2-3)"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: [tuple(x) for x in r.x or []] for r in df.select("id", T.footnote_references(F.col("t")).alias("x")).collect()}
    assert got == {0: [("Alma", 5, 3, 3), ("Alma", 7, 2, 2), ("Alma", 7, 4, 6), ("1 Nephi", 3, None, None)], 1: [], 2: [], 3: [("Gen", 1, 1, 1), ("Gen", 1, 2, 3)]}
    found = df.select(T.references(F.col("t")).alias("x")).first().x
    assert [(r.book, r.chapter, r.verses) for r in found] == [("Alma", 5, "3"), ("1 Nephi", 3, "")]
    paths = spark.createDataFrame([("x/ES/scriptures/ot/gen/3.txt",), ("en\\scriptures\\dc\\76.txt",), ("en/books/1.txt",), (None,)], "p string").select(T.scripture_path(F.col("p")).alias("s"), T.is_below(F.col("p"), "scriptures").alias("b")).collect()
    assert [(None if r.s is None else tuple(r.s), r.b) for r in paths] == [(("es", "ot", "gen", 3), True), (("en", "dc", None, 76), True), (None, False), (None, None)]


def test_composed_text(spark):
    df = spark.createDataFrame([(1, "cafe\u0301", 2.0), (2, None, None)], "id long, t string, x double")
    assert [tuple(r) for r in T.composed(df, "t").orderBy("id").collect()] == [(1, "caf\u00e9", 2.0), (2, None, None)]


def test_sinks(spark, tmp_path):
    from lorekiln.sources import snapshots

    old = spark.createDataFrame([(1, [1.0, 2.0], "m"), (2, [1.0, 2.0], "m")], "chunk_id long, embedding array<float>, model_version string")
    new = spark.createDataFrame([(2, [3.0, 4.0], "m"), (2, [3.0, 4.0], "n")], old.schema)
    assert sorted((r.chunk_id, r.model_version, r.embedding[0]) for r in snapshots.upserted_embeddings(old, new, 2).collect()) == [(1, "m", 1.0), (2, "m", 3.0), (2, "n", 3.0)]
    with pytest.raises(Exception, match="length 2"):
        snapshots.upserted_embeddings(old, new, 3).collect()
    assert snapshots.without_files(spark.createDataFrame([("a", 1), ("b", 2)], "file_path string, n int"), spark.createDataFrame([("a",)], "file_path string")).count() == 1
    assert snapshots.stamp(spark, str(tmp_path), 1) == 1 and snapshots.stamp(spark, str(tmp_path), 2) == 2
    with pytest.raises(RuntimeError):
        snapshots.stamp(spark, str(tmp_path), 1)
    assert snapshots.write_all({"x": old, "y": new}, str(tmp_path / "w")) == {"x": 1, "y": 1}


def test_checkpoints_need_a_shared_folder(monkeypatch):
    from lorekiln import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())


def test_stream_takes_each_file_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    rows.coalesce(1).write.parquet(src)
    write = lambda b, i: b.write.mode("overwrite").parquet(f"{out}/{i}")
    for n in (2, 2):
        ingest_once(spark, src, rows.schema, write, str(tmp_path / "ck"))
        assert spark.read.parquet(f"{out}/*").count() == n
    rows.withColumn("k", F.col("k") + 2).coalesce(1).write.mode("append").parquet(src)
    ingest_once(spark, src, rows.schema, write, str(tmp_path / "ck"))
    assert spark.read.parquet(f"{out}/*").count() == 4


def test_without_the_training_data_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['lorekiln.llm'] = None; import __spark_entry__ as e; assert 'rrf_hybrid' in e.queries() and not any(k.startswith('p1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_snapshots_swap_whole(spark, tmp_path):
    from lorekiln.sources import snapshots

    root = str(tmp_path / "t")
    assert snapshots.versions(spark, root) == []
    for n in (1, 2, 3):
        assert snapshots.write(spark.range(n), root) == n
    assert snapshots.read(spark, root).count() == 3 and snapshots.versions(spark, root) == [2, 3]
    (tmp_path / "t/v4").mkdir()  # a run that died
    assert snapshots.read(spark, root).count() == 3


FAMILY = [
    ("Then Orin, son of Belthar, spoke.", {("Belthar", "FATHER_OF", "Orin")}),
    ("Ana hija de Rosa Luz vino.", {("Rosa Luz", "FATHER_OF", "Ana")}),
    ("Orin begat Tamur. Belthar engendró a Dov.", {("Orin", "FATHER_OF", "Tamur"), ("Belthar", "FATHER_OF", "Dov")}),
    ("Mara, the mother of Orin, and Dov, father of Tamur", {("Mara", "MOTHER_OF", "Orin"), ("Dov", "FATHER_OF", "Tamur")}),
    ("Mara, esposa de Dov; Sela, wife of Orin", {("Dov", "SPOUSE_OF", "Mara"), ("Orin", "SPOUSE_OF", "Sela")}),
    ("Dov, hermano de Orin. Sela the sister of Mara", {("Dov", "BROTHER_OF", "Orin"), ("Sela", "SISTER_OF", "Mara")}),
    ("Orin, son of Belthar, the son of Dov", {("Belthar", "FATHER_OF", "Orin"), ("Dov", "FATHER_OF", "Belthar")}),
    ("the son of man. Orin, son of Orin. ORIN BEL, son of Dov. Mount Orin, father of Dov. Dov, son of Dov Tamur. Dov, brother of Jared", set()),
]


def test_family_sentences(spark):
    from lorekiln.operators.family import family_edges

    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FAMILY)] + [(99, None), (98, "")], "id long, t string").withColumn("src", F.lit("clash"))
    got = {}
    for r in family_edges(rows, "id", "t").collect():
        got.setdefault(r.id, set()).add((r.src, r.rel_type, r.dst))
    assert got == {i: want for i, (_, want) in enumerate(FAMILY) if want}
    assert {r.src for r in family_edges(rows, "id", "t", ["Dov"]).where("id = 3").collect()} == {"Mara"}


def test_within_edits_against_brute_force(spark):
    rng = random.Random(8)
    texts = sorted({"".join(rng.choice("abñ ") for _ in range(rng.randint(0, 11))) for _ in range(250)} | {"blue bolt", "old bolt"})
    got = {(r.a, r.b, r.distance) for r in search.within_edits(spark.createDataFrame([(t,) for t in [*texts, None, "old bolt"]], "t string"), "t", 3).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    assert got == {(a, b, d) for a in texts for b in texts if a < b and (d := distance(a, b)) <= 3} and ("blue bolt", "old bolt", 3) in got


def test_ranges_overlap_however_written(spark):
    rows = [(1, "Book 9:1-6"), (2, "Book 9:5–9"), (3, "Book 9, 6-7"), (4, "Book 9:9"), (5, "Book 8:1-9"), (6, "p. 9"), (7, None), (8, "Book 9, 20")]
    got = extract.overlapping(extract.verse_ranges(spark.createDataFrame(rows, "id long, r string"), "id", "r"), "id")
    assert {(r.a, r.b) for r in got.collect()} == {(1, 2), (1, 3), (2, 3), (2, 4)}
    counts = extract.overlap_counts(extract.verse_ranges(spark.createDataFrame(rows, "id long, r string"), "id", "r"), "id")
    assert {r.id: r.links for r in counts.collect()} == {1: 2, 2: 3, 3: 2, 4: 1, 5: 0, 8: 0}
