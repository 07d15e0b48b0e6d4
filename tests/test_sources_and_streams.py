"""Curated files, offline readers, notes, sync of a folder and stateful streams on small fixtures."""

import io
import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorekiln.operators import chunking, corpus, notes
from lorekiln.sources import curated, snapshots
from lorekiln.streaming import ingest


def test_dictionary_file(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"person": [{"name": "Orin", "aliases": ["The Elder Orin", "Bel"]}, {"name": "Bel"}], "place": [{"name": "bel", "aliases": ["Thelva", "the"]}, {"aliases": ["x"]}]}))
    got = {(r.term, r.name, r.entity_type) for r in curated.gazetteer_file(spark, str(tmp_path / "g.json")).collect()}
    assert got == {("orin", "Orin", "person"), ("elder orin", "Orin", "person"), ("bel", "Orin", "person"), ("thelva", "bel", "place")}
    assert curated.gazetteer_file(spark, str(tmp_path / "none.json")).count() == 0


def test_seed_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"KNOWS": [{"from": {"name": "A", "type": "p"}, "to": {"name": "B", "type": "p"}, "bidirectional": True}, {"from": {"name": "A"}}], "RULES": [{"from": {"name": "A", "type": "p"}, "to": {"name": "C", "type": "q"}, "confidence": "llm_high", "source_ref": "x 1"}]}))
    got = {(r.src, r.rel_type, r.dst, r.confidence, r.source) for r in curated.seed_relations(spark, str(tmp_path / "s.json")).collect()}
    assert got == {("A", "KNOWS", "B", "curated", "curated_seed"), ("B", "KNOWS", "A", "curated", "curated_seed"), ("A", "RULES", "C", "llm_high", "curated_seed")}
    (tmp_path / "t1.json").write_text('[{"subject": "a", "predicate": "is", "object": "b"}, {"subject": "a"}]')
    (tmp_path / "t2.json").write_text('{"triples": [{"subject": "c", "predicate": "is", "object": "d"}]}')
    assert {(r.subject, r.object) for r in curated.seed_triples(spark, str(tmp_path / "t*.json")).collect()} == {("a", "b"), ("c", "d")}
    (tmp_path / "f.json").write_text('[{"from": "v/b/1", "to": "v/b/2"}, {"from": "v/b/1", "to": "v/b/1"}]')
    assert curated.footnote_links(spark, str(tmp_path / "f.json")).count() == 4
    (tmp_path / "books.json").write_text('[{"book": "A", "n": 3}]')
    assert curated.structure_tables(spark, str(tmp_path), ["books"])["books"].first().n == 3


def test_epubs(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("META-INF/container.xml", "<container><rootfiles><rootfile full-path='o/c.opf'/></rootfiles></container>")
        z.writestr("o/c.opf", "<package><manifest><item id='b' href='2.html'/><item id='a' href='1.html'/><item id='x' href='0.html'/></manifest><spine><itemref idref='x'/><itemref idref='a'/><itemref idref='b'/><itemref idref='gone'/></spine></package>")
        z.writestr("o/0.html", "<html><head><title>t</title></head><body><p>Copyright 1999</p></body></html>")
        z.writestr("o/1.html", "<html><body><h1>One</h1><p>Some <i>text</i><p>more</body></html>")
        z.writestr("o/2.html", "<p>Last</p>")
    (tmp_path / "a.epub").write_bytes(b.getvalue())
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    got = [(r.chapter, r.place, r.element, r.text) for r in curated.epubs(spark, str(tmp_path)).orderBy("chapter", "place").collect()]
    assert got == [(0, 0, "h1", "One"), (0, 1, "p", "Some text"), (0, 2, "p", "more"), (1, 0, "p", "Last")]


def test_sql_dumps(spark, tmp_path):
    (tmp_path / "d.sql").write_text("CREATE TABLE t (a int);\nINSERT INTO `t` (a, b) VALUES (1, 'it''s; (one)'), (2, 'a\\'b\\n'),\n (3, NULL);\nINSERT INTO u VALUES (-4.5);\n")
    got = {(r.table, tuple(r.row)) for r in curated.dump_rows(spark, str(tmp_path / "d.sql")).collect()}
    assert got == {("t", ("1", "it's; (one)")), ("t", ("2", "a'b\n")), ("t", ("3", None)), ("u", ("-4.5",))}


def test_pages_and_dictionaries():
    assert curated.structured_text("<h2>Head</h2><p>Text <b>bold</b><aside>Note</aside><li>Item") == "## Head\n\nText bold\n\n> Note\n\n- Item"
    assert curated.table_rows("<table><tr><th>Year<th>Event</tr><tr><td>600 <b>BC</b></td><td>Left</td></tr></table>") == [["Year", "Event"], ["600 BC", "Left"]]
    assert curated.dictionary_entries("<d><entry><term>ark</term><def>A <i>chest</i></def></entry><entry><term>x</term></entry></d>") == [("A", "ark", "A chest")] and curated.dictionary_entries("<d>") == []


NOTES = [
    (None, "other", None, None),
    ("", "other", None, None),
    ('3. Orin B. Vale, “The Lamp,” Ensign, May 1999, 12.', "talk_ref", "The Lamp", "Orin B. Vale"),
    ('"Our Keepers," Ensign, June 1998, 33.', "talk_ref", "Our Keepers", None),
    ("In Conference Report, Apr. 1979, 77.", "talk_ref", None, None),
    ('See “Come Home,” Hymns, no. 8.', "hymn_ref", "Come Home", None),
    ("Teachings of the Prophet Orin Vale", "book_ref", "Teachings of the Prophet Orin Vale", "Orin Vale"),
    ("The Long Road (1901), 5", "book_ref", "The Long Road", None),
    ("See Alma 5:3; Mosiah 2:3–4.", "scripture", None, None),
    ("2. Hope is said to be old.", "other", None, None),
]


def test_notes(spark):
    df = spark.createDataFrame([(i, n[0]) for i, n in enumerate(NOTES)], "id long, n string").withColumn("talk", F.lit("T"))
    got = [(r.p.note_type, r.p.cited_title, r.p.cited_author) for r in df.select("id", notes.parsed_note(F.col("n")).alias("p")).orderBy("id").collect()]
    assert got == [n[1:] for n in NOTES]
    rel = {(r.src, r.rel_type, r.dst) for r in notes.note_relations(df, "talk", "n").collect()}
    assert rel == {("T", "REFERENCES", "The Lamp"), ("The Lamp", "DELIVERED_BY", "Orin B. Vale"), ("T", "REFERENCES", "Our Keepers"), ("T", "CITES", "Come Home"), ("T", "REFERENCES", "Teachings of the Prophet Orin Vale"), ("T", "REFERENCES", "The Long Road")}
    s = spark.createDataFrame([("Body.\n\nNotes\n1. One\ngoes on.\n2. Two",), ("Only body",)], "t string").select(notes.split_notes(F.col("t")).alias("s")).collect()
    assert [(x.s.body, x.s.notes) for x in s] == [("Body.", ["1. One goes on.", "2. Two"]), ("Only body", [])]
    side = spark.createDataFrame([("a", {"title": "T", "speaker": "Elder Orin Vale", "lang": "ENG", "calling": "Of the Seventy"}), ("b", {})], "stem string, metadata map<string,string>")
    assert [tuple(r)[1:5] for r in notes.talks_from_sidecars(side).orderBy("stem").collect()] == [("T", "Orin Vale", "Seventy", None), (None, None, None, None)]


def test_sync_of_a_folder(spark, tmp_path):
    root, state = tmp_path / "corpus", str(tmp_path / "state")
    (root / "en").mkdir(parents=True)
    for name in "abc":
        (root / f"en/{name}.txt").write_text(f"Text of {name}. More.")
    split = lambda f: chunking.chunked(f, "file_path", "text", 3, 0)
    go = lambda paths=None: ingest.sync_folder(spark, str(root), state, split, F.lit("2024-01-01"), paths)
    assert go() == {"new": 3} and go() == {"unchanged": 3}
    (root / "en/a.txt").write_text("Changed.")
    (root / "en/b.txt").unlink()
    (root / "en/d.txt").write_text("New.")
    assert go(["en/d.txt"]) == {"new": 1}
    assert go() == {"changed": 1, "deleted": 1, "unchanged": 2}
    texts = {(r.file_path, r.text) for r in snapshots.read(spark, state + "/chunks").collect()}
    assert texts == {("en/a.txt", "Changed."), ("en/c.txt", "Text of c."), ("en/c.txt", "More."), ("en/d.txt", "New.")}
    assert {r.file_path: r.chunk_count for r in snapshots.read(spark, state + "/registry").collect()} == {"en/a.txt": 1, "en/c.txt": 2, "en/d.txt": 1}
    m = spark.createDataFrame([(1, "x"), (2, "y"), (2, "x")], "entity_id long, file_path string")
    assert [r.entity_id for r in ingest.stale_entities(m, spark.createDataFrame([("y", "changed"), ("x", "new")], "file_path string, change string")).collect()] == [2]


def test_counters_end(spark, tmp_path):
    src, out = str(tmp_path / "in"), []
    t = datetime(2024, 1, 1)
    schema = "name string, ts timestamp"
    save = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    save([("a", t), ("a", t + timedelta(hours=1)), ("b", t), (None, t)])

    def run():
        q = ingest.counted_candidates(spark.readStream.schema(schema).parquet(src), 30).writeStream.outputMode("update").foreachBatch(lambda b, i: out.append({r.name: r.frequency for r in b.collect()})).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        seen = {k: v for d in out for k, v in d.items()}
        out.clear()
        return seen

    assert run() == {"a": 2, "b": 1}
    save([("a", t + timedelta(days=20))])
    assert run() == {"a": 3}
    save([("c", t + timedelta(days=80))])  # moves the watermark past everything
    assert run() == {"c": 1}
    save([("a", t + timedelta(days=80))])
    assert run() == {"a": 1}  # the old count had ended


def test_chapters_batches_and_backlogs(spark):
    d = spark.createDataFrame([(1, "Foreword\nCHAPTER IV. The Lamp\nBody.\nCHAPTER Five. Road\nMore."), (2, "Nothing"), (3, None)], "id long, t string")
    got = [(r.id, r.chapter_no, r.number, r.title, r.body) for r in corpus.chapters(d, "id", "t", r"^CHAPTER (\w+)\. (.*)$").orderBy("id", "chapter_no").collect()]
    assert got == [(1, 0, None, None, "Foreword"), (1, 1, 4, "The Lamp", "Body."), (1, 2, 5, "Road", "More."), (2, 0, None, None, "Nothing")]
    f = spark.createDataFrame([(f"{d}/{i}",) for d, n in (("a", 3), ("b", 5), ("c", 1), ("d", 9)) for i in range(n)], "file_path string")
    assert [(r.folder, r.batch) for r in corpus.batches(f, 6).orderBy("folder").collect()] == [("a", 0), ("b", 0), ("c", 1), ("d", 1)]
    b = spark.createDataFrame([("x", "queued"), ("y", "queued")], "slug string, status string")
    fs = spark.createDataFrame([("x", "downloaded", "update", "downloaded"), ("y", "orphan", "orphan", "missing")], "slug string, check string, finding string, status string")
    assert {r.slug: r.status for r in corpus.applied(b, fs, ["downloaded", "orphan"]).collect()} == {"x": "downloaded", "y": "queued"}
    assert corpus.filtered(b, slug="x", status=True).count() == 1 and corpus.filtered(b, slug=["x", "y"], status=None).count() == 2 and corpus.filtered(b, status=False).count() == 0


@pytest.mark.parametrize("text,want", [('{"relations": []}', 0), ("no json", 0), (None, 0), ('x {"from_name": "a", "rel_type": "TEACHES", "to_name": "b"} y', 1), ('{"relations": [{"from_name": "a", "rel_type": "TEACHES", "to_name": "b"}, {"from', 1)])
def test_salvage(spark, text, want):
    assert corpus.salvaged(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t").count() == want


def test_verses_and_footnotes_of_pages():
    page = "<p class='verse'><span class='verse-number'>1 </span>In the <sup class='marker'>a</sup>beginning<br>was<p class='verse'><span class='verse-number'>2 </span>light.</p><p>x</p><ul><li class='footnote'><span class='footnote-marker'>a.</span> See <i>Alma</i> 5.<li class='footnote'><span class='footnote-marker'>b</span></li></ul>"
    assert curated.page_verses(page) == [(1, "In the beginning was"), (2, "light.")]
    assert curated.page_footnotes(page) == [("a", "See Alma 5.")]


def test_one_run_at_a_time(spark, tmp_path):
    with ingest.one_run(spark, str(tmp_path)):
        with pytest.raises(RuntimeError):
            with ingest.one_run(spark, str(tmp_path)):
                pass
    with ingest.one_run(spark, str(tmp_path)):
        pass


def test_progress_and_hooks(spark, tmp_path):
    p = ingest.Progress()
    spark.streams.addListener(p)
    try:
        spark.range(5).write.parquet(str(tmp_path / "in"))
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if p.ended:
                break
            __import__("time").sleep(0.1)
        assert sum(p.rows.values()) == 5 and list(p.ended.values()) == [None]
    finally:
        spark.streams.removeListener(p)
    d = spark.createDataFrame([(1, "One. Two. Three."), (2, None)], "id long, t string")
    assert {r.id: r.summary for r in corpus.summarised(d, "id", "t").collect()} == {1: "One. Two.", 2: None}
    assert corpus.stated_by_model(d, "id", "t", 5).count() == 0
    answer = lambda df: df.select("id", F.lit('{"relations": [{"from_name": "a", "rel_type": "TEACHES", "to_name": "b"}]}').alias("response"))
    assert corpus.stated_by_model(d, "id", "t", 1, answer).count() == 1


def test_hierarchies_and_page_artefacts(spark):
    from lorekiln.functions import names as N
    from lorekiln.operators import graph

    rows = spark.createDataFrame([(1, None, "en"), (2, 1, "a"), (3, 2, "b"), (4, 9, "lost"), (5, 6, "x"), (6, 5, "y")], "id long, parent long, name string")
    files = spark.createDataFrame([("en/a/f.txt",), (None,)], "file_path string")
    assert {(r.id, r.path, r.level, r.present) for r in graph.resolved_paths(rows, files).collect()} == {(1, "en", 0, True), (2, "en/a", 1, True), (3, "en/a/b", 2, False)}
    t = spark.createDataFrame([("The ﬁrst di-\nvision\n- 12 -\nTHE LAMP 13\ngoes on.\fxii\nEnd",)], "t string").select(N.without_page_artefacts(F.col("t"), ["The Lamp"]).alias("t")).first().t
    assert t == "The first division goes on. End"


def test_known_relations(spark):
    from lorekiln.operators import maintenance

    found = spark.createDataFrame([(1, "Orin", "FATHER_OF", "Dov"), (1, "Orin", "FATHER_OF", "Sela"), (2, "Orin", "FATHER_OF", "Dov")], "id long, src string, rel_type string, dst string")
    known = spark.createDataFrame([(1, "orin", "Orin the Elder"), (1, "Dov", None)], "id long, name string, resolved string")
    assert [tuple(r) for r in maintenance.known_relations(found, known, "id").collect()] == [(1, "Orin the Elder", "FATHER_OF", "Dov")]
