"""Operators of retrieval, names, disambiguation and upkeep on small cases and against brute force."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lorekiln.functions import names as N
from lorekiln.functions.arrays import before
from lorekiln.operators import disambiguate, extract, graph, maintenance, retrieval, search
from lorekiln.plans import catalogue


def column(spark, values, build, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}").orderBy("i").select(build(F.col("v"))).collect()]


def test_running_sums(spark):
    rng = random.Random(3)
    xs = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1500)]
    assert column(spark, xs, before, "array<int>") == [[sum(x[:i]) for i in range(len(x))] for x in xs]


def test_variants_of_names(spark):
    names = ["• Orin", "→ Orin", "Orin’s", '"Orin', "Lydia LYDIA", "Lebana le'ba-na", "Orin;", "Orin", None, "a;"]
    got = column(spark, names, lambda c: F.to_json(N.stripped_variant(c)))
    assert [None if g is None else tuple(__import__("json").loads(g).values()) for g in got] == [("Orin", "bullet_prefix"), ("Orin", "arrow_prefix"), ("Orin", "possessive"), ("Orin", "leading_quote"), ("Lydia", "duplicated_word"), ("Lebana", "pronunciation_tail"), ("Orin", "trailing_punct"), None, None, None]


def test_numerals_questions_and_titles(spark):
    assert column(spark, ["XIV", "mcmxciv", "Seven", "12", "iiii", "Q", None], N.numeral) == [14, 1994, 7, 12, 4, None, None]
    assert column(spark, ["How many letters?", "List all the names", "¿Cuántos fueron?", "Who was Orin?", None], N.wants_all) == [True, True, True, False, False]
    assert column(spark, ["See Alma 5:3", "what is hope", "Did Orin know Belthar", "tell me about the old bridge of Orin", None], N.is_specific) == [True, False, True, True, False]
    assert column(spark, ["Elder Orin B. Vale", "Vale, Orin B.", "Orin B. Vale (1830)"], N.author_key) == ["orin b vale"] * 3
    assert column(spark, ["One line\ngoes on.\n\nNew para-\ngraph\nhere.", ""], N.unwrapped) == ["One line goes on.\n\nNew paragraph here.", ""]
    assert column(spark, ["x\n*** START OF THE BOOK ***\nText.\n[Transcriber's note: all mended]\nMore.\n*** END OF THE BOOK ***\ny"], N.without_boilerplate) == ["Text.\n\nMore."]
    notes = column(spark, ["He spoke [1: said\n softly] and left [Footnote 2: at noon]."], lambda c: F.to_json(N.footnotes(c)))[0]
    assert notes == '[{"mark":"1","note":"said softly"},{"mark":"2","note":"at noon"}]' and column(spark, ["He spoke [1: softly] and[3] left."], N.without_footnotes) == ["He spoke and left."]
    assert column(spark, ["2024-10", "1971", None], lambda c: N.event_name(F.lit("Fair"), c)) == ["Fair October 2024", "Fair 1971", "Fair"]
    assert column(spark, ["<b>Orin</b> said that Orin left", "nothing"], lambda c: N.window_around(c, F.lit("Orin"), 6)) == [" orin  s", "nothing"]


def test_query_language(spark):
    assert retrieval.parse_query('the Red lamp or "old bridge" -river OR the') == [[("red", True), ("lamp", True)], [("old bridge", True), ("river", False)]]
    assert retrieval.parse_query("") == retrieval.parse_query(None) == retrieval.parse_query("-only") == []
    docs = spark.createDataFrame([(1, "A red lamp"), (2, "The old bridge"), (3, "old stone bridge"), (4, "Old bridge by the river"), (5, None), (6, ""), (7, "lamps, red")], "id long, t string").withColumn("score", F.lit("clash"))
    ids = lambda q, **k: sorted(r.id for r in retrieval.find(docs, "id", "t", q, **k).collect())
    assert ids("red lamp") == [1] and ids('"old bridge"') == [2, 4] and ids('"old bridge" -river') == [2] and ids("lamp or bridge") == [1, 2, 3, 4] and ids("  ") == []
    assert ids("red lamps", token=retrieval.light_stem) == [1, 7] and ids("bridge", only=F.col("id") > 2) == [3, 4]


@pytest.mark.parametrize("numbers", [0, 2_000_000])
def test_nearest_against_brute_force(spark, monkeypatch, numbers):
    monkeypatch.setattr(search, "QUERY_NUMBERS", numbers)
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)] if i % 17 else None, i % 3) for i in range(300)] + [(900, [0.0] * 6, 0), (901, [1.0] * 3, 0)]
    v = spark.createDataFrame(rows, "id long, v array<double>, label int")
    cos = lambda x, y: round(sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) ** 0.5 * sum(b * b for b in y) ** 0.5), 6)
    got = {}
    for r in search.nearest(v, v.where("id % 40 = 1"), "id", "v", 5, block=3).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.id)
    for q, x, _ in rows:
        if q % 40 == 1:
            assert got[q] == [i for _, i in sorted((-cos(x, y), i) for i, y, _ in rows if y and len(y) == 6 and any(y))[:5]]
    grouped = search.nearest(v, v.where("id % 40 = 1").withColumn("grp", F.col("label")), "id", "v", 5, F.col("label")).collect()
    assert grouped and all(r.id % 3 == r.query % 3 or r.id >= 900 for r in grouped)


def test_percentiles_by_index(spark):
    rng = random.Random(5)
    rows = [("a", float(rng.randint(0, 50))) for _ in range(501)] + [("b", 1.0)] + [("c", None)] + [(None, float(i)) for i in range(10)]
    got = {r.g: (r.p0, r.p5, r.p9) for r in search.index_percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p0": 0.0, "p5": 0.5, "p9": 0.99}).collect()}
    for g in ("a", "b", None):
        x = sorted(v for h, v in rows if h == g and v is not None)
        assert got[g] == tuple(x[int(p * len(x))] for p in (0.0, 0.5, 0.99))


def test_disambiguation_rules_and_frames(spark):
    m = spark.createDataFrame([(1, "Orin", "King Orin wore the crown", "en/a"), (2, "Orin", "the tribe of Orin", "en/a"), (3, "Orin", "la tierra de Orin", "es/a"), (4, "Orin", "they came near Orin.", "en/a"), (5, "Orin (x)", "children of Orin (x) came", None), (6, "Orin", None, "en/a")], "key long, name string, text string, file_path string")
    rules = spark.createDataFrame([("orin", 1, "crown", None, "Orin the King", "high", "person"), ("Orin", 2, "orin", "^xx/", "Nobody", "high", "person")], "name string, priority int, pattern string, path_pattern string, resolved string, confidence string, entity_type string")
    got = {(r.key, r.resolved, r.confidence) for r in disambiguate.disambiguated(m, rules).collect()}
    assert got == {(1, "Orin the King", "high"), (2, "Orin (people)", "high"), (3, "Orin (place)", "high"), (5, "Orin (x) (people)", "high")}
    assert {r.confidence for r in disambiguate.by_frames(m).where("key = 4").collect()} == {"low"}
    d = spark.createDataFrame([(1, "Orin leads the Council today."), (2, "Nobody leads the Council.")], "id long, t string")
    found = spark.createDataFrame([(1, "Orin"), (1, "Council"), (2, "Council")], "id long, name string")
    assert [tuple(r) for r in disambiguate.related_by_pattern(d, "id", "t", found, [(r"(\w+) leads the (\w+)", "LEADS")]).collect()] == [(1, "Orin", "LEADS", "Council")]
    assert {r.name for r in disambiguate.name_sequences(d, "id", "t", ["today"]).collect()} == {"Council"}


def test_graph_reads(spark):
    e = spark.createDataFrame([(1, "Ann", "person"), (2, "Bob", "person"), (3, "Cid", "person"), (4, "Dee", "person"), (5, "Ann", "place")], "id long, name string, entity_type string")
    edges = spark.createDataFrame([(1, "FATHER_OF", 2), (2, "FATHER_OF", 3), (4, "MOTHER_OF", 3), (2, "SPOUSE_OF", 4)], "src long, rel_type string, dst long")
    t = graph.tree(edges, e, 2, 3)
    assert [p["name"] for p in t["parents"]] == ["Ann"] and [c["name"] for c in t["children"]] == ["Cid"] and t["spouses"] == [{"id": 4, "name": "Dee"}]
    a = spark.createDataFrame([(3, "Kid", "en")], "entity_id long, alias string, language string")
    got = {r.name: r.id for r in graph.resolved(spark.createDataFrame([("ann",), ("Kid",), ("Zed",)], "name string"), e, a).collect()}
    assert got == {"ann": 1, "Kid": 3, "Zed": None}
    assert {r.name: r.files for r in graph.files_of(e.select("name"), e, spark.createDataFrame([(1, "f"), (1, "f"), (5, "g"), (2, None)], "entity_id long, file_path string")).collect()} == {"Ann": ["f", "g"], "Bob": [], "Cid": [], "Dee": []}


def test_upkeep_on_empty_tables(spark):
    e = spark.createDataFrame([], "id long, name string, entity_type string")
    r = spark.createDataFrame([], "src long, rel_type string, dst long, confidence string, source string")
    assert maintenance.variant_merges(e, N.stripped_variant).count() == 0
    assert {x.what: x.n for x in maintenance.cleanup_report(e, r, F.array(F.lit(None).cast("string")), F.lower("name")).collect()} == {"entities": 0, "relations": 0, "garbage": 0, "losers": 0, "rewritten": 0, "loops": 0}
    assert maintenance.without_sources(e, r, ["x"])[0].count() == 0 and maintenance.without_sources(e, r, None)[1].count() == 0
    assert maintenance.safe_family(r, e, ["and"]).count() == 0


def test_chained_variants_are_left(spark):
    e = spark.createDataFrame([(1, "Orin", "p"), (2, "Orin;", "p"), (3, '"Orin;', "p"), (4, "Bel’s", "p"), (5, "Bel", "q")], "id long, name string, entity_type string")
    got = {r.id: (r.winner, r.verdict) for r in maintenance.variant_merges(e, N.stripped_variant).collect()}
    assert got == {2: (1, "chained"), 3: (2, "merge"), 4: (None, "no_canonical")}


@pytest.mark.parametrize("hook", [None, lambda texts: [[1.0, 1.0] for _ in texts]])
def test_embedding_hook(spark, hook):
    d = spark.createDataFrame([(1, "red lamp"), (2, ""), (3, None), (4, "red lamp")], "id long, t string")
    got = {r.id: r.embedding for r in retrieval.hashed_vectors(d, "id", "t", 16 if hook is None else 2, hook).collect()}
    assert got[1] == got[4] and sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5)
    assert hook is not None or got[2] is None and got[3] is None


def test_passages_by_reference(spark):
    r = spark.createDataFrame([(1, "es", "A", 1, 1, 4), (2, "es", "A", 1, 9, 12), (3, "en", "A", 1, 1, 9), (4, "en", "B", 2, 1, 3)], "id long, lang string, book string, chapter int, lo int, hi int")
    w = spark.createDataFrame([(10, "A", 1, 5), (11, "B", 2, None), (12, "C", 1, 1)], "request long, book string, chapter int, verse int")
    assert {(x.request, x.id) for x in retrieval.by_reference(r, w, "id").collect()} == {(10, 1), (11, 4)}


def test_verse_spans_anywhere_in_a_text(spark):
    head = "And the keepers of the lamp went down to the river and counted the stones there"
    solid, brief = "x" * 30 + "é " + "y" * 40, "Orin wept."
    verses = [("f", 3, head), ("f", 3, head), ("f", 7, head), ("f", 9, solid), ("f", 11, brief), ("g", 1, head.replace("keepers", "masters")), (None, 5, head), ("f", 12, "")]
    texts = [(1, "f", "3 " + head), (2, "f", "(" + head), (3, "f", "So it was:\n“" + head[:60]), (4, "f", head[:59]), (5, "f", "a" + solid), (6, "f", "They say " + brief), (7, "g", head), (8, None, head), (9, "f", None), (10, "f", ""), (None, "f", head), (11, "f", head[1:] + " " + head.lower()), (12, "f", solid[:60] + " " + brief + " " + head)]
    v = spark.createDataFrame(verses, "file_path string, verse int, body string")
    c = spark.createDataFrame(texts, "id long, file_path string, text string")
    got = {r.id: (r.first_verse, r.last_verse) for r in extract.verse_spans(c, v, "id").collect()}
    want = {}
    for i, f, t in texts:
        held = [n for g, n, b in verses if f is not None and t is not None and f == g and b and b[:60] in t]
        if held:
            want[i] = (min(held), max(held))
    assert got == want and want[2] == want[3] == (3, 7) and want[12] == (3, 11)


def test_verse_spans_dont_carry_texts(spark):
    words = [f"w{i % 997}" for i in range(4000)]
    c = spark.createDataFrame([(i, f"f{i % 3}", f"text {i} " + " ".join(words)) for i in range(40)], "id long, file_path string, text string")
    v = spark.createDataFrame([("f1", 4, " ".join(words[100:130]))], "file_path string, verse int, body string")

    def shuffled():
        return sum(s.shuffleWriteBytes() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))

    before = shuffled()
    assert {r.id for r in extract.verse_spans(c, v, "id").collect()} == set(range(1, 40, 3))
    assert shuffled() - before < 200_000  # the texts have 0.8 MB, with each of their words 3 GB


def test_verse_spans_of_short_verses_and_lines_that_go_on(spark, tmp_path):
    solid = "y" * 70
    texts = [
        (1, "f", "Heading\n3 Orin wept.  \n\n4 And the lamp\r\n  went out,\n and it was dark.\n5 " + solid),
        (2, "f", "they say Orin wept. Then it was so"),
        (3, "f", "And the lamp"),
        (4, "f", "“And the lamp went\nout, and it was\ndark. So"),
        (5, "f", "6 a"),
        (6, "g", "And it is Orin wept. " + solid),
        (7, "g", "1 a\rb\n2\x0bc \u2028d\x01e\n 9 no verse\n1234 no verse\n11 \n12"),
        (7, "g", "1 a\rb 2"),
        (8, None, "1 a"),
        (9, "h", None),
        (10, "h", ""),
        (None, "h", "8 Où?\n😀 wept"),
        (11, "h", "z Où? 😀 wept"),
    ]
    spark.createDataFrame(texts, "id long, file_path string, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    got = {(r.id, r.first_verse, r.last_verse) for r in catalogue.queries()["verse_spans"](spark, str(tmp_path)).collect()}
    assert got == {(1, 3, 6), (2, 3, 6), (3, 6, 6), (4, 4, 6), (5, 6, 6), (7, 1, 2), (None, 8, 8), (11, 8, 8)}
    con = duckdb.connect()
    con.execute(f"create view chunks as select * from '{tmp_path}/chunks.parquet/*.parquet'")
    assert set(con.execute(catalogue.oracle_sql()["verse_spans"]).fetchall()) == got
