"""Operators over text: rules on small cases, brute force, and the awkward inputs each must bear."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekiln.llm import bitext, langid, mixing, packing, private, scans, splitting, tokens

CHUNKS = "id long, file_path string, chunk_index int, text string, start_char int, language string"


def chunks(spark, rows):
    return spark.createDataFrame(rows, CHUNKS).withColumn("chunk_id", F.lit("clash")).withColumn("line", F.lit(1)).withColumn("lang", F.lit("x"))


LONG = "word " * 9000
AWKWARD = [(1, "en/a.txt", 0, None, None, None), (2, "en/a.txt", 1, "", 0, "en"), (3, None, None, "One. Two.", 0, ""), (4, "en/b.txt", 0, LONG, -5, "en"), (4, "en/b.txt", 0, LONG, -5, "en"), (5, "es/b.txt", 0, "   \n\n ", 0, "es")]


# splitting -----------------------------------------------------------------------------------------------------------
UNITS = ["Dr. Orin spoke at 6 a.m. about hope… again (p. 22). ", "“Have you seen it?” ", "Let us go!\n", "12 Verse one.\n", "- An item, cf. vv. 3–4 of vol. II.\n", "## 7.1 On truth\n", "The chronicle... ends here.", "No space before. "]


def test_unit_starts(spark):
    starts, at = [], 0
    for u in UNITS:
        starts.append(at)
        at += len(u)
    text = "".join(UNITS)
    for most, overlap in ((1000, 100), (60, 10), (25, 5)):  # whatever the pieces, the same units are met
        got = spark.createDataFrame([(text,)], "t string").select(splitting.pieces(F.col("t"), most, overlap).alias("p")).first().p
        assert [s for p in got for s in p.unit_starts] == starts


def test_prefix_sums(spark):
    rng = random.Random(3)
    for n in (0, 1, 255, 256, 257, 1500):
        xs = [rng.randint(0, 9) for _ in range(n)]
        got = spark.createDataFrame([(xs,)], "x array<int>").select(splitting.before(F.col("x")).alias("s")).first().s
        assert got == [sum(xs[:i]) for i in range(n)]


def test_pieces_cover_the_text(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(UNITS) for _ in range(rng.randint(0, 40))) for _ in range(30)] + ["x" * 500, "", "ñ😀" * 300]
    rows = [(i, "en/f.txt", i, t, 0, "en") for i, t in enumerate(texts)]
    got = splitting.split_chunks(chunks(spark, rows), 150, 20).orderBy("chunk_index").collect()
    by = {}
    for r in got:
        by.setdefault(r.chunk_id, []).append(r)
        assert len(r.text) <= 150
    assert [r.chunk_index for r in got] == list(range(len(got)))
    for i, t in enumerate(texts):
        ps, at = by[i], 0
        for p in ps:
            assert t[p.start_char : p.end_char] == p.text and p.start_char <= at and (p.piece_no == 0 or p.start_char >= at - 20)
            at = p.end_char
        assert at == len(t)


def test_splitting_bears_awkward_rows(spark):
    got = splitting.split_chunks(chunks(spark, AWKWARD), 1500, 120).collect()
    assert max(len(r.text) for r in got) <= 1500 and {r.chunk_id for r in got} == {2, 3, 4, 5}
    mixed = [(i, *f, "One. Two.", 0, "en") for i, f in enumerate([("a", None), ("a", 1), ("a", 0), (None, 3), (None, None), ("a", None)])]
    assert [r.chunk_index for r in splitting.split_chunks(chunks(spark, mixed), 1500, 120).orderBy("chunk_id").collect()] == [2, 1, 0, 0, 0, 3]
    assert splitting.split_chunks(chunks(spark, []), 1500, 120).count() == 0


# scans ---------------------------------------------------------------------------------------------------------------
CLEAN = "The council of the town sold the copper lamp for nine coins and the teacher spoke about patience according to the record. " * 12
PAGE = "The council of the town sold the cop-\nper lamp for nine coins and the te acher\nspoke about pat1ence according to the\n\nThe Book Of The Lamp\n- 12 -\n\nrecord. The counci|l of the town sold\nthe copper lamp.\n"


def test_scan_defects(spark):
    rows = [(i, "en/plain.txt", i, CLEAN, 0, "en") for i in range(5)] + [(10, "en/scan.txt", 0, PAGE, 0, "en"), (11, "en/scan.txt", 1, PAGE, 0, "en")]
    got = {(r.line_no, r.defect) for r in scans.defects(chunks(spark, rows)).collect() if r.chunk_id == 10}
    assert got == {(0, "hyphen"), (1, "misread"), (2, "misread"), (4, "header"), (5, "page_number"), (7, "misread")}
    text = " ".join(r.text for r in scans.repaired(chunks(spark, rows)).where("chunk_id = 10").orderBy("paragraph_no").collect())
    assert text == "The council of the town sold the copper lamp for nine coins and the teacher spoke about patience according to the record. The council of the town sold the copper lamp."


def test_a_title_of_the_author_stays(spark):
    page = "The council of the town sold the cop-\nper lamp for nine coins and the teacher\nspoke about patience.\n\nTHE LOST LAMP\n\nThe teacher spoke about patience accor-\nding to the record and the council of\nthe town sold nine coins.\n"
    rows = [(i, "en/plain.txt", i, CLEAN, 0, "en") for i in range(5)] + [(10, "en/scan.txt", 0, page, 0, "en")]
    assert {(r.line_no, r.defect) for r in scans.defects(chunks(spark, rows)).collect()} == {(0, "hyphen"), (6, "hyphen")}
    assert "THE LOST LAMP" in " ".join(r.text for r in scans.repaired(chunks(spark, rows)).collect())
    # the same title over every page is none
    rows += [(11, "en/scan.txt", 1, page, 0, "en")]
    assert {(r.chunk_id, r.line_no) for r in scans.defects(chunks(spark, rows)).where("defect = 'header'").collect()} == {(10, 4), (11, 4)}


def test_short_scans_and_divisions_across_chunks(spark):
    rows = [(i, "en/plain.txt", i, CLEAN, 0, "en") for i in range(5)] + [(10, "en/s.txt", 0, "The teacher sold the cop-\nper lamp for nine pa-", 0, "en"), (11, "en/s.txt", 1, "tience coins and the\nrecord.", 0, "en"), (12, None, None, "The teacher sold the cop-\nper lamp.", 0, "en")]
    got = {(r.chunk_id, r.line_no, r.defect) for r in scans.defects(chunks(spark, rows)).collect()}
    assert got == {(10, 0, "hyphen"), (10, 1, "hyphen"), (12, 0, "hyphen")}
    text = {r.chunk_id: r.text for r in scans.repaired(chunks(spark, rows)).collect()}
    assert text == {10: "The teacher sold the copper lamp for nine patience", 11: "coins and the record.", 12: "The teacher sold the copper lamp."}


def test_scans_bear_awkward_rows(spark):
    assert scans.defects(chunks(spark, AWKWARD)).count() == 0
    assert scans.defects(chunks(spark, [])).count() == 0
    assert scans.repaired(chunks(spark, [])).count() == 0


def test_skeletons_agree(spark):
    pairs = [("storm", "storrn"), ("shepherd", "shephcrd"), ("returned", "returnecl"), ("viudas", "viiidas"), ("durante", "durarite"), ("hablaba", "liablaba"), ("bronce", "hronce"), ("name", "narne")]
    df = spark.createDataFrame(pairs, "a string, b string").select(scans.skeleton(F.col("a")).alias("a"), scans.skeleton(F.col("b")).alias("b"))
    assert all(r.a == r.b for r in df.collect())


# languages -----------------------------------------------------------------------------------------------------------
WORDS = {"en": "the of and that was with from they shepherd river bridge hope".split(), "es": "el de los que con para una ciudad puente esperanza río señor".split(), "fr": "le des que avec pour une les dans pont rivière été où".split(), "pt": "o dos que com para uma não as ponte rio coração são".split()}


def sentence(rng, lang):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(12)).capitalize() + "."


def test_network_gradient():
    net = langid.Network(4)
    x, n = langid.padded([b"hello there", "señor".encode(), b"a"])
    label = np.array([0, 1, 2])
    grads = net.gradients(x, n, label)

    def loss():
        net._kept = None
        lp = net.log_probabilities(x)
        return -sum(lp[label[j], : n[j], j].sum() for j in range(3)) / n.sum()

    for k, g in grads.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        v, e = net.p[k][i], 1e-2
        net.p[k][i] = v + e
        up = loss()
        net.p[k][i] = v - e
        down = loss()
        net.p[k][i] = v
        assert g[i] == pytest.approx((up - down) / (2 * e), rel=0.02, abs=1e-4)


def test_languages_held_out(spark):
    rng = random.Random(3)
    net = langid.train([(" ".join(sentence(rng, k) for _ in range(4)), k) for k in WORDS for _ in range(60)], steps=150)
    rows = [(i, None, 0, " ".join(sentence(rng, a) for _ in range(3)) + " / " + " ".join(sentence(rng, b) for _ in range(3)), 0, None) for i, (a, b) in enumerate((a, b) for a in WORDS for b in WORDS)]
    got = {}
    for r in langid.segments(chunks(spark, rows).drop("chunk_id"), net).orderBy("chunk_id", "segment_no").collect():
        got.setdefault(r.chunk_id, []).append(r.lang)
        assert 0 <= r.confidence <= 1
    want = {i: [a] if a == b else [a, b] for i, (a, b) in enumerate((a, b) for a in WORDS for b in WORDS)}
    assert sum(got[i] == want[i] for i in want) >= 15
    assert {r.chunk_id for r in langid.segments(chunks(spark, AWKWARD), net).collect()} == {3, 4}
    assert langid.segments(chunks(spark, []), net).count() == 0 and langid.labelled_sample(chunks(spark, [])) == []


# bilingual works -----------------------------------------------------------------------------------------------------
GLOSSARY = [("hope", "la esperanza"), ("mercy", "la misericordia"), ("the copper lamp", "la lámpara de cobre"), ("Thelvane", "Telvano"), ("Orumah", "Oruma"), ("the bridge", "el puente"), ("justice", "la justicia"), ("patience", "la paciencia")]


def works(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for w in range(12):
        en, es = [], []
        for _ in range(8):
            a, b, k = rng.choice(GLOSSARY[:3] + GLOSSARY[5:]), rng.choice(GLOSSARY[3:5]), rng.randint(2, 90)
            en.append(f"{b[0]} sold {a[0]} for {k} coins.")
            es.append(f"{b[1]} vendió {a[1]} por {k} monedas.")
        es[2], es[6] = es[6], es[2]
        del es[4]
        rows += [(n, f"en/t/{w}.txt", 0, " ".join(en), 0, "en"), (n + 1, f"es/t/{w}.txt", 0, " ".join(es), 0, "es")]
        n += 2
    return rows


def test_alignment(spark):
    rows = works(spark)
    rows += [(500, *rows[0][1:])]  # a copy
    got = bitext.alignment(chunks(spark, rows).drop("chunk_id"), None, GLOSSARY).collect()
    for w in range(12):
        pairs = {(r.sentence_a, r.sentence_b) for r in got if r.chunk_id_a == 2 * w and r.chunk_id_b == 2 * w + 1}
        assert {(0, 0), (1, 1), (2, 5), (3, 3), (5, 4), (6, 2), (7, 6)} == pairs
    assert sum(r.chunk_id_b == 500 for r in got) == 7


@pytest.mark.parametrize("n,gone", [(1600, (0, 0)), (5000, (600, 1100))])
def test_long_works_align_whole(spark, n, gone):
    keep = [i for i in range(n) if not gone[0] <= i < gone[1]]
    number = [100_000 + i * 7919 % 900_001 for i in range(n)]
    en = [f"{GLOSSARY[i % 5][0]} sold {GLOSSARY[i % 3][0]} for {number[i]} coins." for i in range(n)]
    es = [f"{GLOSSARY[i % 5][1]} vendió {GLOSSARY[i % 3][1]} por {number[i]} monedas." for i in keep]
    rows = [(k * 1000 + i, f"{side}/w.txt", i // 40, " ".join(x[i : i + 40]), 0, side) for k, (side, x) in enumerate((("en", en), ("es", es))) for i in range(0, len(x), 40)]
    rows = [(j, *r[1:]) for j, r in enumerate(rows)]
    index = {r[0]: r[2] for r in rows}
    got = {(index[r.chunk_id_a] * 40 + r.sentence_a, index[r.chunk_id_b] * 40 + r.sentence_b) for r in bitext.alignment(chunks(spark, rows).drop("chunk_id"), None, GLOSSARY).collect()}
    want = {(i, j) for j, i in enumerate(keep)}
    assert min(len(got & want) / len(want), len(got & want) / len(got)) >= 0.99, (len(got), len(want), len(got & want))


def test_an_abridgement_aligns(spark):
    rows = works(spark)
    long = rows[0][3] + " " + " ".join(f"Nobody spoke of {a} on day {i}." for i, a in enumerate("rain snow wind fire dust corn wool salt milk iron".split() * 6))
    rows[0] = (rows[0][0], rows[0][1], 0, long, 0, "en")
    got = bitext.alignment(chunks(spark, rows).drop("chunk_id"), None, GLOSSARY).where("chunk_id_a = 0").collect()
    assert {(r.sentence_a, r.sentence_b) for r in got} >= {(0, 0), (1, 1), (3, 3), (5, 4)}


def test_merges_of_three():
    rng = np.random.default_rng(2)
    unit = lambda x: (x / np.linalg.norm(x, axis=-1, keepdims=True)).astype("f4")
    a = unit(rng.standard_normal((30, 40)))
    b = unit(np.stack([*a[:10], a[10:13].sum(0), *a[13:20], a[20:23].sum(0), *a[23:]]))
    want = {(i, i) for i in range(10)} | {(i, 10) for i in (10, 11, 12)} | {(i, i - 2) for i in range(13, 20)} | {(i, 18) for i in (20, 21, 22)} | {(i, i - 4) for i in range(23, 30)}
    assert {(i, j) for i, j, _ in bitext.align(a, b)} == want and {(j, i) for i, j, _ in bitext.align(b, a)} == want


def test_sums_of_groups():
    m = np.arange(8, dtype="f4").reshape(4, 2)
    assert bitext._sums(m, np.array([0, 1, 3]), [0, 2, 0, 1]).tolist() == [[0, 0], [2, 4], [0, 0], [6, 7]]


def test_alignment_bears_awkward_rows(spark):
    assert bitext.alignment(chunks(spark, AWKWARD), None, []).count() == 0
    assert bitext.alignment(chunks(spark, []), spark.createDataFrame([], "src_file_path string, dst_file_path string, rel_type string"), [(None, "x")]).count() == 0


def test_coarse_to_fine_matches_the_full_path():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((90, 20)).astype("f4")
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    keep = [i for i in range(90) if i % 11]
    b = a[keep] + 0.05 * rng.standard_normal((len(keep), 20)).astype("f4")
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    assert {(i, j) for i, j, _ in bitext.align(a, b)} >= {(i, j) for j, i in enumerate(keep)}


# containers and mixtures ---------------------------------------------------------------------------------------------
def test_token_counts_are_exact():
    c = tokens.counter(tokens.TOKENIZER_DIR + "/" + tokens.RANK_FILE)
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(["a", "don't", " ", "  ", "\n", "\n\n", "señor", ",", "12", " . ", "\t", "x y"]) for _ in range(rng.randint(0, 15)))
        assert c.count(t) == len(c.encoder.encode_ordinary(t))


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([3, 40, 200, 900, 2048, 2049, 7000])) for i in range(400)] + [(900, 0), (901, None), (None, 5), (7, 40)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int").withColumn("lot", F.lit("clash"))
    got = packing.pack(df, 2048, lot_tokens=100_000).collect()
    used, parts = {}, {}
    for r in got:
        if r.container is not None:
            used[r.lot, r.container] = used.get((r.lot, r.container), 0) + r.piece_tokens
        parts[r.doc_id] = parts.get(r.doc_id, 0) + (r.piece_tokens or 0)
        assert r.doc_id is None or r.n_pieces == 1 or rows[r.doc_id][1] > 2048
    assert max(used.values()) <= 2048 and 1 - sum(used.values()) / (2048 * len(used)) < 0.06
    assert parts[3] == rows[3][1] and parts[7] == rows[7][1] + 40 and {r.doc_id for r in got if r.container is None} == {900, 901} and parts[None] == 5
    assert packing.pack(df.limit(0), 2048).count() == 0


def test_packing_balances_costs():
    rng = np.random.default_rng(4)
    sizes = np.sort(np.minimum(2048, rng.lognormal(5, 1, 3000).astype(int) + 1))[::-1]
    ours, plain = packing.balanced(sizes, 2048), packing.first_fit(sizes, 2048)
    assert packing.cost_spread(sizes, ours) < 0.8 * packing.cost_spread(sizes, plain) and ours.max() <= 1.03 * plain.max()


def test_large_budgets_are_met():
    rng = random.Random(9)
    for _ in range(20):  # beyond the bound of the dynamic programme: whole documents, then an exact rest
        counts = {rng.randint(1, 3000): rng.randint(1, 200) for _ in range(60)} | {1: 40, 7: 30}
        budget = rng.randint(mixing.REST + 1, sum(k * v for k, v in counts.items()) - 1)
        take = mixing.fit(counts, budget)
        assert all(0 < n <= counts[k] for k, n in take.items()) and sum(k * n for k, n in take.items()) == budget


def test_budget_fitting_against_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}
        budget = rng.randint(0, 40)
        sums = {0}
        for k, v in counts.items():
            sums = {s + k * n for s in sums for n in range(v + 1)}
        take = mixing.fit(counts, budget)
        assert all(0 < n <= counts[k] for k, n in take.items())
        assert sum(k * n for k, n in take.items()) == max(s for s in sums if s <= budget)


def test_mixture(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", " A ", "b", "c", None, "z"]), rng.randint(0, 60)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int").withColumn("u", F.lit(1)).withColumn("n", F.lit(2))
    targets = spark.createDataFrame([("A", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(df, targets)
    assert got.where("repeats > 3").count() == 0 and got.where("source = 'b' and repeats > 1").count() == 0
    s = {r.source: r.share for r in mixing.shares(got, targets).collect()}
    assert abs(s["a"] - 0.5) < 1e-3 and abs(s["b"] - 0.3) < 1e-3 and abs(s["c"] - 0.2) < 1e-3 and s["none"] == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mix(df.repartition(7), targets).collect()))
    assert mixing.mix(df.limit(0), targets).count() == 0


# personal information ------------------------------------------------------------------------------------------------
CASES = [
    ("Write me: ana.r+casa@mail.example.org.", [("email", "ana.r+casa@mail.example.org")]),
    ("Go to ana (at) mail.example; bo arroba casa punto test", [("email", "ana (at) mail.example"), ("email", "bo arroba casa punto test")]),
    ("Bread is sold @ 4 coins each. Hymn 555-562 was sung. ISBN 000-0-00-012345-0", []),
    ("Call (412) 555-0117 or +999 733 47 68 13, five five five zero one one four.", [("phone", "(412) 555-0117"), ("phone", "+999 733 47 68 13"), ("phone", "five five five zero one one four")]),
    ("ID 000-56-9592, 00833403-T and ZZ8282144; MS 4471-B, box 000-12", [("id_number", "000-56-9592"), ("id_number", "00833403-T"), ("id_number", "ZZ8282144")]),
    ("She lives at Flat 3, 12 Lower Mill Street. Vive en C/ de los Cipreses, n.º 20, 3.º A.", [("address", "Flat 3, 12 Lower Mill Street"), ("address", "C/ de los Cipreses, n.º 20, 3.º A")]),
    ("Kindly ask Mrs. de la Brezosa. Rosa P. Wexmoor thanked Thelvane in the Pellworth Reading Room.", [("name", "de la Brezosa"), ("name", "Rosa P. Wexmoor")]),
    ("Hope is learned slowly. Grace is given.", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_detection(text, want):
    got = [(k, text[a:b].rstrip(".")) for k, a, b in private.spans(text, frozenset({"Thelvane"}))]
    assert got == [(k, w.rstrip(".")) for k, w in want]


def test_masking(spark):
    rows = [(1, "Ask Mr. Quessel. Rosa Quessel lives at 12 Weaver Lane; call 412-555-0117."), (2, None), (3, ""), (4, "Nothing."), (4, "Nothing."), (5, LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("clash"))
    got = {r.doc_id: r for r in private.masked(df, [], "k").collect()}
    assert got[1].text == "Ask Mr. [NAME]. [NAME] lives at [ADDRESS]; call [PHONE]." and got[2].text is None and got[4].text == "Nothing."
    fake = got[1].surrogate_text
    assert "Quessel" not in fake and "0117" not in fake
    surname = fake.split("Mr. ")[1].split(".")[0]
    assert fake.count(surname) == 2  # coreference
    assert private.detect(df, []).where("doc_id <> 1").count() == 0 and private.detect(df.limit(0), []).count() == 0


def surrogates(spark, originals, key="k"):
    """Surrogates of (kind, original), each in a document of its own."""
    found = {}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(originals)], "doc_id long, text string")
    for r in private.masked(df, [], key).collect():
        found[originals[r.doc_id]] = r.surrogate_text
    return found


def test_surrogates_keep_gender_script_and_format(spark):
    texts = ["Mrs. Carmen Duval and Mr. Joshua Duval came.", "Ask Carmen Duval now.", "Мне писал Иван Петров вчера.", "Write to ana.luz7 (at) mail.example or call 412-555-0117.", "Ask Mr. J. Ostrander-Vale today.", "Ask Mr. Yaelim Duval.", "Ask Mrs. Ruthilde Duval."]
    got = surrogates(spark, texts)
    she, he = re.match(r"Mrs\. (\S+) \S+ and Mr\. (\S+) ", got[texts[0]]).groups()
    assert she.endswith("a") and not he.endswith("a") and f"Ask {she} " in got[texts[1]]
    assert re.search(r"писал [А-Я][а-я]+ [А-Я][а-я]+ вчера", got[texts[2]]) and "Иван" not in got[texts[2]]
    assert re.fullmatch(r"Write to [a-z]+\.[a-z]+\d \(at\) [a-z]+\.example or call \d{3}-\d{3}-\d{4}\.", got[texts[3]]) and "ana" not in got[texts[3]]
    assert re.fullmatch(r"Ask Mr\. [A-Z]\. [A-Z][a-z]+-[A-Z][a-z]+ today\.", got[texts[4]])
    assert not re.match(r"Ask Mr\. \w+a ", got[texts[5]]) and re.match(r"Ask Mrs\. \w+a ", got[texts[6]])
    assert surrogates(spark, texts[:1], "other key")[texts[0]] != got[texts[0]]


def test_surrogates_stay_distinct(spark):
    numbers = [f"Call 412-555-{i:04d} now." for i in range(300)]
    names = [f"Ask Mr. Name{chr(97 + i)}q Surname{chr(97 + i)}x." for i in range(20)]
    got = surrogates(spark, numbers + names)
    assert len(set(got.values())) == 320 and not set(got) & set(got.values())


def test_surrogates_agree_across_documents(spark):
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    given = [(a + b + c).capitalize() for a in syllables[:6] for b in syllables[:5] for c in ("ra", "ro", "nel", "lia")]
    # every given name in two texts, among others each time; one text has 120
    texts = [" ".join(f"Ask Mr. {g} Wex{g.lower()}." for g in names) for names in ([given[i] for i in range(0, 120, 2)], given, given[::-1][:70], given[40:44])]
    texts += [f"Call 412-555-{i:04d} or write to {g.lower()}{i}@mail.example now." for i, g in enumerate(given * 4)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    by, back = {}, {}
    for r in private.masked(rows, [], "k").collect():
        old, new = (re.findall(r"[\w.@-]+", t) for t in (texts[r.doc_id], r.surrogate_text))
        assert len(old) == len(new)
        for x, y in zip(old, new):
            x, y = x.rstrip("."), y.rstrip(".")
            assert by.setdefault(x, y) == y and back.setdefault(y, x) == x
    assert all(by[g] != g for g in given) and len(by) > 240 + 2 * 480


def test_surrogates_that_meet_move_on(spark):
    few = lambda key, plain, gender, turn: f"form{(len(plain) + turn) % 40}"
    words = spark.createDataFrame([("x" * (1 + i % 3) + str(i), 0) for i in range(30)] * 2, "plain string, vote int")
    got = private.drawn_forms(words, b"k", few).collect()
    assert len(got) == 30 and len({r.form for r in got}) == 30


def test_permuted_figures():
    for size in (1, 2, 3):
        got = [private._permuted(b"k", n, 10, size) for n in range(10**size)]
        assert sorted(got) == list(range(10**size)) and all(n != g for n, g in enumerate(got))
    of = lambda t: private.surrogate(b"k", "phone", t, {})
    assert len(of("five five five zero one one four").split()) == 7 and of("cero uno dos").split()[0] in private.FIGURES_ES


def test_skip_gram_trains_on_all_sentences(spark):
    # 400,000 sentences; each of the thousand words stands in four of them
    w = F.when(F.col("id") < 4000, F.array(F.lit("lamp"), F.concat(F.lit("w"), (F.col("id") % 1000).cast("string")), F.lit("rare"))).otherwise(F.array(F.lit("lamp"), F.lit("river")))
    words = {f"w{i}" for i in range(1000)} | {"lamp", "river"}
    assert set(bitext.skip_gram(spark.range(400_000).select(w.alias("w")), words)) == words
