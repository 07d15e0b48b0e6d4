"""The index against brute force, and awkward vectors."""

import numpy as np

from lorekiln.llm import neighbours

SCHEMA = "chunk_id long, embedding array<float>, model_version string, id string, g int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, m, "clash", 0) for i, v, m in rows], SCHEMA)


def brute(rows, k, floor):
    out = set()
    for m in {m for _, _, m in rows}:
        own = {i: np.array(v, float) for i, v, mm in rows if mm == m}
        ids = sorted(own)
        x = np.stack([own[i] / np.linalg.norm(own[i]) for i in ids])
        s = x @ x.T
        for a in range(len(ids)):
            best = sorted((-s[a, b], ids[b]) for b in range(len(ids)) if b != a)[:k]
            out |= {(ids[a], j) for c, j in best if -c >= floor}
    return out


def test_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 32))
    rows = [(i, (centres[i % 40] + 0.35 * rng.standard_normal(32)).tolist(), "ab"[i % 7 == 0]) for i in range(1500)]
    got = {(r.id, r.other) for r in neighbours.nearest(frame(spark, rows), k=5, target=0.97, dim=32).collect()}
    want = brute(rows, 5, -1)
    assert len(got & want) / len(want) >= 0.9 and len(got) >= 0.98 * len(want)
    got = {(r.id, r.other) for r in neighbours.nearest(frame(spark, rows), k=5, floor=0.9, target=0.99, dim=32).collect()}
    want = brute(rows, 5, 0.9)
    assert len(got & want) / len(want) >= 0.9 and len(got - want) <= 0.01 * len(want)


def test_copies_and_unusable_vectors(spark):
    v, w = [1.0] * 8, [1.0] * 7 + [1.2]
    rows = [(i, v, "m") for i in range(200)] + [(0, v, "m"), (300, w, "m"), (301, [2.0] * 8, "m"), (302, v, "other"), (303, None, "m"), (304, [0.0] * 8, "m"), (305, [float("nan")] * 8, "m"), (306, [1.0], "m"), (None, v, "m"), (307, v, None)]
    got = neighbours.nearest(frame(spark, rows), k=5, dim=8).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r.other)
        assert r.id != r.other
    assert set(by) == {*range(200), 300, 301}  # 302 is alone in its model
    assert all(len(set(x)) == 5 for x in by.values()) and sorted(by[150]) == [0, 1, 2, 3, 4] and sorted(by[2]) == [0, 1, 3, 4, 5]
    assert neighbours.nearest(frame(spark, []), dim=8).count() == 0


def test_parts_follow_different_vectors_that_ask(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 16))
    rows = [(i + 1000 * c, x[i].tolist(), "m") for i in range(600) for c in range(8)]
    members = neighbours.rows_of(frame(spark, rows), 16, "chunk_id", "embedding", "model_version")
    index = neighbours.fit(members, 600, 16, 5, -1.0, 0.95, 60)
    assert sum(index.counts.values()) == 600
    assert max(index.visitors.values()) <= 60.5


def test_parts_hold_few_candidates(spark, monkeypatch):
    # a dense place: products in many pieces, far more rows than k above the floor
    monkeypatch.setattr(neighbours, "CELLS", 1000)
    monkeypatch.setattr(neighbours, "SENT_ROWS", 50)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(32)
    rows = [(i, (centre + 0.2 * rng.standard_normal(32)).tolist(), "m") for i in range(900)]
    got = {(r.id, r.other) for r in neighbours.nearest(frame(spark, rows), k=5, floor=0.9, target=0.99, dim=32).collect()}
    want = brute(rows, 5, 0.9)
    assert len(got & want) / len(want) >= 0.97 and len(got - want) <= 0.03 * len(want)
