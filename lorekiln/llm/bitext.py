"""Sentence alignment in bilingual works: seed-aligned skip-gram vectors, coarse-to-fine time warping, rematching."""

from __future__ import annotations

import hashlib
import heapq
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekiln.session import cut

DIM, KEY_DIM = 32, 128
MIN_COUNT = 3
#: The shares of the two parts of a sentence's vector: skip-gram meaning, and words whose counterpart is known.
MEANING, KNOWN = 0.3, 0.7
#: Products of all sentences of both sides are held up to so many; above, strips along the path are, and the coarse path starts
#: at COARSE sentences instead of 16.
DENSE, STRIP, COARSE = 4_000_000, 256, 256
#: Steps of a path as they are stored.
STEPS = ((0, 0), (1, 0), (0, 1), (1, 1), (1, 2), (2, 1))
#: Costs: leaving a sentence out; the least similarity of a pair on the path and of a rematched one; how much of a work's shorter
#: side must match, and how much of both.
GAP, ON_PATH, REMATCH, COVERAGE = 0.36, 0.38, 0.47, 0.4
#: Bounds of the model, which is made from all sentences of all works: words of a language that have a vector and a weight of their own,
#: the most frequent (a rarer one weighs as much as the rarest of these), and pairs of words taught.
WORDS, LEXICON = 50_000, 50_000
#: Sentences that one task trains on at least: vectors averaged over tasks with few are worse. There are no more tasks than cores, as each
#: sends its vectors of all words twice.
PER_PART = 25_000
#: An induced pair of words: how often aligned together at least, and the least Dice coefficient.
PAIRS, DICE = 4, 0.5
WORD = re.compile(r"[^\W_]+")
#: Words that open glossary terms and tell nothing.
ARTICLES = {"the", "a", "an", "el", "la", "los", "las", "un", "una", "lo"}
SENTENCE_END = r"(?<=[.?!])\s+"


def words_of(text: str) -> list[str]:
    return WORD.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())


def term(text: str) -> tuple[str, ...]:
    w = words_of(text)
    while len(w) > 1 and w[0] in ARTICLES:
        w = w[1:]
    return tuple(w)


def works(chunks: DataFrame, parallels: DataFrame | None) -> DataFrame:
    """(work, side, file_path): English and Spanish files with the same path but for the language, or linked as
    EDITORIAL_PARALLEL; ``work`` names the couple. A file may be in several works; repeated links count once."""
    files = chunks.select("file_path").where(F.col("file_path").rlike("^(en|es)/")).distinct().withColumn("side", F.substring("file_path", 1, 2)).withColumn("rest", F.expr("substring(file_path, 4)"))
    a = files.where("side = 'en'").select(F.col("file_path").alias("a"), "rest")
    b = files.where("side = 'es'").select(F.col("file_path").alias("b"), "rest")
    couples = a.join(b, "rest").select("a", "b")
    if parallels is not None:
        p = parallels.where("rel_type = 'EDITORIAL_PARALLEL'").select("src_file_path", "dst_file_path")
        en, es = F.col("src_file_path").startswith("en/"), F.col("dst_file_path").startswith("en/")
        linked = p.where(en != es).select(F.when(en, F.col("src_file_path")).otherwise(F.col("dst_file_path")).alias("a"), F.when(en, F.col("dst_file_path")).otherwise(F.col("src_file_path")).alias("b"))
        couples = couples.union(linked.where(F.col("a").isNotNull() & F.col("b").isNotNull()))
    couples = couples.distinct().withColumn("work", F.concat_ws("\t", "a", "b"))
    return couples.select("work", F.lit("en").alias("side"), F.col("a").alias("file_path")).union(couples.select("work", F.lit("es"), "b"))


def sentences(chunks: DataFrame) -> DataFrame:
    """(file_path, chunk_index, id, sentence, text): sentences of the first copy of each chunk."""
    first = chunks.where("text is not null").withColumn("rn", F.row_number().over(Window.partitionBy("file_path", "chunk_index").orderBy("id"))).where("rn = 1")
    return first.select("file_path", "chunk_index", "id", F.posexplode(F.split("text", SENTENCE_END)).alias("sentence", "text")).where(F.trim("text") != "")


@dataclass
class Model:
    """What both languages share: word vectors in one space, the keys of words and terms with a known counterpart, weights."""

    vectors: dict[str, dict[str, np.ndarray]]
    keys: dict[str, dict[tuple[str, ...], str]]
    weight: dict[str, dict[str, float]]
    rarest: dict[str, float]
    longest: int = 1
    seen: dict[str, np.ndarray] = field(default_factory=dict)

    def key_vector(self, key: str) -> np.ndarray:
        v = self.seen.get(key)
        if v is None:
            seed = int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "little")
            v = np.random.default_rng(seed).standard_normal(KEY_DIM).astype("f4")
            v = self.seen[key] = v / np.linalg.norm(v)
        return v

    def __post_init__(self) -> None:
        # rows of words for sums over many sentences at once
        self.rows = {}
        for side, vectors in self.vectors.items():
            words = list(self.weight[side] | dict.fromkeys(vectors))
            w = np.array([self.weight[side].get(x, self.rarest[side]) for x in words], "f4")
            v = np.stack([vectors.get(x, np.zeros(DIM, "f4")) for x in words]) if words else np.zeros((0, DIM), "f4")
            self.rows[side] = {x: i for i, x in enumerate(words)}, w.tolist(), np.concatenate([v * w[:, None], np.zeros((1, DIM), "f4")]).astype("f4")
        self.key_rows: dict[str, int] = {}
        self.key_matrix = np.zeros((0, KEY_DIM), "f4")

    def _key_rows(self, keys: list[str]) -> np.ndarray:
        new = [k for k in dict.fromkeys(keys) if k not in self.key_rows]
        if new:
            if len(self.key_rows) > 200_000:  # figures have no end
                self.key_rows, self.key_matrix, self.seen = {}, np.zeros((0, KEY_DIM), "f4"), {}
                new = list(dict.fromkeys(keys))
            self.key_rows |= {k: len(self.key_rows) + i for i, k in enumerate(new)}
            self.key_matrix = np.concatenate([self.key_matrix, np.stack([self.key_vector(k) for k in new])])
        return np.array([self.key_rows[k] for k in keys], int)

    def embed(self, texts: list[str], side: str) -> np.ndarray:
        """Unit vectors of sentences: their words' skip-gram vectors, and the keys of what has a known counterpart."""
        at, weights, vectors = self.rows[side]
        keys, rarest, longest = self.keys[side], self.rarest[side], self.longest
        single = {t[0]: k for t, k in keys.items() if len(t) == 1}
        opens = {t[0] for t in keys if len(t) > 1}
        words, n_words, known, shares, n_known, unknown = [], [], [], [], [], []
        for text in texts:
            w = words_of(text)
            ids = [at.get(x, -1) for x in w]
            words += ids
            n_words.append(len(ids))
            i, rest, n = 0, 0.0, 0
            while i < len(w):
                x = w[i]
                size, key = 1, None
                if x in opens:
                    for size in range(min(longest, len(w) - i), 1, -1):
                        if key := keys.get(tuple(w[i : i + size])):
                            break
                    else:
                        size = 1
                if key is None:
                    key = single.get(x) or ("#" + x.lstrip("0") if x.isdigit() else None)
                weigh = [weights[k] if k >= 0 else rarest for k in ids[i : i + size]]
                if key:
                    known.append(key)
                    shares.append(max(weigh))
                    n += 1
                else:
                    rest += 0.15 * weigh[0] ** 2
                i += size
            n_known.append(n)
            unknown.append(rest)
        out = np.zeros((len(texts), DIM + KEY_DIM), "f4")
        meaning = _sums(vectors, np.array(words, int), n_words)
        a = np.linalg.norm(meaning, axis=1, keepdims=True)
        out[:, :DIM] = np.sqrt(MEANING) * meaning / np.where(a > 0, a, 1)
        rows = self._key_rows(known)
        meant = _sums(self.key_matrix, rows, n_known, np.array(shares, "f4"))
        b = np.sqrt((meant * meant).sum(1) + np.array(unknown))[:, None]
        out[:, DIM:] = np.sqrt(KNOWN) * meant / np.where(b > 0, b, 1)
        return out


def _sums(matrix: np.ndarray, rows: np.ndarray, sizes: list[int], weights: np.ndarray | None = None) -> np.ndarray:
    """Sums of a matrix' rows by consecutive groups; row -1 is the last, a group may be empty."""
    out = np.zeros((len(sizes), matrix.shape[1]), "f4")
    if len(rows):
        x = matrix[rows]
        if weights is not None:
            x = x * weights[:, None]
        n = np.array(sizes)
        full = np.flatnonzero(n)
        out[full] = np.add.reduceat(x, (np.cumsum(n) - n)[full], axis=0)
    return out


def skip_gram(tokens: DataFrame, words: set[str], seed: int = 7) -> dict[str, np.ndarray]:
    """Skip-gram vectors of a language's ``words``, trained by Spark on all its sentences. Where words were left out (there are
    WORDS of them then), the trainer doesn't see them either, so that its vocabulary is bounded."""
    sc = tokens.sparkSession.sparkContext
    n = tokens.count()
    parts = max(1, min(n // PER_PART, sc.defaultParallelism))
    kept = sc.broadcast(words)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [[x for x in ws if x in kept.value] for ws in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.list_(pa.string()))], names=["w"])

    tokens = tokens.coalesce(8) if n <= 8 * PER_PART else tokens
    if len(words) >= WORDS:
        tokens = tokens.mapInArrow(known, "w array<string>")
    m = Word2Vec(vectorSize=DIM, minCount=MIN_COUNT, numPartitions=parts, maxIter=2, stepSize=0.05, windowSize=4, seed=seed, inputCol="w", outputCol="v").fit(tokens)
    return {r["word"]: np.asarray(r["vector"].toArray(), "f4") for r in m.getVectors().collect() if r["word"] in words}


def procrustes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The rotation that brings rows of ``y`` nearest to rows of ``x``."""
    u, _, v = np.linalg.svd(y.T @ x)
    return (u @ v).astype("f4")


def _unit(vectors: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    if not vectors:
        return {}
    mean = np.mean(list(vectors.values()), axis=0)
    return {k: (v - mean) / max(float(np.linalg.norm(v - mean)), 1e-9) for k, v in vectors.items()}


def fit(raw: dict[str, dict[str, np.ndarray]], counts: dict[str, dict[str, int]], seeds: list[tuple[tuple[str, ...], tuple[str, ...]]]) -> Model:
    """Turns the Spanish space into the English one by the seeds' words, and gives each seed a key in both languages."""
    en, es = _unit(raw["en"]), _unit(raw["es"])
    rows = []
    for a, b in seeds:
        va, vb = [en[w] for w in a if w in en], [es[w] for w in b if w in es]
        if va and vb:
            rows.append((np.mean(va, axis=0), np.mean(vb, axis=0)))
    turn = procrustes(np.stack([r[0] for r in rows]), np.stack([r[1] for r in rows])) if rows else np.eye(DIM, dtype="f4")
    es = {k: v @ turn for k, v in es.items()}
    keys: dict[str, dict[tuple[str, ...], str]] = {"en": {}, "es": {}}
    for a, b in seeds:
        # a term with two counterparts joins them under one key
        k = keys["en"].get(a) or keys["es"].get(b) or " ".join(a) + "|" + " ".join(b)
        keys["en"].setdefault(a, k)
        keys["es"].setdefault(b, k)
    weight, rarest = {}, {}
    for side, c in counts.items():
        total = max(c.values(), default=1)
        weight[side] = {w: float(np.log(1 + 2 * total / n)) for w, n in c.items()}
        rarest[side] = max(weight[side].values(), default=4.0) if len(c) >= WORDS else 4.0
    return Model({"en": en, "es": es}, keys, weight, rarest, max((len(t) for s in keys.values() for t in s), default=1))


def _merged(v: np.ndarray) -> np.ndarray:
    n = len(v) // 2 * 2
    m = v[:n].reshape(-1, 2, v.shape[1]).sum(1)
    m = np.concatenate([m, v[n:]]) if n < len(v) else m
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


class _Products:
    """The product of two sequences of vectors by cell, row or part of a row or column, for what is too large to be held."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a, self.b = a, b

    def __getitem__(self, at):
        if isinstance(at, tuple):
            x, y = self.a[at[0]], self.b[at[1]]
            return y @ x if x.ndim == 1 else x @ y
        return self.b @ self.a[at]


def _warp(a: np.ndarray, b: np.ndarray, low: list[int], high: list[int], fine: bool) -> list[tuple[int, int, int, int]]:
    """The cheapest monotone path of steps (i, j, di, dj) within the band low[i] <= j < high[i]. Steps leave a sentence out on
    either side, pair one with one, and at the finest level one with two."""
    n, m = len(a), len(b)
    if fine:
        b2 = b[:-1] + b[1:]
        a2 = a[:-1] + a[1:]
        b2 = b2 / np.maximum(np.linalg.norm(b2, axis=1, keepdims=True), 1e-9)
        a2 = a2 / np.maximum(np.linalg.norm(a2, axis=1, keepdims=True), 1e-9)
    inf = float("inf")
    size = n if n * m <= DENSE else STRIP
    up2, up = {}, {j: GAP * j for j in range(0, min(m, high[0] if n else m) + 1)}
    back = [(0, bytes([0] + [2] * (len(up) - 1)))]
    above: list[float] = []
    above_at = 0
    for i in range(1, n + 1):
        if (i - 1) % size == 0:
            # rows of the strip with the one before, columns of its band
            r, to = max(0, i - 2), min(n, i - 1 + size)
            o, end = (0, m) if size == n else (max(0, min(low[i - 1 : to]) - 2), min(m, max(high[i - 1 : to])))
            s = a[r:to] @ b[o:end].T
            if fine:
                s12, s21 = a[r:to] @ b2[o:end].T, a2[r:to] @ b[o:end].T
        row, steps = {}, bytearray()
        first, last = low[i - 1], min(m, high[i - 1])
        # the band's cells as plain numbers: si[j - at] is the product with sentence j - 1
        at = max(first, 1 + o) - 1
        si = s[i - 1 - r, at - o : last - o].tolist()
        if fine:
            at12 = max(at - 1, o)
            t12 = s12[i - 1 - r, at12 - o : max(at12, last - 1) - o].tolist()
            t21 = s21[i - 2 - r, at - o : last - o].tolist() if i > 1 else []
        left = None
        for j in range(first, last + 1):
            best, step = inf, 0
            if (c := up.get(j)) is not None:
                best, step = c + GAP, 1
            if j:
                if left is not None and left + GAP < best:
                    best, step = left + GAP, 2
                own = si[j - 1 - at]
                if (c := up.get(j - 1)) is not None:
                    if c + 1 - own < best:
                        best, step = c + 1 - own, 3
                if fine:
                    if j - 2 >= at12 and (c := up.get(j - 2)) is not None:
                        v = t12[j - 2 - at12]
                        if c + 1.1 - v < best and v > own + 0.05 and v > (si[j - 2 - at] if j - 2 >= at else s[i - 1 - r, j - 2 - o]) + 0.05:
                            best, step = c + 1.1 - v, 4
                    if t21 and (c := up2.get(j - 1)) is not None:
                        v = t21[j - 1 - at]
                        if c + 1.1 - v < best and v > own + 0.05:
                            k = j - 1 - above_at
                            if v > (above[k] if 0 <= k < len(above) else s[i - 2 - r, j - 1 - o]) + 0.05:
                                best, step = c + 1.1 - v, 5
            steps.append(step)
            left = best if step else None
            if step:
                row[j] = best
        back.append((first, bytes(steps)))
        up2, up, above, above_at = up, row, si, at
    i, j = n, m
    if j not in up:
        j = max(up, default=0)
    path = []
    while i or j:
        first, steps = back[i]
        if not first <= j < first + len(steps) or not steps[j - first]:
            break
        di, dj = STEPS[steps[j - first]]
        i, j = i - di, j - dj
        path.append((i, j, di, dj))
    return path[::-1]


def align(a: np.ndarray, b: np.ndarray, radius: int = 6) -> list[tuple[int, int, float]]:
    """Pairs (i, j, similarity) of two sequences of sentence vectors, of any length: memory grows with their sum, not product.

    The path is found at half the length first, down to some 16 sentences (COARSE in long works), and each finer path only near the coarser one. Then
    sentences that stayed alone on both sides are matched with each other wherever they stand, best first and only mutually
    best ones, which brings back what was moved."""
    if not len(a) or not len(b):
        return []
    long = len(a) * len(b) > DENSE

    def path(x: np.ndarray, y: np.ndarray, fine: bool) -> list[tuple[int, int, int, int]]:
        n, m = len(x), len(y)
        if min(n, m) <= (COARSE if long else 16):
            if long:  # sums of many sentences are alike: what they have in common tells nothing
                mean = np.concatenate([x, y]).mean(0)
                x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9) for v in (x - mean, y - mean))
            return _warp(x, y, [0] * n, [m] * n, fine)
        low, high = [m] * n, [0] * n
        for i, j, di, dj in path(_merged(x), _merged(y), False):
            for k in range(2 * i, min(n, 2 * (i + max(di, 1)))):
                low[k], high[k] = min(low[k], 2 * j - radius), max(high[k], 2 * (j + dj) + radius)
        at = 0
        for k in range(n):
            if low[k] > high[k]:
                low[k], high[k] = at - radius, at + radius
            at = (low[k] + high[k]) // 2
            low[k] = max(0, low[k])
        for k in range(1, n):  # the band must be connected
            high[k] = max(high[k], high[k - 1])
        for k in range(n - 2, -1, -1):
            low[k] = min(low[k], low[k + 1])
        low[0], high[-1] = 0, m
        return _warp(x, y, low, high, fine)

    s = _Products(a, b) if long else a @ b.T
    out: dict[tuple[int, int], float] = {}
    joined: list[tuple[int, int]] = []
    for i, j, di, dj in path(a, b, True):
        if di and dj:
            cells = [(i + p, j + q) for p in range(di) for q in range(dj)]
            if len(cells) == 1:
                if s[i, j] >= ON_PATH:
                    out[cells[0]] = float(s[i, j])
            else:
                whole = a[i : i + di].sum(0) @ b[j : j + dj].sum(0) / max(np.linalg.norm(a[i : i + di].sum(0)) * np.linalg.norm(b[j : j + dj].sum(0)), 1e-9)
                strong = [c for c in cells if s[c] >= 0.2]
                if whole >= ON_PATH:
                    out |= {c: float(whole) for c in strong}
                    joined += strong if len(strong) > 1 else []
    # a part of a merged pair that fits a sentence left alone far better was moved, not merged
    alone = [np.array(sorted(set(range(n)) - {c[k] for c in out}), int) for k, n in ((0, len(a)), (1, len(b)))]
    shared = Counter(j for _, j in joined)
    for i, j in joined:
        best = (s[i, alone[1]] if shared[j] > 1 else s[alone[0], j]).max(initial=-1)
        if best >= REMATCH and best > s[i, j] + 0.15:
            del out[i, j]
    # two sentences that changed places in a run of similar ones lie on the path crosswise
    holder = {j: i for i, j in out}
    for i, j in [c for c in out if s[c] < 0.85]:
        q = int(s[i].argmax())
        p = holder.get(q)
        if (i, j) in out and p is not None and (p, q) in out and p != i and s[i, q] + s[p, j] > s[i, j] + s[p, q] + 0.3:
            del out[i, j], out[p, q]
            out[i, q], out[p, j] = float(s[i, q]), float(s[p, j])
            holder[q], holder[j] = i, p
    free_a, free_b = sorted(set(range(len(a))) - {i for i, _ in out}), sorted(set(range(len(b))) - {j for _, j in out})
    if free_a and free_b:
        # the best of each row; it is sought again when its column has gone
        columns = np.array(free_b)
        left, heap = np.zeros(len(free_b), "f4"), []

        def best(i: int) -> None:
            row = s[i, columns] + left
            if row[q := int(row.argmax())] >= REMATCH:
                heapq.heappush(heap, (-float(row[q]), i, q))

        for i in free_a:
            best(i)
        while heap:
            v, i, q = heapq.heappop(heap)
            if left[q]:
                best(i)
            else:
                out[i, free_b[q]], left[q] = -v, -9
    # a sentence left alone may be a further part of one that is paired: all its parts together must fit it better than those before
    for side, free in ((0, sorted(set(range(len(a))) - {i for i, _ in out})), (1, sorted(set(range(len(b))) - {j for _, j in out}))):
        own, other = (a, b) if side == 0 else (b, a)
        at, parts = defaultdict(list), defaultdict(list)
        for c in out:
            at[c[side]].append(c)
            parts[c[1 - side]].append(c[side])
        for k in [*free, *reversed(free)]:
            if k in at:
                continue
            for c in sorted({c for x in (k - 1, k + 1) for c in at.get(x, ())}):
                whole = c[1 - side]
                cell = (k, whole) if side == 0 else (whole, k)
                v = own[[*parts[whole], k]].sum(0)
                pair = float(v @ other[whole] / max(np.linalg.norm(v), 1e-9))
                if s[cell] >= 0.3 and pair > out[c] + 0.03:
                    for p in [*parts[whole], k]:
                        out[(p, whole) if side == 0 else (whole, p)] = pair
                    at[k].append(cell)
                    parts[whole].append(k)
                    break
    return [(i, j, v) for (i, j), v in sorted(out.items())]


def _placed(members: DataFrame) -> DataFrame:
    """Sentences of a work with their place ``pos``; places come from counts by chunk, not from one sort."""
    per_chunk = members.groupBy("work", "side", "chunk_index").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("work", "side").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = per_chunk.select("work", "side", "chunk_index", before.alias("before"))
    return members.join(ranks, ["work", "side", "chunk_index"]).withColumn("pos", F.col("before") + F.col("sentence"))


def aligned(embedded: DataFrame) -> DataFrame:
    """(work, id_a, sentence_a, id_b, sentence_b, similarity, coverage) of works of embedded sentences.

    A task holds a work whole, about 1 KB a sentence, so that nothing is lost at the borders of parts. Works of which the shorter
    side hardly matches are no translations; an abridgement's own sentences do."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "pos"])
        en, es = pdf[pdf.side == "en"], pdf[pdf.side == "es"]
        cols = ["work", "id_a", "sentence_a", "id_b", "sentence_b", "similarity", "coverage"]
        if not len(en) or not len(es):
            return pd.DataFrame(columns=cols)
        a, b = (np.frombuffer(b"".join(x.v), "f2").reshape(len(x), -1).astype("f4") for x in (en, es))
        pairs = align(a, b)
        shares = len({i for i, _, _ in pairs}) / len(a), len({j for _, j, _ in pairs}) / len(b)
        cover = shares[0] if len(a) <= len(b) else shares[1]
        ai, bi = en.id.to_numpy(), es.id.to_numpy()
        an, bn = en.sentence.to_numpy(), es.sentence.to_numpy()
        return pd.DataFrame([(pdf.work.iloc[0], int(ai[i]), int(an[i]), int(bi[j]), int(bn[j]), v, cover) for i, j, v in pairs], columns=cols)

    schema = "work string, id_a long, sentence_a int, id_b long, sentence_b int, similarity double, coverage double"
    return embedded.select("work", "side", "pos", "id", "sentence", "v").groupBy("work").applyInPandas(run, schema).where(F.col("coverage") >= COVERAGE)


def induced(pairs: DataFrame, texts: DataFrame, taught: set[str]) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """Pairs of words that aligned sentences bring together, each the other's best by Dice's coefficient; LEXICON at most, the surest.

    ``texts``: (work, id, sentence, w) of the works the pairs are from. Words of the glossary and figures tell nothing new."""
    w = texts.select("work", "id", "sentence", F.filter(F.array_distinct("w"), lambda x: ~x.rlike("[0-9]")).alias("w"))
    side = lambda k: w.select("work", F.col("id").alias(f"id_{k}"), F.col("sentence").alias(f"sentence_{k}"), F.col("w").alias(f"w{k}"))
    both = cut(pairs.where("similarity >= 0.6").join(side("a"), ["work", "id_a", "sentence_a"]).join(side("b"), ["work", "id_b", "sentence_b"]).select("wa", "wb"))
    count = lambda k: both.select(F.explode(f"w{k}").alias(k)).groupBy(k).agg(F.count("*").alias(f"n{k}")).where(F.col(f"n{k}") >= PAIRS)
    n = both.select(F.explode("wa").alias("a"), "wb").where(~F.col("a").isin(sorted(taught))).select("a", F.explode("wb").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= PAIRS)
    d = n.join(count("a"), "a").join(count("b"), "b").withColumn("dice", 2 * F.col("n") / (F.col("na") + F.col("nb"))).where(F.col("dice") >= DICE)
    for x, y in (("a", "b"), ("b", "a")):
        d = d.withColumn("r" + x, F.row_number().over(Window.partitionBy(x).orderBy(F.desc("dice"), F.desc("n"), y)))
    best = d.where("ra = 1 and rb = 1").orderBy(F.desc("dice"), F.desc("n"), "a").limit(LEXICON)
    return [((r["a"],), (r["b"],)) for r in best.select("a", "b").collect()]


def alignment(chunks: DataFrame, parallels: DataFrame | None, glossary: list[tuple[str, str]]) -> DataFrame:
    """(chunk_id_a, sentence_a, chunk_id_b, sentence_b, similarity): pairs of sentences that translate each other, the smaller
    chunk id first; copies of a chunk (same file, index and text) have the pairs of their first copy.

    ``glossary``: pairs of terms known beforehand (tables of fixed size). Two rounds: the glossary, equal figures and skip-gram
    vectors align all works; the pairs found teach further words; then all works are aligned again. Weights are from counts
    over all works; what the driver and the tasks hold of the vocabulary is bounded by WORDS and LEXICON. Null texts are left out; works of which
    hardly anything matches are no translations and give no pairs; without works there are no rows.
    """
    chunks = chunks.select("id", "file_path", "chunk_index", "text")
    members = works(chunks, parallels)
    sents = sentences(chunks.join(members.select("file_path").distinct(), "file_path", "left_semi"))
    sents = cut(sents)
    placed = cut(_placed(members.join(sents, "file_path")))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))
    raw, counts = {}, {}
    for side in ("en", "es"):
        own = sents.where(F.col("file_path").startswith(side + "/")).select(words.alias("w"))
        known = own.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT).orderBy(F.desc("n"), "w").limit(WORDS)
        counts[side] = {r["w"]: r["n"] for r in known.collect()}
        raw[side] = skip_gram(own, set(counts[side])) if counts[side] else {}
    seeds = list(dict.fromkeys((term(a), term(b)) for a, b in glossary if a and b and term(a) and term(b)))

    def embedded(model: Model, some: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                v = np.zeros((len(pdf), DIM + KEY_DIM), "f4")
                for side in ("en", "es"):
                    if (at := np.flatnonzero(pdf.side.to_numpy() == side)).size:
                        v[at] = model.embed(pdf.text.iloc[at].tolist(), side)
                pdf["v"] = [x.tobytes() for x in v.astype("f2")]
                yield pdf[["work", "side", "pos", "id", "sentence", "v"]]

        return some.select("work", "side", "pos", "id", "sentence", "text").mapInPandas(run, "work string, side string, pos long, id long, sentence int, v binary")

    first = cut(aligned(embedded(fit(raw, counts, seeds), placed)))
    more = induced(first, placed.withColumn("w", words), {a[0] for a, _ in seeds if len(a) == 1})
    pairs = cut(aligned(embedded(fit(raw, counts, seeds + [p for p in more if p[0] not in {a for a, _ in seeds}]), placed)))
    # copies of a chunk
    ids = pairs.select(F.col("id_a").alias("id")).union(pairs.select("id_b")).distinct()
    texts = chunks.join(members.select("file_path").distinct(), "file_path", "left_semi").where("text is not null").select("id", "file_path", "chunk_index", F.xxhash64("text").alias("h"))
    copies = texts.join(ids, "id").join(texts.select(F.col("id").alias("copy"), "file_path", "chunk_index", "h"), ["file_path", "chunk_index", "h"]).select("id", "copy")
    out = pairs.join(copies.select(F.col("id").alias("id_a"), F.col("copy").alias("ca")), "id_a").join(copies.select(F.col("id").alias("id_b"), F.col("copy").alias("cb")), "id_b")
    swap = F.col("ca") > F.col("cb")
    out = out.select(F.least("ca", "cb").alias("chunk_id_a"), F.when(swap, F.col("sentence_b")).otherwise(F.col("sentence_a")).alias("sentence_a"), F.greatest("ca", "cb").alias("chunk_id_b"), F.when(swap, F.col("sentence_a")).otherwise(F.col("sentence_b")).alias("sentence_b"), "similarity")
    return out.groupBy("chunk_id_a", "sentence_a", "chunk_id_b", "sentence_b").agg(F.max("similarity").alias("similarity"))
