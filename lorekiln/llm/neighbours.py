"""Most similar vectors for every vector: a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekiln.session import cut

#: Bound of the rows that fit the tree, and of those that calibrate it.
FIT_ROWS, CALIBRATION_ROWS = 16_384, 384
BRANCH = 8
#: Rows of a leaf and of a block (a subtree that one task searches), in fit rows and in all rows; a block with more rows or more
#: visitors than SHARD_ROWS is dealt over several tasks.
LEAF_FIT, LEAF_ROWS, BLOCK_ROWS, SHARD_ROWS = 12, 256, 8_192, 32_768
#: Over so many parts the rows of a brute-force comparison are dealt.
PARTS = 32
#: Cells of a product that are held at once; rows of ``search`` that leave a task at once; vectors that are counted by leaf.
CELLS, SENT_ROWS, COUNTED = 1 << 21, 4_096, 1 << 18


@dataclass
class Tree:
    """Nodes in order of creation; a leaf has no children. Vectors have unit length, so the nearest has the greatest product."""

    centres: np.ndarray
    children: list[list[int]]
    leaf_block: dict[int, int] = field(default_factory=dict)

    def leaves(self) -> list[int]:
        return [i for i, c in enumerate(self.children) if not c]

    def products(self, x: np.ndarray) -> np.ndarray:
        return x @ self.centres.T

    def visits(self, near: list[float], n: int) -> list[int]:
        """The ``n`` leaves of one query in the order of a best-bin-first traversal; ``near``: its products with all nodes."""
        queue, out = [(0.0, 0)], []
        children = self.children
        while queue and len(out) < n:
            _, node = heapq.heappop(queue)
            below = children[node]
            if not below:
                out.append(node)
            for c in below:
                heapq.heappush(queue, (-near[c], c))
        return out


def _split(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Labels of a spherical k-means."""
    centres = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), dtype=int)
    for _ in range(8):
        new = (x @ centres.T).argmax(1)
        if (new == label).all():
            break
        label = new
        for j in range(k):
            if (m := label == j).any():
                c = x[m].sum(0)
                centres[j] = c / max(np.linalg.norm(c), 1e-9)
    return label


def build(x: np.ndarray, leaf_fit: int, block_fit: int, seed: int = 5) -> Tree:
    """A tree over the fit rows: a node with more than ``leaf_fit`` of them is divided again, so that dense places get as many
    leaves as rows; blocks are the largest subtrees of at most ``block_fit`` fit rows."""
    rng = np.random.default_rng(seed)
    centres, children, block = [x.mean(0) if len(x) else np.zeros(x.shape[1], "f4")], [[]], {}
    todo = [(0, np.arange(len(x)), None)]
    while todo:
        node, rows, b = todo.pop()
        if b is None and len(rows) <= block_fit:
            b = node
        groups = []
        if len(rows) > leaf_fit:
            label = _split(x[rows], min(BRANCH, len(rows)), rng)
            groups = [rows[label == j] for j in range(BRANCH) if (label == j).any()]
        if len(groups) < 2:
            block[node] = node if b is None else b
            continue
        for g in groups:
            c = x[g].sum(0)
            centres.append(c / max(np.linalg.norm(c), 1e-9))
            children.append([])
            children[node].append(len(centres) - 1)
            todo.append((len(centres) - 1, g, b))
    return Tree(np.asarray(centres, dtype="f4"), children, block)


def unit_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows' places and their vectors at unit length: ``dim`` finite numbers, not all zero."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dim)
    flat = column.take(pa.array(at)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim) if len(at) else np.zeros((0, dim))
    with np.errstate(all="ignore"):
        n = np.sqrt((x * x).sum(1))
        ok = np.isfinite(x).all(1) & np.isfinite(n) & (n > 0)
        return at[ok], (x[ok] / n[ok, None]).astype("f4")


def _raw(df: DataFrame, key: str, vector: str, model: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(model).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(model).alias("model"), F.col(vector).alias("v"))


def rows_of(df: DataFrame, dim: int, key: str, vector: str, model: str, with_vectors: bool = True) -> DataFrame:
    """(id, model, g[, v]) of usable rows: g names the unit vector in half precision, v is that vector.

    It is computed anew from the scan wherever it is needed, which is cheaper than keeping a copy of all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                at, x = unit_vectors(b.column(2), dim)
                raw = [r.tobytes() for r in x.astype("f2")]
                group = [int.from_bytes(hashlib.blake2b(r, digest_size=8).digest(), "little", signed=True) for r in raw]
                cols = [b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(group, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * with_vectors, names=["id", "model", "g"] + ["v"] * with_vectors)

    return _raw(df, key, vector, model).mapInArrow(run, "id long, model string, g long" + ", v binary" * with_vectors)


def copies_of(members: DataFrame, k: int) -> DataFrame:
    """(model, g, ids, copies): the first k + 1 ids of each different vector and how many it has. Ids are taken by salted parts
    first, so that a vector with a third of all rows doesn't bring them into one task."""
    part = Window.partitionBy("model", "g", "salt").orderBy("id")
    some = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16))).withColumn("rn", F.row_number().over(part)).where(F.col("rn") <= k + 1)
    sizes = members.groupBy("model", "g").agg(F.count("*").alias("copies"))
    return some.groupBy("model", "g").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids")).join(sizes, ["model", "g"])


@dataclass
class Search:
    """A fitted index: the tree, how many leaves a query visits, and the recall this reached on the calibration queries."""

    tree: Tree
    visits: int
    recall: float
    counts: dict[int, int]
    visitors: dict[int, float] = field(default_factory=dict)

    def shards(self) -> dict[int, tuple[int, int]]:
        """Over how many parts the rows and the visitors of each block are dealt."""
        per_block: dict[int, int] = {}
        for leaf, c in self.counts.items():
            b = self.tree.leaf_block[leaf]
            per_block[b] = per_block.get(b, 0) + c
        parts = lambda n: max(1, -(-int(n) // SHARD_ROWS))
        return {b: (parts(per_block.get(b, 0)), parts(self.visitors.get(b, 0))) for b in set(per_block) | set(self.visitors)}


def fit(rows: DataFrame, n: int, dim: int, k: int, floor: float, target: float, asked: int | None = None, n_rows: int = 0) -> Search:
    """Builds the tree on about FIT_ROWS rows at most (those of smallest hash) and calibrates the leaf visits on CALIBRATION_ROWS.

    ``n``: how many different vectors there are, ``asked``: how many of them ask, if not all, ``n_rows``: how many rows; few copies don't change the sample. The calibration queries are held against *all* rows by brute force, in blocks, in one distributed pass that also counts
    the vectors by leaf, each once however many copies it has (one in n / COUNTED of them, by hash); visits widen, to all leaves if need be, until ``target`` of their true neighbours (the k nearest of at
    least ``floor``) are in the leaves visited. ``recall`` is what the queries reach then."""
    drawn = n_rows if n <= n_rows < 2 * n else n
    want = max(min(FIT_ROWS, max(64, drawn * LEAF_FIT // LEAF_ROWS)), CALIBRATION_ROWS)
    thin = rows.where(F.pmod(F.xxhash64("g"), F.lit(1 << 20)) <= F.lit(int((1 << 20) * min(1.0, 1.02 * want / max(drawn, 1)))))
    got = sorted(thin.dropDuplicates(["g"]).collect(), key=lambda r: r.g)  # a vector's copies meet before they reach the driver
    if not got:
        return Search(Tree(np.zeros((1, dim), "f4"), [[]], {0: 0}), 1, 1.0, {})
    x = np.stack([np.frombuffer(r.v, "f2").astype("f4") for r in got])
    scale = max(1.0, n / len(got))
    tree = build(x, LEAF_FIT, max(LEAF_FIT, int(BLOCK_ROWS / scale)))
    queries = got[:CALIBRATION_ROWS]
    qx, qg, qm = x[: len(queries)], np.array([r.g for r in queries]), np.array([r.model for r in queries])

    every = max(1, n // COUNTED)

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in qg]
        count: set[tuple[int, int]] = set()
        for b in (w.slice(lo, 1024) for w in batches for lo in range(0, w.num_rows, 1024)):
            y = np.frombuffer(b"".join(b.column(3).to_pylist()), "f2").reshape(-1, dim).astype("f4")
            g, m = b.column(2).to_numpy(), np.asarray(b.column(1).to_pylist(), dtype=object)
            leaf = np.array([tree.visits(r.tolist(), 1)[0] for r in tree.products(y)])
            some = g // 64 % every == 0
            count |= set(zip(leaf[some].tolist(), g[some].tolist()))
            s = qx @ y.T
            s[(qg[:, None] == g[None, :]) | (qm[:, None] != m[None, :])] = -2
            top = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k] if s.shape[1] > 1 else np.zeros((len(s), 1), int)
            for i, js in enumerate(top):
                best[i] += [(float(s[i, j]), int(leaf[j])) for j in js if s[i, j] >= max(floor, -1)]
                best[i] = sorted(best[i], reverse=True)[:k]
        out = [(i, s, j, 0) for i, bs in enumerate(best) for s, j in bs] + [(-1, 0.0, j, c) for j, c in count]
        if out:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["q", "s", "leaf", "g"]).astype({"q": "int32", "s": "float64", "leaf": "int32", "g": "int64"}))

    # tasks give k rows a query and the vectors that are counted; they are summed up before they reach the driver
    found = cut(rows.select("id", "model", "g", "v").mapInArrow(against, "q int, s double, leaf int, g long"))
    counts = {r["leaf"]: r["n"] * every for r in found.where("q < 0").groupBy("leaf").agg(F.countDistinct("g").alias("n")).collect()}
    best_of = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "leaf"))
    true = found.where("q >= 0").withColumn("rn", best_of).where(F.col("rn") <= k).select("q", "leaf").toPandas()
    near = tree.products(qx)
    ranks = []
    all_leaves = len(tree.leaves())
    orders = {q: {leaf: r for r, leaf in enumerate(tree.visits(near[q].tolist(), all_leaves))} for q in set(true.q)}
    for q, leaf in zip(true.q, true.leaf):
        ranks.append(orders[q][leaf])
    ranks = np.sort(np.array(ranks, dtype=int))
    if not len(ranks):
        return Search(tree, min(4, all_leaves), 1.0, counts)
    need = int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1
    visits = min(max(need, 2), all_leaves)
    visitors: dict[int, float] = {}
    for lo in range(0, len(x), 1024):
        for p in tree.products(x[lo : lo + 1024]):
            for b in {tree.leaf_block[leaf] for leaf in tree.visits(p.tolist(), visits)}:
                visitors[b] = visitors.get(b, 0.0) + (n if asked is None else asked) / len(x)
    return Search(tree, visits, float((ranks < visits).mean()), counts, visitors)


def search(rows: DataFrame, index: Search, dim: int, k: int, floor: float, is_query: str = "true") -> DataFrame:
    """(model, g, other, cos): for each query row its k nearest other rows of at least ``floor``.

    A row goes to its own block with the leaf it lies in; a query goes to each block in which it visits leaves, with those
    leaves. Vectors travel in half precision. A block of many rows or many visitors is dealt over rows x visitors: each part sees
    some of the rows and some of the visitors, every pair of which meets in one part, and the parts' finds are ranked together."""
    tree, visits = index.tree, index.visits
    shards = index.shards()
    schema = "model string, block int, shard int, g long, leaf int, visits array<int>, v binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple[str, int], bool] = {}  # copies of a vector leave a task once, or twice if only a later one asks
        for b in (w.slice(lo, 1024) for w in batches for lo in range(0, w.num_rows, 1024)):
            m, g, asks = b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist()
            new = []
            for i, (mi, gi, q) in enumerate(zip(m, g, asks)):
                before = sent.get((mi, gi))
                if before is None or (q and not before):
                    sent[mi, gi] = bool(q)
                    new.append(i)
            if not new:
                continue
            raw = b.column(3).take(pa.array(new)).to_pylist()
            near = tree.products(np.frombuffer(b"".join(raw), "f2").reshape(-1, dim).astype("f4"))
            out: list[tuple] = []
            for i, v, p in zip(new, raw, near):
                leaves = tree.visits(p.tolist(), visits if asks[i] else 1)
                by: dict[int, list[int]] = {}
                for x in leaves if asks[i] else ():
                    by.setdefault(tree.leaf_block[x], []).append(x)
                own = tree.leaf_block[leaves[0]]
                for block in {own, *by}:
                    r_all, q_all = shards.get(block, (1, 1))
                    r, q = g[i] % r_all, g[i] // r_all % q_all
                    # as a row with all parts of the visitors, as a visitor with all parts of the rows
                    for at in range(q_all) if block == own else ():
                        out.append((m[i], own, r * q_all + at, g[i], leaves[0], by.get(own, []) if at == q else [], v))
                    for at in range(r_all) if block in by else ():
                        if block != own or at != r:
                            out.append((m[i], block, at * q_all + q, g[i], -1, by[block], v))
                if len(out) >= SENT_ROWS:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary()))], names=["model", "block", "shard", "g", "leaf", "visits", "v"])

    def within(part: pa.Table) -> pa.Table:
        g, leaf, asked = part.column("g").to_numpy(), part.column("leaf").to_numpy(), part.column("visits").to_pylist()
        model = part.column("model")[0].as_py()
        keep = np.arange(len(g))
        if len(np.unique(g)) < len(g):  # copies from several tasks: one row, with the leaf and the visits of any
            keep = np.lexsort((-np.array([len(v) for v in asked]), g))
            first = np.flatnonzero(np.r_[True, np.diff(g[keep]) != 0])
            leaf, keep = np.maximum.reduceat(leaf[keep], first), keep[first]
            g, asked = g[keep], [asked[i] for i in keep.tolist()]
        x = np.empty((len(keep), dim), "f4")
        vectors = part.column("v").take(pa.array(keep)) if len(keep) < part.num_rows else part.column("v")
        for lo in range(0, len(x), 1024):
            y = np.frombuffer(b"".join(vectors.slice(lo, 1024).to_pylist()), "f2").astype("f4").reshape(-1, dim)
            x[lo : lo + len(y)] = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
        ask: dict[int, list[int]] = {}
        for i, vs in enumerate(asked):
            for j in vs:
                ask.setdefault(j, []).append(i)
        found: dict[int, list] = {}
        order = lambda t: (-t[0], g[t[1]])
        for j, qs in ask.items():
            rows = np.flatnonzero(leaf == j)
            if not len(rows):
                continue
            near, step = x[rows], min(2048, max(1, CELLS // len(rows)))
            for lo in range(0, len(qs), step):
                q = np.array(qs[lo : lo + step])
                s = x[q] @ near.T
                s[g[q][:, None] == g[rows][None, :]] = -2
                # the k best of a query, equal ones with them
                least = np.full(len(q), floor - 1e-4 if floor > 0 else -1.5, "f4")
                many = np.flatnonzero((s >= least[:, None]).sum(1) > k)
                if len(many):
                    least[many] = np.partition(s[many], len(rows) - k, axis=1)[:, len(rows) - k]
                a, b = np.nonzero(s >= least[:, None])
                for i, r, c in zip(q[a].tolist(), rows[b].tolist(), s[a, b].tolist()):
                    found.setdefault(i, []).append((c, r))
                for i in q.tolist():
                    if len(cs := found.get(i, ())) > 4 * k:
                        found[i] = sorted(cs, key=order)[:k]
        out = []
        for i, cs in found.items():
            for _, r in sorted(cs, key=order)[:k]:
                # products again in double
                a, b = x[i].astype("f8"), x[r].astype("f8")
                out.append((int(g[i]), int(g[r]), float(a @ b / np.sqrt((a @ a) * (b @ b)))))
        g_out, other, cos = zip(*out) if out else ((), (), ())
        return pa.table({"model": pa.array([model] * len(out), pa.string()), "g": pa.array(g_out, pa.int64()), "other": pa.array(other, pa.int64()), "cos": pa.array(cos, pa.float64())})

    dealt = rows.select("id", "model", "g", "v", F.expr(is_query).alias("asks")).mapInArrow(deal, schema)
    # as many partitions as parts, so that the largest doesn't grow with the data
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, sum(r * q for r, q in shards.values()))
    hits = dealt.repartition(parts, "model", "block", "shard").groupBy("model", "block", "shard").applyInArrow(within, "model string, g long, other long, cos double").where(F.col("cos") >= floor)
    first = F.row_number().over(Window.partitionBy("model", "g").orderBy(F.desc("cos"), "other"))
    return hits.withColumn("rn", first).where(F.col("rn") <= k).drop("rn")


def nearest(df: DataFrame, k: int = 5, floor: float = -1.0, target: float = 0.95, key: str = "chunk_id", vector: str = "embedding", model: str = "model_version", dim: int = 384, is_query: str | None = None) -> DataFrame:
    """(model, id, other, cos, rank): for each query id its k most similar other ids of the same model.

    Unusable vectors (null, of another length, not finite, all zero) neither ask nor answer; vectors needn't have unit
    length. Vectors travel in half precision, so a cosine is within 0.0005 of that of the stored ones (0.00002 as a rule); those
    that agree in it count as copies with cosine 1: they are searched once, as one representative, and come back with at most
    k + 1 ids each, smallest first, which is all that k neighbours can need. Ties go to the smaller id. Repeated rows
    count once. ``floor`` is a least cosine that belongs to the question: recall is then calibrated on neighbours of at
    least that. ``is_query`` is an SQL condition on ``id``. Extra columns are ignored; an empty table gives no rows.
    """
    asks = is_query or "true"
    members = cut(rows_of(df, dim, key, vector, model, False).distinct())
    rows = rows_of(df, dim, key, vector, model)
    n, asked, n_rows = members.groupBy("model", "g").agg(F.max(F.expr(asks)).alias("asks"), F.count("*").alias("n")).agg(F.count("*"), F.count_if("asks"), F.coalesce(F.sum("n"), F.lit(0))).first()
    index = fit(rows, n, dim, k, floor, target, asked, n_rows)
    hits = search(rows, index, dim, k, floor, asks)
    ids = cut(copies_of(members, k))
    near = hits.join(ids.select("model", F.col("g").alias("other"), F.col("ids").alias("other_ids")), ["model", "other"])
    near = near.groupBy("model", "g").agg(F.collect_list(F.struct(F.col("cos"), F.col("other_ids"))).alias("near"))  # k of them at most
    copies = ids.where("copies > 1").select("model", "g", F.array(F.struct(F.lit(2.0).alias("cos"), F.col("ids").alias("other_ids"))).alias("own"))
    both = near.join(copies, ["model", "g"], "full").select("model", "g", F.concat(F.coalesce("own", F.array().cast("array<struct<cos:double,other_ids:array<bigint>>>")), F.coalesce("near", F.array().cast("array<struct<cos:double,other_ids:array<bigint>>>"))).alias("near"))
    both = both.select("model", "g", F.expr("flatten(transform(near, x -> transform(x.other_ids, o -> struct(-x.cos as key, o as other))))").alias("near")).withColumn("near", F.sort_array("near"))
    # members beyond the first k + 1 copies are dealt over salts, so that one vector's many copies don't meet in one task
    members = members.where(F.expr(asks)).select("model", "g", "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int"))
    many = ids.select("model", "g", (F.col("copies") > 64).alias("hot"))
    both = both.join(many, ["model", "g"]).withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(15))).otherwise(F.array(F.lit(-1))))).drop("hot")
    hot = ids.where("copies > 64").select("model", "g", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    members = members.join(hot.withColumn("is_hot", F.lit(True)), ["model", "g", "salt"], "left").select("model", "g", "id", F.when(F.col("is_hot"), F.col("salt")).otherwise(-1).alias("salt"))
    picked = members.join(both, ["model", "g", "salt"]).select("model", "id", F.posexplode(F.slice(F.filter("near", lambda n: n["other"] != F.col("id")), 1, k)).alias("rank", "n"))
    return picked.select("model", "id", F.col("n.other").alias("other"), F.least(F.lit(1.0), -F.col("n.key")).alias("cos"), (F.col("rank") + 1).alias("rank"))


def brute_force(df: DataFrame, k: int = 5, key: str = "chunk_id", vector: str = "embedding", model: str = "model_version", dim: int = 384, is_query: str = "id % 100 = 0", block: int = 512) -> DataFrame:
    """(model, id, other, cos): the exact k most similar of every query id, against all vectors, for measuring an index.

    Queries are dealt into blocks of about ``block`` and rows over PARTS; a task multiplies one block with one part and keeps k a
    query. Rows are sent once a block, so this is for a stated set of queries, not for all rows. An id that comes twice counts once.
    """
    rows = rows_of(df, dim, key, vector, model).dropDuplicates(["model", "id"])
    asked = rows.where(is_query)
    blocks = max(1, -(-asked.count() // block))
    left = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).withColumn("asks", F.lit(True))
    right = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).withColumn("asks", F.lit(False))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf.asks.to_numpy()
        x = np.frombuffer(b"".join(pdf.v), "f2").astype("f4").reshape(-1, dim)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        ids, q, r = pdf.id.to_numpy(), np.flatnonzero(asks), np.flatnonzero(~asks)
        out = []
        if len(q) and len(r):
            s = x[q] @ x[r].T
            s[ids[q][:, None] == ids[r][None, :]] = -2
            for i, row in zip(ids[q].tolist(), s):
                best = np.argpartition(-row, min(k, len(row) - 1))[:k] if len(row) > 1 else np.zeros(1, int)
                out += [(i, int(ids[r[j]]), float(row[j])) for j in best if row[j] > -1.5]
        res = pd.DataFrame(out, columns=["id", "other", "cos"]).astype({"id": "int64", "other": "int64", "cos": "float64"})
        res.insert(0, "model", pdf.model.iloc[0])
        return res

    hits = left.unionByName(right).groupBy("model", "block", "part").applyInPandas(run, "model string, id long, other long, cos double")
    return hits.withColumn("rn", F.row_number().over(Window.partitionBy("model", "id").orderBy(F.desc("cos"), "other"))).where(F.col("rn") <= k).drop("rn")
