"""Filling fixed-capacity containers by cost-balanced packing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of one packing lot: bounds a task and keeps the waste of the lots' last containers under one in some hundred.
LOT_TOKENS = 1_000_000
LINEAR, QUADRATIC = 1.0, 1.0 / 2048


def pieces(sized: DataFrame, capacity: int, size: str = "n_tokens") -> DataFrame:
    """A row for each piece: a document that fits is one piece; only a larger one is divided, into full pieces and a rest."""
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / capacity).cast("int"))
    return sized.withColumn("n_pieces", n).withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1))).withColumn("piece_tokens", F.when(F.col("piece_no") < F.col("n_pieces") - 1, F.lit(capacity)).otherwise(F.col(size) - F.col("piece_no") * capacity).cast("int"))


def balanced(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of each size, sizes descending: each goes to the sequence of lowest cost that has room.

    The cost of a sequence is linear in its tokens plus quadratic in each document's (attention within documents). The
    fewest sequences that could hold everything are opened at once; sequences are held by remaining capacity, and a new
    one is opened only when none has room.
    """
    total = int(sizes.sum())
    n = max(1, -(-total // capacity))
    place = np.empty(len(sizes), dtype=np.int64)
    free = [capacity] * n
    heap = [(0.0, k) for k in range(n)]
    for i, s in enumerate(sizes.tolist()):
        cost = LINEAR * s + QUADRATIC * s * s
        aside = []
        chosen = None
        while heap:
            c, k = heapq.heappop(heap)
            if free[k] >= s:
                chosen = (c, k)
                break
            if free[k] >= 1:
                aside.append((c, k))
        for x in aside:
            heapq.heappush(heap, x)
        if chosen is None:
            free.append(capacity)
            chosen = (0.0, len(free) - 1)
        c, k = chosen
        free[k] -= s
        place[i] = k
        if free[k] > 0:
            heapq.heappush(heap, (c + cost, k))
    return place


def pack(sized: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens", lot_tokens: int = LOT_TOKENS) -> DataFrame:
    """Containers of all documents: (lot, container, position, key, piece_no, n_pieces, piece_tokens).

    Documents are dealt by a hash of the key into lots of about ``lot_tokens`` tokens, so that a task never holds more
    than a lot whatever the corpus has; each lot is packed for itself. Null and empty texts (null or 0 tokens) get no container
    of their own: they are listed with container null and position null. Rows with the same key, or with none, are separate
    pieces of work and all are placed. An empty table gives no rows.
    """
    p = pieces(sized.select(key, F.coalesce(F.col(size), F.lit(0)).alias(size)), capacity, size)
    total = sized.agg(F.coalesce(F.sum(F.col(size).cast("long")), F.lit(0))).first()[0]
    lots = max(1, round(total / lot_tokens))
    # one key may come very often, so its pieces and sizes share the dealing
    p = p.withColumn("lot", F.pmod(F.xxhash64(key, "piece_no", "piece_tokens"), F.lit(lots)).cast("int"))
    schema = f"lot int, container int, position int, {key} bigint, piece_no int, n_pieces int, piece_tokens int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf[key] = pdf[key].astype("Int64")
        pdf = pdf.sort_values(["piece_tokens", key, "piece_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        filled = pdf[pdf.piece_tokens > 0].copy()
        empty = pdf[pdf.piece_tokens <= 0].copy()
        filled["container"] = balanced(filled.piece_tokens.to_numpy(np.int64), capacity)
        filled["position"] = filled.groupby("container").cumcount()
        out = pd.concat([filled, empty.assign(container=None, position=None)])
        return out[["lot", "container", "position", key, "piece_no", "n_pieces", "piece_tokens"]].astype({"container": "Int32", "position": "Int32"})

    return p.select("lot", key, "piece_no", "n_pieces", "piece_tokens").groupBy("lot").applyInPandas(run, schema)


def first_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Containers by plain first fit of descending sizes, to measure the cost-balanced ones against."""
    free: list[int] = []
    place = np.empty(len(sizes), dtype=np.int64)
    for i, s in enumerate(sizes.tolist()):
        k = next((k for k, room in enumerate(free) if room >= s), len(free))
        if k == len(free):
            free.append(capacity)
        free[k] -= s
        place[i] = k
    return place


def cost_spread(sizes: np.ndarray, place: np.ndarray) -> float:
    """The standard deviation of the sequences' quadratic costs over their mean: 0 where all cost the same."""
    cost = np.bincount(place, weights=sizes.astype("f8") ** 2)
    return float(cost.std() / max(cost.mean(), 1e-9))
