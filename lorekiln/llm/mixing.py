"""Mixing sources to target weights by fitting token budgets exactly."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SALTS = 16
SEED = 17
#: The dynamic programme runs over at most so many tokens of a source's rest.
REST = 16_384


def clean_source(c):
    """A source's name without case and outer blanks; blank counts as null."""
    s = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(s != "", s)


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length make up ``budget`` tokens, or the most tokens under it.

    A budget beyond REST first takes its proportional share of every length; whole documents, long ones first, then bring the rest down to
    REST tokens; a bounded knapsack over the lengths left (reachable sums as the bits of one integer) fits that rest.
    """
    total = sum(k * v for k, v in counts.items())
    if budget >= total:
        return dict(counts)
    if budget <= 0:
        return {}
    take = {k: v * budget // total if budget > REST else 0 for k, v in counts.items()}
    rest = budget - sum(k * v for k, v in take.items())
    for k in sorted(counts, reverse=True):
        while rest - REST >= k and take[k] < counts[k]:
            n = min((rest - REST) // k, counts[k] - take[k])
            take[k] += n
            rest -= n * k
    mask = (1 << (rest + 1)) - 1
    reach, steps = 1, []
    for k in sorted(counts):
        left = min(counts[k] - take[k], rest // k if k else 0)
        part = 1
        while left > 0:  # binary split of the bound
            n = min(part, left)
            grown = (reach | (reach << (k * n))) & mask
            steps.append((k, n, reach))
            reach, left, part = grown, left - n, part * 2
        if reach == mask:
            break
    at = reach.bit_length() - 1
    for k, n, before in reversed(steps):
        if not (before >> at) & 1:
            take[k] += n
            at -= k * n
    return {k: v for k, v in take.items() if v}


def plan(histogram: dict[str, dict[int, int]], targets: dict[str, tuple[float, int]], total: int | None = None) -> tuple[dict[str, tuple[int, dict[int, int]]], int]:
    """For each source the full repeats and the documents of each length once more; and the mixture's size.

    Without ``total`` the mixture is as large as every share can be met at without a source exceeding its repeats; with it, a
    source that cannot reach its budget gives all it may, and the shares reached say so.
    """
    size = {s: sum(k * v for k, v in histogram.get(s, {}).items()) for s in targets}
    most = min((size[s] * cap / share for s, (share, cap) in targets.items() if share > 0 and size[s] > 0), default=0)
    total = int(most) if total is None else total
    out = {}
    for s, (share, cap) in targets.items():
        if size[s] == 0 or share <= 0 or cap <= 0:
            out[s] = (0, {})
            continue
        budget = min(round(total * share), size[s] * cap)
        full, rest = divmod(budget, size[s])
        out[s] = (full, fit(histogram[s], rest) if full < cap else {})
    return out, total


def mix(sized: DataFrame, targets: DataFrame, total: int | None = None, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """(source, key, n_tokens, repeats) of the chosen documents.

    ``sized``: key, source, n_tokens. ``targets``: source, target_share, max_repeats (a few rows). Sources are compared without
    case and outer blanks; documents of no or an unknown source, and those of 0 tokens, aren't drawn. Which documents of a
    length are drawn is decided by a seeded hash of the key; the quota of a length is dealt over SALTS lots, so that no task
    orders all documents of one length. Only the counts by source and length come to the driver (a length is at most the
    longest document's tokens, whatever the number of documents). Null keys are left out; repeated keys count each time.
    """
    spark = sized.sparkSession
    wanted = {}
    for r in targets.select(clean_source(F.col("source")).alias("s"), "target_share", "max_repeats").collect():
        if r.s is not None:
            wanted[r.s] = (r.target_share or 0.0, r.max_repeats or 0)
    docs = sized.select(F.col(key), clean_source(F.col("source")).alias("source"), "n_tokens").where(F.col(key).isNotNull() & (F.col("n_tokens") > 0) & F.col("source").isin(list(wanted)))
    docs = docs.withColumn("u", F.xxhash64(F.lit(seed), F.col(key))).withColumn("salt", F.pmod("u", F.lit(SALTS)).cast("int"))
    by_salt = docs.groupBy("source", "n_tokens", "salt").agg(F.count("*").alias("n"))
    histogram: dict[str, dict[int, int]] = defaultdict(dict)
    for r in by_salt.groupBy("source", "n_tokens").agg(F.sum("n").alias("n")).collect():
        histogram[r.source][r.n_tokens] = r.n
    chosen, _ = plan(histogram, wanted, total)
    rows = [(s, k, full, extra.get(k, 0)) for s, (full, extra) in chosen.items() for k in histogram.get(s, {}) if full or extra.get(k)]
    quota = spark.createDataFrame(rows, "source string, n_tokens int, full int, extra long")
    w = Window.partitionBy("source", "n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    dealt = by_salt.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).join(quota, ["source", "n_tokens"]).select("source", "n_tokens", "salt", "full", F.greatest(F.lit(0), F.col("extra") - F.col("before")).alias("more"))
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "salt").orderBy("u", key))
    return docs.withColumn("rn", rank).join(dealt, ["source", "n_tokens", "salt"]).withColumn("repeats", (F.col("full") + F.when(F.col("rn") <= F.col("more"), 1).otherwise(0)).cast("int")).where("repeats > 0").select("source", key, "n_tokens", "repeats")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, share, most_repeats) of every target; sources that gave nothing have 0 tokens."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens").cast("long") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"), F.count("*").alias("documents"))
    t = targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    all_tokens = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())
    return t.join(got, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.round(F.coalesce("tokens", F.lit(0)) / all_tokens, 6).alias("share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
