"""Column builders over arrays that stay linear in the array's length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Running sums copy their result at each step, so they run in blocks of this many items.
BLOCK = 256
#: A table of so many rows at most is small: it may be broadcast, or its values become literals of a filter.
SMALL_ROWS = 20_000


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named: within a lambda an expression is evaluated anew for each
    item otherwise."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before(numbers: Column) -> Column:
    """For each number of an array the sum of those before it."""
    none = F.array().cast("array<int>")

    def sums(xs: Column, start: Column) -> Column:
        step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(xs, F.struct(start.cast("int").alias("at"), none.alias("out")), step, lambda a: a["out"])

    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, n: a + n)
    blocks = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))
    whole = lambda xs: let(blocks(xs), lambda bs: F.flatten(F.zip_with(bs, sums(F.transform(bs, total), F.lit(0)), sums)))
    return let(numbers, lambda xs: F.when(F.size(xs) == 0, none).when(F.size(xs) <= BLOCK, sums(xs, F.lit(0))).otherwise(whole(xs)))


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` for a join: broadcast where it has at most ``rows`` rows, else left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
