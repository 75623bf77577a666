"""Exact quantiles and modes of groups of any size.

Equal values are counted first, with map-side combine. Where a group has few enough different values their
counts are aggregated; else the values are dealt in blocks by range, counts are summed along the blocks,
and the values at the wanted ranks are picked, so no task holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.model import Table, hidden_name, quoted
from millrace.operators.ordering import BLOCK, in_blocks
from millrace.session import materialize

#: Different values of a group that one task may hold (some 50 bytes each).
MOST = 1_000_000


def group_quantiles(df: DataFrame, by: Sequence[str], value: Column, fractions: Sequence[float], names: Sequence[str], most: int | None = None) -> DataFrame:
    """A row for each group: the ``by`` columns and, linearly interpolated, the quantiles of ``value``.

    Missing keys form a group; missing values are left out, and so are groups without any.
    """
    keys = [hidden_name() for _ in by]
    x = value.cast("double").alias("x")
    counted = df.select(*[quoted(c).alias(k) for c, k in zip(by, keys, strict=True)], x).where("x is not null")
    cells = materialize(counted.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n")), "values")
    largest = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("d")).agg(F.max("d")).head()[0] or 0
    if largest <= (MOST if most is None else most):
        out = cells.groupBy(*keys).agg(*[F.percentile("x", float(f), F.col("n")).alias(n) for f, n in zip(fractions, names, strict=True)])
        out = out.where(F.col(names[0]).isNotNull()) if not by else out
    else:
        out = _by_ranks(cells, keys, fractions, names)
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], *names)


def _by_ranks(cells: DataFrame, keys: list[str], fractions: Sequence[float], names: Sequence[str]) -> DataFrame:
    ordered = Table("values", cells, "", (*((k, True) for k in keys), ("x", True)))
    dealt = in_blocks(ordered)
    parts = dealt.groupBy(*keys, BLOCK).agg(F.sum("n").alias("in_block"))
    of_key = W.partitionBy(*[F.col(k) for k in keys])  # a row for each block of a group
    parts = parts.select(
        *keys, BLOCK, (F.sum("in_block").over(of_key.orderBy(BLOCK)) - F.col("in_block")).alias("start"), F.sum("in_block").over(of_key).alias("total")
    )
    same = F.col(BLOCK) == F.col("__b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    parts = parts.select(F.col(BLOCK).alias("__b"), *[F.col(k).alias(f"_{k}") for k in keys], "start", "total")
    behind = F.sum("n").over(W.partitionBy(BLOCK, *keys).orderBy("x"))
    rows = dealt.withColumn("upto", behind).join(parts, same).select(
        *keys, "x", "total", (F.col("start") + F.col("upto") - F.col("n")).alias("low"), (F.col("start") + F.col("upto")).alias("high")
    )
    made = []
    for f, name in zip(fractions, names, strict=True):
        at = (F.col("total") - 1) * F.lit(float(f))
        low, high = F.floor(at), F.ceil(at)
        a = F.max(F.when((F.col("low") <= low) & (low < F.col("high")), F.col("x")))
        b = F.max(F.when((F.col("low") <= high) & (high < F.col("high")), F.col("x")))
        share = F.max(at - low)
        made.append(F.when(a == b, a).otherwise((1 - share) * a + share * b).alias(name))
    return rows.groupBy(*keys).agg(*made)


def quantiles(df: DataFrame, value: Column, fractions: Sequence[float], most: int | None = None) -> list[float] | None:
    """Quantiles of the whole column, or None if it has no values."""
    names = [f"q{i}" for i in range(len(fractions))]
    row = group_quantiles(df, [], value, fractions, names, most).head()
    return None if row is None or row[0] is None else list(row)


def most_frequent(df: DataFrame, value: Column):
    """The value that occurs most often, the least of several, or None."""
    counts = df.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    row = counts.orderBy(F.desc("n"), F.asc("v")).limit(1).head()
    return None if row is None else row[0]
