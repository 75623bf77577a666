"""Joins of overlapping spans.

Bins are ranges of (key, start) that hold about equally many starts, so their width follows the data. A span
goes to every bin that it touches; a pair is made only in the bin where the later of its two starts lies. So a
span that covers everything costs a row a bin, and all but the outermost of those meet partners. In a bin
starts are sorted and each span takes the run of the other side's starts that lie within it; Spark makes rows of
the runs, so Python's work grows with the rows and only Spark's with the pairs found. Bins with more rows than a cell holds become grids of cells in which every pair
of rows meets once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.model import quoted
from millrace.operators.combination import suffixed
from millrace.relational.cells import TASKS, cells, columns_of, common, exact, expanded, lists, named, numbers, runs, sampled, written
from millrace.session import materialize

#: Rows of both sides in a bin, rows of a side in a cell, bins at most (two numbers each go to every task).
ROWS, CELL, BINS = 50_000, 100_000, 100_000


def _places(bounds: np.ndarray, h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many bounds lie at or below (h, x), by halving the ranges of all at once."""
    low, high = np.searchsorted(bounds["h"], h, "left"), np.searchsorted(bounds["h"], h, "right")
    while (open_ := low < high).any():
        mid = (low + high) // 2
        below = np.zeros(len(x), bool)
        below[open_] = bounds["s"][mid[open_]] <= x[open_]
        low, high = np.where(open_ & below, mid + 1, low), np.where(open_ & ~below, mid, high)
    return low


def _bins(bounds: np.ndarray):
    @F.pandas_udf("low int, high int")
    def made(h: pd.Series, s: pd.Series, e: pd.Series) -> pd.DataFrame:
        at = h.to_numpy()
        return pd.DataFrame({"low": _places(bounds, at, s.to_numpy()), "high": _places(bounds, at, e.to_numpy())}).astype("int32")

    return made


def _ranks(h: list[np.ndarray], x: list[np.ndarray]) -> list[np.ndarray]:
    """Whole numbers that compare as the pairs (h, x) do, over several arrays."""
    codes = np.unique(np.concatenate(h), return_inverse=True)[1]
    values, at = np.unique(np.concatenate(x), return_inverse=True)
    return np.split(codes.astype(np.int64) * len(values) + at, np.cumsum([len(a) for a in h])[:-1])


def _overlaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of overlapping spans of each cell, by the start that lies in the cell's bin."""
    for cell in cells(batches, ["bin", "i", "j"]):
        left, right = (cell.filter(pc.equal(cell["side"], n)) for n in (0, 1))
        if not (left.num_rows and right.num_rows):
            continue
        col = lambda c: [t[c].to_numpy() for t in (left, right)]  # noqa: E731, B023
        h, s, e, here = col("h"), col("s"), col("e"), col("starts")
        ls, rs, le, re = _ranks([*h, *h], [*s, *e])
        order = [np.flatnonzero(a)[np.argsort(r[a], kind="stable")] for a, r in zip(here, (ls, rs), strict=True)]
        starts = [r[o] for o, r in zip(order, (ls, rs), strict=True)]
        rows = [columns_of(t[c]) for t, c in ((left, "l"), (right, "r"))]
        sorted_ = [[c.take(pa.array(o)) for c in side] for side, o in zip(rows, order, strict=True)]
        # The left start within the right span, or the right start within the left span and behind its start.
        yield from runs(rows[1], sorted_[0], np.arange(right.num_rows), np.searchsorted(starts[0], rs, "left"), np.searchsorted(starts[0], re, "right"), True)
        yield from runs(rows[0], sorted_[1], np.arange(left.num_rows), np.searchsorted(starts[1], ls, "right"), np.searchsorted(starts[1], le, "right"))


def interval_join(
    left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], on: Sequence[tuple[str, str]] = (),
    closed: bool = True, rows: int = ROWS, cell: int = CELL,
) -> DataFrame:
    """All pairs of rows whose spans overlap: left start <= right end and right start <= left end (< unless ``closed``).

    Spans are numbers, or dates and timestamps; a point is a span that starts and ends with it. ``on``: pairs of
    key columns that must be equal. Missing starts, ends and keys match nothing, nor do spans that end before
    they start. Repeated rows all count. Clashing columns of the right table get _right. Both tables are written once when the join is
    planned. No left row without a partner is kept.
    """
    named(left, [*left_span, *(a for a, _ in on)])
    named(right, [*right_span, *(b for _, b in on)])
    ls, le, rs, re = numbers([(left, left_span[0]), (left, left_span[1]), (right, right_span[0]), (right, right_span[1])])
    sides, kinds = [], common(left, right, on)
    for df, s, e, keys, name in ((left, ls, le, [a for a, _ in on], "l"), (right, rs, re, [b for _, b in on], "r")):
        df = written(df)
        h = F.xxhash64(*[quoted(k).cast(t) for k, t in zip(keys, kinds, strict=True)]) if keys else F.lit(0).cast("long")
        known = reduce(lambda a, b: a & b, [quoted(k).isNotNull() for k in keys], F.lit(True))
        part = df.select(F.struct(*map(quoted, df.columns)).alias(name), h.alias("h"), s.alias("s"), e.alias("e"), known.alias("known"))
        sides.append(materialize(part.where("known and s <= e").drop("known"), f"spans-{name}"))
    counts = [d.count() for d in sides]
    starts = sides[0].select("h", "s").unionAll(sides[1].select("h", "s"))
    drawn = sampled(starts, ["h", "s"], sum(counts))
    bins = min(BINS, -(-sum(counts) // rows), max(1, len(drawn)))
    bounds = np.unique(drawn[[len(drawn) * i // bins for i in range(1, bins)]]) if bins > 1 else drawn[:0]
    placed = []
    for n, d in enumerate(sides):
        d = d.withColumn("at", _bins(bounds)("h", "s", "e"))
        d = d.withColumn("bin", F.explode(F.sequence("at.low", "at.high")))
        placed.append(d.withColumn("starts", F.col("bin") == F.col("at.low")).drop("at").withColumn("side", F.lit(n)))
    grid = _grid(placed, cell)
    laid = []
    for n, d in enumerate(placed):
        if grid is not None:
            # At most BINS rows.
            d = d.join(F.broadcast(grid), "bin", "left").fillna(1, ["g0", "g1"])
            own = F.floor(F.rand(n) * F.col(f"g{n}")).cast("int")
            other = F.explode(F.sequence(F.lit(0), F.col(f"g{1 - n}") - 1))
            d = d.withColumn("ij"[n], own).withColumn("ji"[n], other)
        else:
            d = d.withColumns({"i": F.lit(0), "j": F.lit(0)})
        d = d if n else d.withColumn("r", F.lit(None).cast(sides[1].schema["r"].dataType))
        d = d if not n else d.withColumn("l", F.lit(None).cast(sides[0].schema["l"].dataType))
        laid.append(d.select("bin", "i", "j", "side", "h", "s", "e", "starts", "l", "r"))
    # So many tasks as there are bins: what a task makes grows with its pairs, not with the bytes that Spark would even out.
    dealt = laid[0].unionAll(laid[1]).repartition(min(TASKS, bins * (1 if grid is None else 8)), "bin", "i", "j").sortWithinPartitions("bin", "i", "j")
    types = [d.schema[c].dataType for d, c in zip(sides, "lr", strict=True)]
    found, l, r = expanded(dealt.mapInArrow(_overlaps, lists(*types)), *types)  # noqa: E741
    a, b = l[left_span[0]], r[right_span[0]]
    kinds = [df.schema[c].dataType for df, span in ((left, left_span), (right, right_span)) for c in span]
    sure = closed and exact(kinds) and kinds[0].typeName() not in ("float", "double")
    held = F.lit(True) if sure else (a <= r[right_span[1]]) & (b <= l[left_span[1]]) if closed else (a < r[right_span[1]]) & (b < l[left_span[1]])
    for k, c in on:
        held &= l[k] == r[c]
    names = suffixed(list(right.columns), set(left.columns))
    return found.where(held).select(*[l[c].alias(c) for c in left.columns], *[r[c].alias(names.get(c, c)) for c in right.columns])


def _grid(placed: list[DataFrame], cell: int) -> DataFrame | None:
    """bin, g0, g1: into how many parts the left and right rows of bins fall that hold more than a cell; None if none does."""
    counts = placed[0].select("bin", "side").unionAll(placed[1].select("bin", "side")).groupBy("bin").agg(
        *[F.ceil(F.count_if(F.col("side") == n) / cell).cast("int").alias(f"g{n}") for n in (0, 1)]
    )
    hot = [tuple(r) for r in counts.where("g0 > 1 or g1 > 1").toLocalIterator()]
    spark = placed[0].sparkSession
    return spark.createDataFrame([(b, max(1, x), max(1, y)) for b, x, y in hot], "bin int, g0 int, g1 int") if hot else None
