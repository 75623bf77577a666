"""Work along a table's row order without putting the table in one task.

Rows are dealt in blocks by ranges of the order and written once with their block's number, so every later
plan reads the same blocks; only one row for each block meets in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.model import Table, hidden_name, quoted
from millrace.session import materialize

BLOCK = "__block"


def in_blocks(t: Table, backwards: bool = False, blocks: int | None = None) -> DataFrame:
    """The table's rows with BLOCK: the number of the range of the (reversed) row order that holds each.

    The number of blocks is that of the shuffle partitions unless given. Written under names of its own, so
    any column names will do; a column without a type becomes text.
    """
    keys = t.sort_keys(backwards)
    dealt = t.df.repartitionByRange(blocks, *keys) if blocks else t.df.repartitionByRange(*keys)
    dealt = dealt.withColumn(BLOCK, F.spark_partition_id())
    names = dealt.columns
    plain = dealt.select(*[
        (quoted(n).cast("string") if isinstance(dealt.schema[n].dataType, T.NullType) else quoted(n)).alias(f"c{i}") for i, n in enumerate(names)
    ])
    return materialize(plain, "blocks").toDF(*names)


def carried(t: Table, column: str, backwards: bool = False, blocks: int | None = None) -> DataFrame:
    """The table's rows with ``column`` filled by the nearest value before (behind, if ``backwards``) in row order."""
    keys, filled, carry = t.sort_keys(backwards), "__filled", "__carry"
    block = W.partitionBy(BLOCK).orderBy(*keys)
    df = in_blocks(t, backwards, blocks)
    df = df.withColumns({
        filled: F.last(quoted(column), ignorenulls=True).over(block.rowsBetween(W.unboundedPreceding, 0)),
        "__more": F.lead(F.lit(1)).over(block),
    })
    ends = df.where("__more is null").select(BLOCK, filled)
    order = W.orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    before = ends.select(BLOCK, F.last(filled, ignorenulls=True).over(order).alias(carry))
    df = df.join(F.broadcast(before), BLOCK, "left")  # one row for each block
    value = F.coalesce(filled, carry)
    return df.select(*[value.alias(n) if n == column else quoted(n) for n in t.df.columns])


def before(t: Table, value: Column, name: str, blocks: int | None = None) -> DataFrame:
    """The table's rows with ``name``: ``value`` of the row before in row order, NULL in the first row."""
    held, last = "__held", "__last"
    block = W.partitionBy(BLOCK).orderBy(*t.sort_keys())
    df = in_blocks(t, False, blocks).withColumn(held, F.struct(value.alias("v")))
    df = df.withColumns({last: F.lag(held).over(block), "__more": F.lead(F.lit(1)).over(block)})
    ends = df.where("__more is null").select((F.col(BLOCK)), F.col(held).alias("__end"))
    # Blocks may be missing where a range is empty: the one before is the one before among those that are there.
    ends = ends.select(BLOCK, F.lag("__end").over(W.orderBy(BLOCK)).alias("__end"))
    df = df.join(F.broadcast(ends), BLOCK, "left")  # one row for each block
    return df.select(*map(quoted, t.df.columns), F.coalesce(last, "__end")["v"].alias(name))


def numbered(t: Table, name: str, blocks: int | None = None) -> DataFrame:
    """The table's rows with ``name``: their number in row order, from 1 without gaps."""
    df = in_blocks(t, False, blocks)
    counts = df.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("__n"))
    first = counts.select(BLOCK, (F.sum("__n").over(W.orderBy(BLOCK)) - F.col("__n")).alias("__first"))
    at = F.row_number().over(W.partitionBy(BLOCK).orderBy(*t.sort_keys()))
    df = df.withColumn(name, at).join(F.broadcast(first), BLOCK)  # one row for each block
    return df.select(*map(quoted, t.df.columns), (F.col(name) + F.col("__first")).alias(name))


def position(t: Table) -> Column:
    """The row order as one value that compares as it does (missing keys last); all keys must ascend."""
    parts = [p for i, (n, _) in enumerate(t.order) for p in (quoted(n).isNull().alias(f"n{i}"), quoted(n).alias(f"k{i}"))]
    return F.struct(*parts)


def ascending_order(t: Table) -> Table:
    """A table whose order keys all ascend.

    A descending number or day is replaced by its mirror image; where another key descends, rows are
    numbered.
    """
    t = t.positioned()
    if all(up for _, up in t.order):
        return t
    mirrored: dict[str, Column] = {}
    order = []
    for n, up in t.order:
        kind, c = t.type_of(n), quoted(n)
        if up:
            order.append((n, True))
            continue
        if isinstance(kind, T.IntegralType):
            image = F.bitwise_not(c)  # mirrors without overflow
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            image = -c
        elif isinstance(kind, T.DateType):
            image = F.bitwise_not(F.unix_date(c))
        elif isinstance(kind, T.BooleanType):
            image = ~c
        else:
            own = hidden_name()
            return t.with_df(numbered(t, own), ((own, True),))
        own = hidden_name()
        mirrored[own] = image
        order.append((own, True))
    return t.with_df(t.df.withColumns(mirrored), tuple(order))
