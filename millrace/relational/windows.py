"""Window functions over frames that no single task could hold.

Rows are dealt in blocks by ranges of (partition keys, order), written once. Running aggregates are made
within blocks; what a key gathered in the blocks before reaches the next block as one row, joined by block
and key. So a key with most of the rows, or no key at all, is spread over all blocks. Frames of a bounded
number of rows are cut from chunks of consecutive positions with a halo of copied rows; beyond ``WIDE`` rows a
frame is the end of one chunk and the start of the next, both running aggregates (each chunk as long as the frame).

Order: ``order`` names columns, ``-name`` descending; missing values last; rows that tie are in the order in
which they are read. NULL is a key of its own. An empty table stays empty. Columns may have any names;
a result replaces a column of its own name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from millrace.model import Table, hidden_name, quoted
from millrace.operators.ordering import BLOCK, in_blocks
from millrace.session import materialize

#: Positions in a chunk at least, and the longest frame that is cut from chunks.
CHUNK, WIDE = 1 << 16, 1 << 18
#: The longest frame whose two running aggregates are made in one chunk.
HELD = 1 << 20

#: name -> (aggregate, how a carried value and one's own are merged)
KINDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.count, lambda a, b: F.coalesce(a + b, a, b)),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "first": (lambda c: F.first(c, ignorenulls=True), F.coalesce),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}
Wanted = Mapping[str, tuple[str, Column | str]]


def column(c: Column | str) -> Column:
    return quoted(c) if isinstance(c, str) else c


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[Table, list[str]]:
    """The rows with the order of their keys and ``order``, made whole by a hidden number; and the hidden columns."""
    at = hidden_name()
    steps = [(k, True) for k in keys] + [(o.removeprefix("-"), not o.startswith("-")) for o in order]
    missing = [n for n, _ in steps if n not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}; columns: {df.columns}")
    return Table("rows", df.withColumn(at, F.monotonically_increasing_id()), "", (*steps, (at, True))), [at]


def _plain(wanted: Wanted) -> dict[str, tuple[str, Column]]:
    """Means as sums and counts; unknown kinds are refused."""
    out: dict[str, tuple[str, Column]] = {}
    for name, (kind, c) in wanted.items():
        if kind == "mean":
            out[f"{name} sum"], out[f"{name} count"] = ("sum", column(c).cast("double")), ("count", column(c))
        elif kind in KINDS:
            out[name] = (kind, column(c))
        else:
            raise ValueError(f"unknown aggregate {kind!r}; known: {[*KINDS, 'mean']}")
    return out


def _finished(wanted: Wanted, held: Mapping[str, Column]) -> dict[str, Column]:
    return {
        n: F.when(held[f"{n} count"] > 0, held[f"{n} sum"] / held[f"{n} count"]) if kind == "mean" else held[n]
        for n, (kind, _) in wanted.items()
    }


def _running(t: Table, keys: Sequence[str], plain: Mapping[str, tuple[str, Column]], backwards: bool, blocks: int | None) -> tuple[DataFrame, dict[str, Column]]:
    """The rows in blocks, and the columns of running aggregates by name."""
    own, before = {n: hidden_name() for n in plain}, {n: hidden_name() for n in plain}
    more, to = hidden_name(), hidden_name()
    order = t.sort_keys(backwards)
    frame = W.partitionBy(BLOCK, *map(quoted, keys)).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    df = in_blocks(t, backwards, blocks).withColumns({
        **{own[n]: KINDS[kind][0](c).over(frame) for n, (kind, c) in plain.items()},
        more: F.lead(F.lit(1)).over(W.partitionBy(BLOCK).orderBy(*order)),
    })
    # A block's last row holds what the block has of its last key, the only key that later blocks can go on with.
    ends = df.where(quoted(more).isNull())
    sofar = W.partitionBy(*map(quoted, keys)).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, 0)
    named = {k: hidden_name() for k in keys}
    ends = ends.select(
        F.lead(BLOCK).over(W.orderBy(BLOCK)).alias(to), *[quoted(k).alias(h) for k, h in named.items()],
        *[_again(kind, quoted(own[n])).over(sofar).alias(before[n]) for n, (kind, _) in plain.items()],
    )
    match = quoted(BLOCK) == quoted(to)
    for k, h in named.items():
        match &= quoted(k).eqNullSafe(quoted(h))
    df = df.join(F.broadcast(ends), match, "left")  # one row for each block
    return df, {n: KINDS[kind][1](quoted(before[n]), quoted(own[n])) for n, (kind, _) in plain.items()}


def _again(kind: str, partial: Column) -> Column:
    """The aggregate of aggregates."""
    return KINDS["sum" if kind == "count" else kind][0](partial)


def _with(df: DataFrame, columns: Sequence[str], made: Mapping[str, Column]) -> DataFrame:
    return df.select(*[quoted(c) for c in columns if c not in made], *[c.alias(n) for n, c in made.items()])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], wanted: Wanted, backwards: bool = False, blocks: int | None = None) -> DataFrame:
    """``df`` with aggregates of all rows of the key up to each row (from each row on, if ``backwards``).

    ``wanted``: name -> (sum, count, min, max, mean, first or last, column or expression). Missing values are
    passed over; a sum or mean of none is NULL. Floating sums may differ in their last digits from
    those of one pass.
    """
    t, _ = in_order(df, keys, order)
    made, held = _running(t, keys, _plain(wanted), backwards, blocks)
    return _with(made, df.columns, _finished(wanted, held))


def _numbered(t: Table, keys: Sequence[str], name: str, blocks: int | None) -> DataFrame:
    """The rows with their number within the key, from 0."""
    if keys:
        made, held = _running(t, keys, {"n": ("count", F.lit(1))}, False, blocks)
        return _with(made, t.df.columns, {name: held["n"] - 1})
    # Ranges are sorted before they are written, so a row's number in its range is known there: no second shuffle.
    order, at, block, upto = t.sort_keys(), hidden_name(), hidden_name(), hidden_name()
    dealt = (t.df.repartitionByRange(blocks, *order) if blocks else t.df.repartitionByRange(*order)).sortWithinPartitions(*order)
    names = t.df.columns
    plain = dealt.select(*[
        (quoted(n).cast("string") if isinstance(t.df.schema[n].dataType, NullType) else quoted(n)).alias(f"c{i}") for i, n in enumerate(names)
    ], F.monotonically_increasing_id().alias(at))
    rows = materialize(plain, "numbered").toDF(*names, at).withColumn(block, F.shiftright(quoted(at), 33))
    counts = rows.groupBy(block).agg(F.count(F.lit(1)).alias(upto))
    firsts = counts.select(block, (F.sum(upto).over(W.orderBy(block)) - quoted(upto)).alias(upto))
    rows = rows.join(F.broadcast(firsts), block)  # one row for each block
    return rows.select(*map(quoted, names), (quoted(upto) + quoted(at).bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def _chunks(df: DataFrame, at: str, before: int, after: int, chunk: int) -> tuple[DataFrame, str, str]:
    """Rows copied to every chunk of positions in which a frame of ``before`` and ``after`` rows can meet them."""
    mine, to = hidden_name(), hidden_name()
    low = F.greatest(F.floor((quoted(at) - after) / chunk), F.lit(0))
    df = df.withColumn(mine, F.floor(quoted(at) / chunk))
    return df.withColumn(to, F.explode(F.sequence(low, F.floor((quoted(at) + before) / chunk)))), mine, to


def rolling(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], wanted: Wanted, before: int, after: int = 0,
    chunk: int = CHUNK, wide: int = WIDE, blocks: int | None = None,
) -> DataFrame:
    """``df`` with aggregates of ``before`` rows before to ``after`` rows behind each row, within its key."""
    if min(before, after) < 0:
        raise ValueError("frames reach back and ahead by 0 or more rows")
    t, hidden = in_order(df, keys, order)
    plain, at, length = _plain(wanted), hidden_name(), before + after + 1
    if length <= wide:
        rows = _numbered(t, [], at, blocks)
        rows, mine, to = _chunks(rows, at, before, after, max(chunk, length))
        frame = W.partitionBy(quoted(to), *map(quoted, keys)).orderBy(quoted(at)).rowsBetween(-before, after)
        own = {n: hidden_name() for n in plain}
        rows = rows.withColumns({own[n]: KINDS[kind][0](c).over(frame) for n, (kind, c) in plain.items()})
        rows = rows.where(quoted(mine) == quoted(to))
        return _with(rows, df.columns, _finished(wanted, {n: quoted(c) for n, c in own.items()}))
    if length <= HELD:
        return _wide(_numbered(t, [], at, blocks), df.columns, keys, wanted, at, before, after, max(chunk, length))
    # Chunks as long as the frame: every frame is the end of one chunk and the start of the next, or one chunk.
    part, own = hidden_name(), {n: (hidden_name(), hidden_name()) for n in plain}
    rows = _numbered(t, keys, at, blocks).withColumn(part, F.floor(quoted(at) / length))
    ends = []
    for side, backwards in enumerate((True, False)):
        step = Table("rows", rows, "", (*((k, True) for k in keys), (part, True), (at, True)))
        turn = {"first": "last", "last": "first"} if backwards else {}
        made, held = _running(step, [*keys, part], {n: (turn.get(kind, kind), c) for n, (kind, c) in plain.items()}, backwards, blocks)
        ends.append(made.select(*map(quoted, keys), quoted(at), *[held[n].alias(own[n][side]) for n in plain]))
    size, low, high = hidden_name(), hidden_name(), hidden_name()
    sizes = rows.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias(size))
    rows = _joined(rows, sizes, [(k, k) for k in keys]).withColumns({
        low: F.greatest(quoted(at) - before, F.lit(0)), high: F.least(quoted(at) + after, quoted(size) - 1)
    })
    rows = _joined(rows, ends[0], [*((k, k) for k in keys), (low, at)])
    rows = _joined(rows, ends[1], [*((k, k) for k in keys), (high, at)])
    one = F.floor(quoted(low) / length) == F.floor(quoted(high) / length)
    # Within one chunk a frame starts with the chunk, or ends with its last row.
    starts = quoted(low) % length == 0
    held = {
        n: F.when(one, F.when(starts, quoted(b)).otherwise(quoted(a))).otherwise(KINDS[kind][1](quoted(a), quoted(b)))
        for (n, (kind, _)), (a, b) in zip(plain.items(), own.values(), strict=True)
    }
    return _with(rows, df.columns, _finished(wanted, held))


def _wide(rows: DataFrame, columns: Sequence[str], keys: Sequence[str], wanted: Wanted, at: str, before: int, after: int, chunk: int) -> DataFrame:
    """Frames from two running aggregates of parts as long as a frame, within chunks: rows are dealt once."""
    plain, length, part = _plain(wanted), before + after + 1, hidden_name()
    rows, mine, to = _chunks(rows, at, before, after, chunk)
    rows = rows.repartition(quoted(to)).withColumn(part, F.floor(quoted(at) / length))
    cell = W.partitionBy(quoted(to), *map(quoted, keys))
    within = W.partitionBy(quoted(to), *map(quoted, keys), quoted(part))
    head, tail, low, high, cut = (hidden_name() for _ in range(5))
    turn = {"first": "last", "last": "first"}
    upto = [KINDS[kind][0](c).over(within.orderBy(quoted(at)).rowsBetween(W.unboundedPreceding, 0)).alias(f"v{i}") for i, (kind, c) in enumerate(plain.values())]
    since = [KINDS[turn.get(kind, kind)][0](c).over(within.orderBy(quoted(at).desc()).rowsBetween(W.unboundedPreceding, 0)).alias(f"v{i}") for i, (kind, c) in enumerate(plain.values())]
    rows = rows.withColumn(head, F.struct(quoted(at).alias("at"), *upto)).withColumn(tail, F.struct(quoted(at).alias("at"), *since))
    # A frame that is cut begins with the first row of its key, or ends with the last: the cell holds either.
    line, whole = cell.orderBy(quoted(at)), cell.orderBy(quoted(at)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumns({
        low: F.coalesce(F.lag(tail, before).over(line), F.first(tail).over(whole)), cut: F.lag(tail, before).over(line).isNull(), high: F.coalesce(F.lead(head, after).over(line), F.last(head).over(whole)),
    }).where(quoted(mine) == quoted(to))
    a, b = quoted(low), quoted(high)
    one = F.floor(a["at"] / length) == F.floor(b["at"] / length)
    starts = quoted(cut) | (a["at"] % length == 0)
    held = {
        n: F.when(one, F.when(starts, b[f"v{i}"]).otherwise(a[f"v{i}"])).otherwise(KINDS[kind][1](a[f"v{i}"], b[f"v{i}"]))
        for i, (n, (kind, _)) in enumerate(plain.items())
    }
    return _with(rows, columns, _finished(wanted, held))


def _joined(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Left join by keys of which NULL is one; the right's keys are dropped."""
    named = {b: hidden_name() for _, b in pairs}
    right = right.select(*[quoted(c).alias(named.get(c, c)) for c in right.columns])
    match = F.lit(True)
    for a, b in pairs:
        match &= quoted(a).eqNullSafe(quoted(named[b]))
    return left.join(right, match, "left").drop(*named.values())


def shifted(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], wanted: Mapping[str, tuple[Column | str, int]], chunk: int = CHUNK, blocks: int | None = None,
) -> DataFrame:
    """``df`` with values of rows before (positive number) or behind (negative) within the key; NULL where there is none."""
    t, _ = in_order(df, keys, order)
    before, after = max(0, *[n for _, n in wanted.values()]), max(0, *[-n for _, n in wanted.values()])
    at = hidden_name()
    rows, mine, to = _chunks(_numbered(t, [], at, blocks), at, before, after, max(chunk, before + after + 1))
    frame = W.partitionBy(quoted(to), *map(quoted, keys)).orderBy(quoted(at))
    own = {n: hidden_name() for n in wanted}
    rows = rows.withColumns({own[n]: (F.lag(column(c), k) if k >= 0 else F.lead(column(c), -k)).over(frame) for n, (c, k) in wanted.items()})
    return _with(rows.where(quoted(mine) == quoted(to)), df.columns, {n: quoted(c) for n, c in own.items()})


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], wanted: Mapping[str, str], blocks: int | None = None) -> DataFrame:
    """``df`` with row_number, rank or dense_rank (name -> kind) within the key."""
    unknown = set(wanted.values()) - {"row_number", "rank", "dense_rank"}
    if unknown:
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    t, _ = in_order(df, keys, order)
    n, r, d, more, start, value, to, same, joins, at, n0, r0, d0, v0 = (hidden_name() for _ in range(14))
    whole, ties = t.sort_keys(), t.sort_keys()[:-1]
    own = W.partitionBy(BLOCK, *map(quoted, keys))
    # Numbers within the block; the rows of a key in a block are known by their first value.
    rows = in_blocks(t, False, blocks).withColumn(value, F.struct(*[quoted(o.removeprefix("-")).alias(f"c{i}") for i, o in enumerate(order)]))
    rows = rows.withColumns({
        n: F.row_number().over(own.orderBy(*whole)).cast("long"), start: F.first(value).over(own.orderBy(*whole).rowsBetween(W.unboundedPreceding, 0)),
        more: F.lead(F.lit(1)).over(W.partitionBy(BLOCK).orderBy(*whole)),
        r: F.rank().over(own.orderBy(*ties)).cast("long"), d: F.dense_rank().over(own.orderBy(*ties)).cast("long"),
    })
    # A block's last row holds what the block has of its last key, the only key that later blocks can go on with.
    sofar = W.partitionBy(*map(quoted, keys)).orderBy(BLOCK)
    ends = rows.where(quoted(more).isNull()).withColumns({
        at: F.lead(BLOCK).over(W.orderBy(BLOCK)), same: F.coalesce(F.lag(value).over(sofar).eqNullSafe(quoted(start)), F.lit(False)).cast("long"),
    })
    # Its last value's rank is that of an earlier block where the value has gone on since.
    goes_on = (quoted(same) == 1) & (quoted(r) == 1)
    sofar_rows = sofar.rowsBetween(W.unboundedPreceding, 0)
    ends = ends.withColumns({n0: F.sum(n).over(sofar_rows), d0: F.sum(quoted(d) - quoted(same)).over(sofar_rows)})
    ends = ends.withColumn(r0, F.last(F.when(~goes_on, quoted(n0) - quoted(n) + quoted(r)), ignorenulls=True).over(sofar_rows))
    named = {k: hidden_name() for k in keys}
    ends = ends.select(quoted(at).alias(to), *[quoted(k).alias(h) for k, h in named.items()], n0, r0, d0, quoted(value).alias(v0))
    match = quoted(BLOCK) == quoted(to)
    for k, h in named.items():
        match &= quoted(k).eqNullSafe(quoted(h))
    rows = rows.join(F.broadcast(ends), match, "left")  # one row for each block
    carried = lambda c: F.coalesce(quoted(c), F.lit(0))
    held = quoted(to).isNotNull() & quoted(v0).eqNullSafe(quoted(start))
    rows = rows.withColumn(joins, F.when(held, 1).otherwise(0))
    kinds = {
        "row_number": carried(n0) + quoted(n),
        "rank": F.when((quoted(joins) == 1) & (quoted(r) == 1), quoted(r0)).otherwise(carried(n0) + quoted(r)),
        "dense_rank": carried(d0) + quoted(d) - quoted(joins),
    }
    return _with(rows, df.columns, {name: kinds[k] for name, k in wanted.items()})
