"""As-of joins: each row with the nearest row of another table in time, key by key.

Both tables are merged in the order of key and time along written blocks; the last row of the other table
is a running aggregate, so a key that holds most of the rows is spread over many blocks and its last row
is carried over their ends.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.model import hidden_name, quoted
from millrace.operators.combination import suffixed
from millrace.relational.cells import named, written
from millrace.relational.windows import running


def as_of_join(
    left: DataFrame, right: DataFrame, left_time: str, right_time: str, on: Sequence[tuple[str, str]] = (), direction: str = "backward",
    tolerance=None, exact: bool = True, how: str = "left", ties: Sequence[str] = (), blocks: int | None = None,
) -> DataFrame:
    """``left`` with the columns of its last ``right`` row at or before its time (backward), its first at or
    after it (forward), or the closer of both (nearest; backward where equally close).

    ``on`` are pairs of key columns; missing keys and times match nothing. ``tolerance`` (a number, or text like
    '2 hours' between timestamps) bounds the distance, both ends included; without ``exact`` equal times don't
    match. Of ``right`` rows that tie in key and time the one highest in ``ties`` is taken (missing values lowest),
    else any. ``how``: left keeps rows without a match, with NULLs; inner drops them. Clashing columns of the
    right table get _right. Repeated left rows all stay; an empty right table matches nothing.
    """
    if direction not in ("backward", "forward", "nearest") or how not in ("left", "inner"):
        raise ValueError(f"unknown direction {direction!r} or how {how!r}")
    named(left, [left_time, *(a for a, _ in on)])
    named(right, [right_time, *(b for _, b in on), *ties])
    left, right = written(left), written(right)
    time, side, mine, other, *keys = (hidden_name() for _ in range(4 + len(on)))
    rank = [hidden_name() for _ in ties]
    known = lambda names: reduce(lambda a, b: a & b, [quoted(n).isNotNull() for n in names])
    lefts = left.select(
        *[quoted(a).alias(k) for (a, _), k in zip(on, keys, strict=True)], quoted(left_time).alias(time),
        F.struct(*map(quoted, left.columns)).alias(mine),
    )
    rights = right.where(known([right_time, *(b for _, b in on)])).select(
        *[quoted(b).alias(k) for (_, b), k in zip(on, keys, strict=True)], quoted(right_time).alias(time),
        *[quoted(c).alias(r) for c, r in zip(ties, rank, strict=True)], F.struct(*map(quoted, right.columns)).alias(other),
    )
    if ties:  # one row a time, made before the merge: partial results leave each task
        best = F.max_by(quoted(other), F.struct(*map(quoted, rank))).alias(other)
        rights = rights.groupBy(*map(quoted, keys), quoted(time)).agg(best)
    both = lefts.unionByName(rights, allowMissingColumns=True)
    found = {d: hidden_name() for d in (("backward", "forward") if direction == "nearest" else (direction,))}
    for d, name in found.items():
        # Looking back, right rows come before left ones of their time if equal times match, else behind.
        first = (quoted(mine).isNotNull() if exact else quoted(mine).isNull()) if d == "backward" else (quoted(mine).isNull() if exact else quoted(mine).isNotNull())
        both = running(both.withColumn(side, first), keys, [time, side], {name: ("last", quoted(other))}, d == "forward", blocks)
    both = both.where(quoted(mine).isNotNull())
    at = quoted(time)
    usable = at.isNotNull()
    for k in keys:
        usable &= quoted(k).isNotNull()
    matched = {}
    for d, name in found.items():
        then = quoted(name)[right_time]
        near = F.lit(True)
        if tolerance is not None:
            reach = F.expr(f"interval {tolerance}") if isinstance(tolerance, str) else F.lit(tolerance)
            near = (then + reach >= at) if d == "backward" else (then <= at + reach)
        matched[d] = F.when(usable & near, quoted(name))
    if direction == "nearest":
        back, ahead = matched["backward"], matched["forward"]
        closer = ahead[right_time] - at < at - back[right_time]
        pick = F.when(back.isNull() | closer, F.coalesce(ahead, back)).otherwise(back)
    else:
        pick = matched[direction]
    both = both.withColumn(other, pick)
    if how == "inner":
        both = both.where(quoted(other).isNotNull())
    names = suffixed(list(right.columns), set(left.columns))
    return both.select(
        *[quoted(mine)[c].alias(c) for c in left.columns], *[quoted(other)[c].alias(names.get(c, c)) for c in right.columns]
    )

