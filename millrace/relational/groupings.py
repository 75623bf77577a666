"""Grouping sets, cubes and rollups from one scan.

The finest groups are aggregated once, as partial states (counts, sums, squares about a common point), and written.
Every coarser set is made of the states of the smallest finer set that holds its keys, so rows aren't multiplied
by the number of sets, and a key that most rows share is as cheap as any other: states leave each task merged.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.model import quoted
from millrace.relational.cells import named, written
from millrace.session import discard, materialize

#: What can be asked of a column.
KINDS = ("sum", "count", "size", "min", "max", "mean", "var", "std")


def _states(i: int, kind: str, c: Column) -> dict[str, Column]:
    """First partial states of one aggregate."""
    if kind == "size":
        return {f"n{i}": F.count(F.lit(1))}
    if kind in ("min", "max", "sum"):
        return {f"{kind}{i}": {"min": F.min, "max": F.max, "sum": F.sum}[kind](c)}
    out = {f"n{i}": F.count(c)}
    if kind in ("mean", "var", "std"):
        out[f"sum{i}"] = F.sum(c.cast("double"))
    if kind in ("var", "std"):
        out[f"about{i}"] = F.var_pop(c.cast("double")) * F.count(c)
    return out


def _merged(name: str) -> Column:
    """A state of states; squares are brought to one point in ``_coarser``."""
    return {"min": F.min, "max": F.max}.get(name.rstrip("0123456789"), F.sum)(name).alias(name)


def _coarser(fine: DataFrame, keys: Sequence[str], states: Sequence[str], centres: Mapping[str, float]) -> DataFrame:
    """The states of groups by fewer keys."""
    spread = [s.removeprefix("about") for s in states if s.startswith("about")]
    # About the centre c a group's squares are about + n (mean - c)^2; they add up, and so do n (mean - c).
    off = {i: F.when(F.col(f"n{i}") > 0, F.col(f"sum{i}") / F.col(f"n{i}") - centres[i]) for i in spread}
    made = fine.groupBy(*map(quoted, keys)).agg(
        *[_merged(s) for s in states if not s.startswith("about")],
        *[F.sum(F.col(f"about{i}") + F.col(f"n{i}") * d * d).alias(f"about{i}") for i, d in off.items()],
        *[F.sum(F.col(f"n{i}") * d).alias(f"off{i}") for i, d in off.items()],
    )
    for i in spread:
        back = F.col(f"about{i}") - F.when(F.col(f"n{i}") > 0, F.col(f"off{i}") * F.col(f"off{i}") / F.col(f"n{i}")).otherwise(0.0)
        made = made.withColumn(f"about{i}", F.greatest(back, F.lit(0.0))).drop(f"off{i}")
    return made


def _final(i: int, kind: str) -> Column:
    n = F.col(f"n{i}")
    if kind in ("count", "size"):
        return F.coalesce(n, F.lit(0))  # the whole of an empty table
    if kind == "mean":
        return F.when(n > 0, F.col(f"sum{i}") / n)
    if kind in ("var", "std"):
        var = F.when(n > 1, F.col(f"about{i}") / (n - 1))
        return F.sqrt(var) if kind == "std" else var
    return F.col(f"{kind}{i}")


def grouping_sets(
    df: DataFrame, sets: Sequence[Sequence[str]], wanted: Mapping[str, tuple[str, str | None]], grouping_id: str = "grouping_id"
) -> DataFrame:
    """A row for each group of each set: all keys (NULL where a set lacks one), the aggregates, ``grouping_id``.

    ``wanted``: name -> (sum, count, size, min, max, mean, var or std, column; size takes None). ``grouping_id`` has a bit for
    each key, the first key's highest, set where the set lacks the key: it tells a total from a group
    whose key is missing. Equal sets are made once. The empty set gives one row, also of an empty table
    (counts 0, others NULL). Missing values are passed over. Keys and results may have any names that differ.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    named(df, [*keys, *(c for k, c in wanted.values() if k != "size")])
    if unknown := [k for k, _ in wanted.values() if k not in KINDS]:
        raise ValueError(f"unknown aggregates {unknown}; known: {list(KINDS)}")
    if clash := sorted({*wanted, grouping_id} & set(keys)) or ([grouping_id] if grouping_id in wanted else []):
        raise ValueError(f"results named as keys or each other: {clash}")
    sets = list(dict.fromkeys(map(frozenset, sets)))
    df = written(df)
    own = {k: f"k{i}" for i, k in enumerate(keys)}
    asked = [(i, name, kind, c) for i, (name, (kind, c)) in enumerate(wanted.items())]
    first = reduce(lambda a, b: a | b, (_states(i, kind, quoted(c) if c else F.lit(1)) for i, _, kind, c in asked), {})
    held: dict[frozenset, tuple[DataFrame, int]] = {}
    finest = materialize(
        df.groupBy(*[quoted(k).alias(n) for k, n in own.items()]).agg(*[c.alias(n) for n, c in (first or {"n": F.count(F.lit(1))}).items()]), "groups"
    )
    held[frozenset(keys)] = (finest, finest.count())
    spread = [str(i) for i, _, kind, _ in asked if kind in ("var", "std")]
    row = finest.agg(*[F.sum(f"sum{i}") / F.nullif(F.sum(f"n{i}"), F.lit(0)) for i in spread]).first() if spread else []
    centres = {i: float(c or 0.0) for i, c in zip(spread, row, strict=True)}
    for s in sorted(sets, key=len, reverse=True):
        if s in held:
            continue
        fine = min((t for k, t in held.items() if s < k), key=lambda t: t[1])[0]
        made = materialize(_coarser(fine, [own[k] for k in keys if k in s], list(first), centres), "groups")
        held[s] = (made, made.count())
    parts = []
    for s in sets:
        t = held[s][0]
        bits = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        at = [(F.col(own[k]) if k in s else F.lit(None).cast(finest.schema[own[k]].dataType)).alias(k) for k in keys]
        parts.append(t.select(*at, *[_final(i, kind).alias(name) for i, name, kind, _ in asked], F.lit(bits).cast("long").alias(grouping_id)))
    if frozenset(keys) not in sets:
        discard(finest)  # nothing reads it any more
    return reduce(lambda a, b: a.unionAll(b), parts)


def rollup(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, str | None]], grouping_id: str = "grouping_id") -> DataFrame:
    """Groups by all keys, by all but the last, and so on down to the whole table."""
    return grouping_sets(df, [keys[:n] for n in range(len(keys), -1, -1)], wanted, grouping_id)


def cube(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, str | None]], grouping_id: str = "grouping_id") -> DataFrame:
    """Groups by every selection of the keys."""
    return grouping_sets(df, [s for n in range(len(keys), -1, -1) for s in combinations(keys, n)], wanted, grouping_id)
