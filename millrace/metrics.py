"""Comparison of tables regardless of row order, partial similarity and costs."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.model import Table, quoted
from millrace.operators.ordering import numbered


@dataclass(frozen=True)
class MatchOptions:
    """``tolerance``: the grid of numbers; ``names``: whether columns must bear the same names."""

    tolerance: float = 1e-6
    names: bool = True


#: Text that is a number: no leading zeros, no separators.
_NUMBER = r"^[+-]?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def normal(c: Column, kind: T.DataType, tolerance: float = 1e-6) -> Column:
    """A cell as text in which equal values are equal: numbers on a grid, numeric text as numbers."""

    def grid(x: Column) -> Column:
        x = x.cast("double")
        whole = F.when(F.abs(x) < 1e12, F.round(x / tolerance).cast("bigint").cast("string")).otherwise(x.cast("string"))
        return (
            F.when(F.isnan(x), F.lit(None).cast("string"))
            .when(x == float("inf"), "n:inf").when(x == float("-inf"), "n:-inf").otherwise(F.concat(F.lit("n:"), whole))
        )

    if isinstance(kind, T.BooleanType):
        return F.concat(F.lit("b:"), c.cast("string"))
    if isinstance(kind, T.NumericType):
        return grid(c)
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("l:"), F.to_json(F.transform(c, lambda x: F.coalesce(normal(x, kind.elementType, tolerance), F.lit("")))))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.concat(F.lit("s:"), F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss"))
    s = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    return F.when(s.rlike(_NUMBER), grid(s.try_cast("double"))).otherwise(F.concat(F.lit("s:"), s))


def _rows(df: DataFrame, columns: list[str], options: MatchOptions) -> DataFrame:
    """Distinct normalized rows (as c0, c1, ...) with their counts."""
    cells = [normal(quoted(c), df.schema[c].dataType, options.tolerance).alias(f"c{i}") for i, c in enumerate(columns)]
    shown = df.select(*cells)
    return shown.groupBy(*shown.columns).agg(F.count(F.lit(1)).alias("n"))


def _frame(t: Table | DataFrame) -> DataFrame:
    return t.visible if isinstance(t, Table) else t


def table_match(pred: Table | DataFrame, gold: Table | DataFrame, options: MatchOptions | None = None) -> bool:
    """Whether both have the same columns and the same multiset of rows."""
    options = options or MatchOptions()
    a, b = _frame(pred), _frame(gold)
    if len(a.columns) != len(b.columns) or len(set(a.columns)) != len(a.columns):
        return False
    if not b.columns:
        return a.count() == b.count()
    if set(a.columns) == set(b.columns):
        return _same_rows(a, b, [(c, c) for c in b.columns], options)
    return not options.names and _bijection(a, b, options) is not None


def _same_rows(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]], options: MatchOptions) -> bool:
    x = _rows(a, [p for p, _ in pairs], options)
    y = _rows(b, [g for _, g in pairs], options)
    cells = [c for c in x.columns if c != "n"]
    both = x.select(*cells, F.col("n").alias("d")).union(y.select(*cells, (-F.col("n")).alias("d")))
    return both.groupBy(*cells).agg(F.sum("d").alias("d")).where("d <> 0").isEmpty()


#: Pairs of columns of which one job makes the digests.
_AT_ONCE = 64


def _digests(df: DataFrame, pairs: list[tuple[str, str]], options: MatchOptions) -> dict[tuple[str, str], tuple]:
    """Of each pair of columns the multiset of its pairs of values, as numbers, and whether both are equal in every row."""
    h = {c: F.xxhash64(normal(quoted(c), df.schema[c].dataType, options.tolerance)) for c in df.columns}
    out = {}
    for i in range(0, len(pairs), _AT_ONCE):
        some = pairs[i : i + _AT_ONCE]
        x = {p: F.xxhash64(h[p[0]], h[p[1]]) for p in some}
        sums = [F.struct(F.count(x[p]), F.bit_xor(x[p]), F.sum(F.pmod(x[p], F.lit(1 << 31))), F.bool_and(h[p[0]] == h[p[1]])) for p in some]
        row = df.agg(*[c.alias(str(k)) for k, c in enumerate(sums)]).head()
        out |= {p: tuple(row[k]) for k, p in enumerate(some)}
    return out


def _bijection(a: DataFrame, b: DataFrame, options: MatchOptions, steps: int = 200_000) -> list[tuple[str, str]] | None:
    """Columns paired so that both have the same rows, by a search of at most ``steps`` steps, or None.

    Columns are paired within equal multisets of values, and so that any two of them have equal multisets of
    pairs of values; the rows of a whole pairing are compared. Of equal columns one is tried.
    """
    alone = lambda df: {c: d for (c, _), d in _digests(df, [(c, c) for c in df.columns], options).items()}
    left, right = alone(a), alone(b)
    if sorted(map(str, left.values())) != sorted(map(str, right.values())):
        return None
    same = {g: sorted((p for p in left if left[p] == d), key=lambda p: p != g) for g, d in right.items()}
    order = sorted(same, key=lambda g: len(same[g]))
    # Columns that may be paired in one way only need no digests among each other.
    open_left, open_right = ({c for c in df if sum(d == df[c] for d in df.values()) > 1} for df in (left, right))
    several = lambda df, some: [(x, y) for x in df for y in df if x != y and (x in some or y in some)]
    of_left, of_right = _digests(a, several(left, open_left), options), _digests(b, several(right, open_right), options)
    chosen: dict[str, str] = {}
    left_steps = steps

    def fits(p: str, g: str) -> bool:
        return all(of_left.get((q, p)) == of_right.get((h, g)) for h, q in chosen.items())

    def search(k: int) -> bool:
        nonlocal left_steps
        left_steps -= 1
        if left_steps < 0:
            return False
        if k == len(order):
            return _same_rows(a, b, [(chosen[g], g) for g in right], options)
        tried: list[str] = []
        for p in same[order[k]]:
            if p in chosen.values() or any(of_left[q, p][3] for q in tried) or not fits(p, order[k]):
                continue
            tried.append(p)
            chosen[order[k]] = p
            if search(k + 1):
                return True
            del chosen[order[k]]
        return False

    return [(chosen[g], g) for g in right] if search(0) else None


def partial_similarity(pred: Table | DataFrame, gold: Table | DataFrame, options: MatchOptions | None = None) -> float:
    """Mean of the columns' Jaccard similarity, exp(-|difference of row counts| / rows), and equal cells by sorted position."""
    options = options or MatchOptions()
    a, b = _frame(pred), _frame(gold)
    every = set(a.columns) | set(b.columns)
    shared = [c for c in b.columns if c in a.columns]
    columns = len(shared) / len(every) if every else 1.0
    n, m = a.count(), b.count()
    shape = math.exp(-abs(n - m) / max(1, m))
    if not shared or not max(n, m):
        content = 1.0 if not max(n, m) and shared else 0.0
    else:
        cells = lambda df: df.select(*[normal(quoted(c), df.schema[c].dataType, options.tolerance).alias(f"c{i}") for i, c in enumerate(shared)])
        ordered = lambda df: Table("cells", df, "", tuple((c, True) for c in df.columns))
        ranked = lambda df, s: numbered(ordered(df), "at").select("at", *[F.col(c).alias(f"{c}{s}") for c in df.columns])
        x, y = ranked(cells(a), "p"), ranked(cells(b), "g")
        equal = sum(F.col(f"c{i}p").eqNullSafe(F.col(f"c{i}g")).cast("int") for i in range(len(shared)))
        same = x.join(y, "at").agg(F.sum(equal)).head()[0] or 0
        content = same / (max(n, m) * len(shared))
    return (columns + shape + content) / 3


#: Fixed value: dollars an hour of a GPU.
GPU_PRICE = 0.91


def gpu_cost(seconds: float, price: float = GPU_PRICE) -> float:
    return price * seconds / 3600


@dataclass(frozen=True)
class Price:
    """Dollars for a million tokens; without ``cached`` cached ones cost what fresh ones do."""

    prompt: float
    completion: float
    cached: float | None = None


#: List prices by model.
PRICES = {
    "gpt-5-mini-2025-08-07": Price(0.25, 2.00, 0.025),
    "gpt-5-mini": Price(0.25, 2.00, 0.025),
    "gpt-5": Price(1.25, 10.00, 0.125),
    "claude-sonnet-4-20250514": Price(3.00, 15.00, 0.30),
    "claude-sonnet-4-5": Price(3.00, 15.00, 0.30),
    "gpt-4o": Price(2.50, 10.00, 1.25),
    "gpt-4o-mini": Price(0.15, 0.60, 0.075),
    "deepseek-chat": Price(0.27, 1.10, 0.07),
    "deepseek-reasoner": Price(0.55, 2.19, 0.14),
}


def api_cost(prompt: int, completion: int, price: Price | str | None, cached: int = 0) -> float:
    """Dollars of a run by a price or a model's name; models without a price cost nothing."""
    price = PRICES.get(price) if isinstance(price, str) else price
    if price is None:
        return 0.0
    cached = min(cached, prompt)
    of_cached = price.prompt if price.cached is None else price.cached
    return ((prompt - cached) * price.prompt + cached * of_cached + completion * price.completion) / 1e6
