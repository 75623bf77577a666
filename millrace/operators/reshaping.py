"""Table reshaping."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import OperatorError
from millrace.functions.expressions import strip_text
from millrace.model import Table, TableSet, hidden_name, quoted
from millrace.operators.aggregation import ALIASES, grouped
from millrace.operators.base import Operator, Param, get_table, need_columns, register, strict
from millrace.operators.ordering import ascending_order, numbered


@register
class Pivot(Operator):
    """Spread the labels of columns into columns, one row for each index, cells aggregated by aggfunc. Rows with a missing index or label are left out."""

    NAME, CATEGORY = "Pivot", "table reshaping"
    #: Labels that may become columns, and levels of the index that dropna=False may add.
    LIMIT, GRID = 10_000, 10_000_000
    PARAMS = (
        Param("table"), Param("index", many=True), Param("columns", many=True), Param("values", many=True),
        Param("aggfunc", "first"), Param("dropna", True), Param("limit", LIMIT),
    )

    def apply(self, tables: TableSet, /, table, index, columns, values, aggfunc="first", dropna=True, limit=LIMIT) -> TableSet:
        t = get_table(tables, table)
        need_columns(t, [*index, *columns, *values])
        fn = ALIASES.get(str(aggfunc).lower(), str(aggfunc).lower())
        if fn not in ("mean", "sum", "count", "size", "min", "max", "median", "std", "var", "first", "last", "nunique"):
            raise OperatorError(f"aggfunc {aggfunc!r} is not known")
        t = ascending_order(t) if fn in ("first", "last") else t
        full = t.with_df(t.df.na.drop("any", subset=[f"`{c}`" for c in [*index, *columns]]))
        found = full.df.select(*map(quoted, columns)).distinct().orderBy(*map(quoted, columns)).limit(limit + 1).collect()
        if len(found) > limit:
            raise OperatorError(f"StateTooLarge: over {limit} labels in {columns}")
        # Aggregated first, so that absent combinations stay missing and all-missing groups keep their sum of 0.
        cells = grouped(full, [*index, *columns], [(v, fn, f"__v{i}") for i, v in enumerate(values)])
        out, names = [], []
        for i, v in enumerate(values):
            for row in found:
                text = "_".join(str(x) for x in row)
                here = F.lit(True)
                for c, x in zip(columns, row, strict=True):
                    here = here & (quoted(c) == F.lit(x))
                name = text if len(values) == 1 else f"{v}_{text}"
                names.append(name)
                out.append(F.max(F.when(here, quoted(f"__v{i}"))).alias(name))
        keys = [hidden_name() for _ in index]
        df = cells.groupBy(*map(quoted, index)).agg(*(out or [F.count(F.lit(1)).alias("__none")]))
        if not out:
            df = df.drop("__none")
        if dropna and names:
            df = df.na.drop("all", subset=[f"`{n}`" for n in names])
            if strict():
                some = df.agg(*[F.count(quoted(n)).alias(n) for n in names]).head()
                names = [n for n in names if some[n]]
        elif not dropna and len(index) > 1:
            levels = [full.df.select(quoted(c)).distinct() for c in index]
            if math.prod(x.count() for x in levels) > self.GRID:
                raise OperatorError(f"StateTooLarge: the levels of {index} have over {self.GRID} combinations")
            df = reduce(lambda a, b: a.crossJoin(b), levels).join(df, index, "left")
        df = df.select(*map(quoted, [*index, *names]), *[quoted(c).alias(k) for c, k in zip(index, keys, strict=True)])
        return tables.replace(t.with_df(df, [(k, True) for k in keys]))


@register
class Stack(Operator):
    """Turn columns into rows: id_vars stay, each other column (or value_vars) gives rows of its name and value."""

    NAME, CATEGORY = "Stack", "table reshaping"
    PARAMS = (
        Param("table"), Param("id_vars", many=True), Param("value_vars", None, many=True), Param("var_name", "variable"),
        Param("value_name", "value"),
    )

    def apply(self, tables: TableSet, /, table, id_vars, value_vars=None, var_name="variable", value_name="value") -> TableSet:
        t = get_table(tables, table).positioned()
        id_vars = id_vars or []
        if isinstance(t, Transposed) and t.cells is not None and id_vars == ["column"] and value_vars is None and "column" not in (var_name, value_name):
            return tables.replace(t.stacked(var_name, value_name))
        rest = [c for c in t.columns if c not in id_vars] if value_vars is None else value_vars
        need_columns(t, [*id_vars, *rest])
        if value_name in t.columns and value_name not in rest:
            raise OperatorError(f"value_name {value_name!r} is a column already")
        if not rest:
            raise OperatorError("no columns are left to stack")
        common = common_type([t.type_of(c) for c in rest])
        at = hidden_name()
        rows = F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), F.lit(c).alias("n"), quoted(c).cast(common).alias("v")) for i, c in enumerate(rest)
        ])).alias("__r")
        df = t.df.select(*map(quoted, id_vars), *t.hidden, rows)
        df = df.select(*map(quoted, id_vars), F.col("__r.n").alias(var_name), F.col("__r.v").alias(value_name), F.col("__r.i").alias(at), *t.hidden)
        return tables.replace(t.with_df(df, ((at, True), *t.order)))


def common_type(types: list[T.DataType]) -> T.DataType:
    """A type that holds all: the same, a wider number, else text."""
    if len(set(types)) == 1:
        return types[0]
    if all(isinstance(x, T.IntegralType) for x in types):
        return T.LongType()
    return T.DoubleType() if all(isinstance(x, T.NumericType) for x in types) else T.StringType()


@register
class WideToLong(Operator):
    """Turn columns named stub + sep + suffix into rows, one for each suffix, with a column for each stub; i identifies rows, j names the suffix."""

    NAME, CATEGORY = "WideToLong", "table reshaping"
    PARAMS = (
        Param("table"), Param("stubnames", many=True), Param("i", many=True), Param("j"), Param("sep", ""), Param("suffix", r"\w+"),
    )

    def apply(self, tables: TableSet, /, table, stubnames, i, j, sep="", suffix=r"\w+") -> TableSet:
        t = get_table(tables, table).positioned()
        need_columns(t, i)
        cells: dict[str, dict[str, str]] = {}
        for stub in stubnames:
            for c in t.columns:
                if c not in i and (m := re.fullmatch(f"{re.escape(stub)}{re.escape(sep)}({suffix})", c)):
                    cells.setdefault(m[1], {})[stub] = c
        if not cells:
            raise OperatorError(f"no column is named by a stub of {stubnames}")
        if strict() and not t.df.groupBy(*map(quoted, i)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            raise OperatorError(f"{i} doesn't identify rows")
        used = {c for by in cells.values() for c in by.values()}
        rest = [c for c in t.columns if c not in used and c not in i]
        whole = all(re.fullmatch(r"[+-]?\d+", s) for s in cells)
        number = all(re.fullmatch(r"[+-]?\d+(\.\d+)?", s) for s in cells)
        key = (lambda s: int(s)) if whole else (lambda s: float(s)) if number else (lambda s: s)
        types = {s: common_type([t.type_of(by[s]) for by in cells.values() if s in by] or [T.DoubleType()]) for s in stubnames}
        rows = [
            F.struct(F.lit(key(suffix)).alias("j"), F.lit(n).alias("n"),
                     *[(quoted(by[s]) if s in by else F.lit(None)).cast(types[s]).alias(f"s{k}") for k, s in enumerate(stubnames)])
            for n, (suffix, by) in enumerate(sorted(cells.items(), key=lambda x: key(x[0])))
        ]
        at = hidden_name()
        df = t.df.select(*map(quoted, [*i, *rest]), *t.hidden, F.explode(F.array(*rows)).alias("__r"))
        df = df.select(
            *map(quoted, i), F.col("__r.j").alias(j), *map(quoted, rest),
            *[F.col(f"__r.s{k}").alias(s) for k, s in enumerate(stubnames)], F.col("__r.n").alias(at), *t.hidden,
        )
        return tables.replace(t.with_df(df, ((at, True), *t.order)))


class Transposed(Table):
    """A transposed table: its cells one a row, from which columns are put together only when something asks for them.

    ``cells`` has the old column's number ``at`` and name ``column``, the row's number ``place`` from 1, its name
    ``named`` and the value; None where a row's name as a column isn't known without the others'.
    """

    def __init__(self, name: str, description: str, at: str, place: str, named: str, value: str, cells: DataFrame | None, wide: Callable[[], DataFrame]):
        for k, v in {"name": name, "description": description, "order": ((at, True),), "at": at, "place": place, "named": named, "value": value, "cells": cells, "wide": wide}.items():
            object.__setattr__(self, k, v)

    @cached_property
    def df(self) -> DataFrame:
        return self.wide()

    def renamed(self, name: str) -> Table:
        return Transposed(name, self.description, self.at, self.place, self.named, self.value, self.cells, self.wide)

    def stacked(self, var_name: str, value_name: str) -> Table:
        """What Stack makes of all columns but ``column``, for any number of them."""
        if self.cells.isEmpty():
            raise OperatorError("no columns are left to stack")
        df = self.cells.select("column", quoted(self.named).alias(var_name), quoted(self.value).alias(value_name), quoted(self.place), quoted(self.at))
        return Table(self.name, df, self.description, ((self.place, True), (self.at, True)))


@register
class Transpose(Operator):
    """Swap rows and columns; the first column, named column, holds the old names, the others are numbered or named by the header column."""

    NAME, CATEGORY = "Transpose", "table reshaping"
    #: Rows that may become columns of a DataFrame, unless ``limit`` is given; so many of them are put together at once.
    LIMIT, CHUNK = 5_000, 1_000
    PARAMS = (Param("table"), Param("header", None), Param("limit", None))

    def apply(self, tables: TableSet, /, table, header=None, limit=None) -> TableSet:
        t = get_table(tables, table).positioned()
        if header is not None:
            need_columns(t, [header])
        number = hidden_name()
        rows = numbered(t, number)
        body = [c for c in t.columns if c != header]
        kind = common_type([t.type_of(c) for c in body] or [T.StringType()])
        at, place, named, value = (hidden_name() for _ in range(4))
        cells = None
        if body:
            cell = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("n"), _cell(t, c, kind).alias("v")) for i, c in enumerate(body)]))
            name = (quoted(number) - 1).cast("string") if header is None else _header(t, header)
            cells = rows.select(quoted(number).alias(place), name.alias(named), cell.alias("cell")).select(
                place, named, F.col("cell.i").alias(at), F.col("cell.n").alias("column"), F.col("cell.v").alias(value)
            )
        most = self.LIMIT if limit is None else limit

        def wide() -> DataFrame:
            # Names are a part of the schema: the count of rows, or the header's values, and nothing else reach the driver.
            n = rows.limit(most + 1).count()
            if n > most:
                raise OperatorError(f"StateTooLarge: over {most} rows can't become columns")
            names = [str(i) for i in range(n)]
            if header is not None:
                names = [str(r[0]) for r in rows.select(quoted(header), quoted(number)).orderBy(number).collect()]
            made = unique_names(["column", at, *names])[2:]
            if cells is None:
                fields = [T.StructField("column", T.StringType()), T.StructField(at, T.IntegerType()), *[T.StructField(m, kind) for m in made]]
                return rows.sparkSession.createDataFrame([], T.StructType(fields))
            return self._columns(cells, body, at, place, value, made)

        plain = header is None or cells is not None and isinstance(t.type_of(header), (T.StringType, T.IntegralType)) and _different(rows, _header(t, header), [at])
        made = Transposed(t.name, t.description, at, place, named, value, cells if plain else None, wide)
        if limit is not None or cells is None:
            made.df  # noqa: B018 - a limit that is given is kept at once
        return tables.replace(made)

    def _columns(self, cells: DataFrame, body: list[str], at: str, place: str, value: str, made: list[str]) -> DataFrame:
        """Cells put together in rows, in chunks of columns."""
        chunk = hidden_name()
        of_chunk = F.array_sort(F.collect_list(F.struct(place, value)))
        df = (
            cells.select(F.floor((quoted(place) - 1) / self.CHUNK).alias(chunk), place, at, "column", value)
            .groupBy(at, "column", chunk).agg(F.transform(of_chunk, lambda x: x[value]).alias(value))
        )
        parts = [hidden_name() for _ in range(0, len(made), self.CHUNK)]
        df = df.groupBy(at, "column").agg(*[F.first(F.when(quoted(chunk) == i, quoted(value)), ignorenulls=True).alias(p) for i, p in enumerate(parts)]) if parts else (
            cells.sparkSession.createDataFrame(list(enumerate(body)), f"{at} int, column string")
        )
        return df.select("column", at, *[F.get(parts[i // self.CHUNK], F.lit(i % self.CHUNK)).alias(m) for i, m in enumerate(made)])


def _header(t: Table, column: str) -> Column:
    """A header's value as a column's name; a missing one is None."""
    return F.coalesce(quoted(column).cast("string"), F.lit("None"))


def _different(rows: DataFrame, name: Column, taken: list[str]) -> bool:
    """Whether each row's name is its column's name as it is: none repeated, none that the table has already."""
    found = rows.select(name.alias("n")).groupBy("n").count()
    return found.where((F.col("count") > 1) | F.col("n").isin("column", *taken)).isEmpty()


def _cell(t: Table, column: str, kind: T.DataType) -> Column:
    """A value as a cell of ``kind``; truth values as text begin with a capital."""
    c = quoted(column)
    if isinstance(kind, T.StringType) and isinstance(t.type_of(column), T.BooleanType):
        return F.initcap(c.cast("string"))
    return c.cast(kind)


def unique_names(names: list[str]) -> list[str]:
    """``a, a`` as ``a, a_2``."""
    out: dict[str, None] = {}
    last: dict[str, int] = {}
    for n in names:
        own, k = n, last.get(n, 1)
        while own in out:
            k += 1
            own = f"{n}_{k}"
        out[own], last[n] = None, k
    return list(out)


@register
class Explode(Operator):
    """One row for each item of a list column, or of a text split by sep; items are stripped unless strip=False."""

    NAME, CATEGORY = "Explode", "table reshaping"
    PARAMS = (Param("table"), Param("column"), Param("sep", None), Param("strip", True))

    def apply(self, tables: TableSet, /, table, column, sep=None, strip=True) -> TableSet:
        t = get_table(tables, table).positioned()
        need_columns(t, [column])
        c, kind = quoted(column), t.type_of(column)
        if isinstance(kind, T.ArrayType):
            items = F.transform(c, lambda x: strip_text(x)) if strip and isinstance(kind.elementType, T.StringType) else c
        elif sep is not None:
            items = F.split(c.cast("string"), re.escape(str(sep)), -1)
            items = F.transform(items, lambda x: strip_text(x)) if strip else items
        else:
            return tables.replace(t)
        at = hidden_name()
        df = t.df.select(*[quoted(n) for n in t.columns if n != column], *t.hidden, F.posexplode_outer(items).alias(at, "__v"))
        df = df.select(*[F.col("__v").alias(n) if n == column else quoted(n) for n in t.columns], *t.hidden, quoted(at))
        return tables.replace(t.with_df(df, (*t.order, (at, True))))
