"""Data cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import OperatorError
from millrace.functions.expressions import NotCompilable, compile_cell
from millrace.functions.fallback import python_column
from millrace.model import Table, TableSet, quoted
from millrace.operators.base import Operator, Param, get_table, need_columns, register, strict
from millrace.operators.ordering import ascending_order, carried, position
from millrace.operators.quantiles import most_frequent, quantiles


def numeric(table: Table, column: str) -> Column:
    """The column as numbers; text that doesn't parse is NULL."""
    t = table.type_of(column)
    if isinstance(t, T.NumericType):
        return quoted(column)
    c = F.trim(quoted(column).cast("string"))
    plain = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return F.when(c.rlike(plain), c.try_cast("double"))


def one_row(table: Table, *aggregates: Column):
    """Statistics of the whole table as a single row on the driver."""
    return table.df.agg(*aggregates).head()


def with_column(table: Table, name: str, value: Column) -> Table:
    if name in table.columns:
        return table.select(*[value.alias(name) if c == name else quoted(c) for c in table.columns])
    return table.select(*map(quoted, table.columns), value.alias(name))


@register
class DropNA(Operator):
    """Drop rows with a missing value in any (how='any') or all (how='all') of the columns of subset (default: all columns)."""

    NAME, CATEGORY = "DropNA", "data cleaning"
    PARAMS = (Param("table"), Param("subset", None, many=True), Param("how", "any", choices=("any", "all")))

    def apply(self, tables: TableSet, /, table, subset=None, how="any") -> TableSet:
        t = get_table(tables, table)
        subset = subset or t.columns
        need_columns(t, subset)
        return tables.replace(t.with_df(t.df.na.drop(how, subset=[f"`{c}`" for c in subset])))


@register
class MissingValueImputation(Operator):
    """Fill the missing cells of a column by its mean, median or mode, by the value before (ffill) or behind (bfill), by zero or a constant value."""

    NAME, CATEGORY = "MissingValueImputation", "data cleaning"
    PARAMS = (
        Param("table"), Param("column"),
        Param("mode", "mean", choices=("mean", "median", "mode", "ffill", "bfill", "zero", "constant")), Param("value", None),
    )

    def apply(self, tables: TableSet, /, table, column, mode="mean", value=None) -> TableSet:
        t = get_table(tables, table)
        need_columns(t, [column])
        c, kind = quoted(column), t.type_of(column)
        if mode in ("ffill", "bfill"):
            t = t.positioned()
            return tables.replace(t.with_df(carried(t, column, backwards=mode == "bfill")))
        if mode == "mode":
            fill = most_frequent(t.df, c)
            if fill is None and strict():
                raise OperatorError(f"column {column!r} is entirely missing")
        elif mode in ("mean", "median"):
            x = numeric(t, column)
            fill = one_row(t, F.avg(x))[0] if mode == "mean" else (quantiles(t.df, x, [0.5]) or [None])[0]
            if fill is None and strict():
                raise OperatorError(f"column {column!r} has no numeric values")
        else:
            fill = 0 if mode == "zero" else value
            if fill is None:
                raise OperatorError("mode 'constant' needs a value")
        lit = F.lit(fill)
        if isinstance(fill, float) and not fill.is_integer() and isinstance(kind, T.IntegralType) or mode in ("mean", "median") and isinstance(kind, T.IntegralType):
            filled = F.coalesce(c.cast("double"), lit.cast("double"))
        elif isinstance(kind, T.NumericType) and isinstance(fill, str):
            filled = F.coalesce(c.cast("string"), lit)
        else:
            filled = F.coalesce(c, lit.cast(kind))
        return tables.replace(with_column(t, column, filled))


@register
class Deduplicate(Operator):
    """Keep the first or last row, in row order, of those equal in subset (default: all columns)."""

    NAME, CATEGORY = "Deduplicate", "data cleaning"
    PARAMS = (Param("table"), Param("subset", None, many=True), Param("keep", "first", choices=("first", "last")))

    def apply(self, tables: TableSet, /, table, subset=None, keep="first") -> TableSet:
        t = get_table(tables, table).positioned()
        subset = subset or t.columns
        need_columns(t, subset)
        # One aggregate with map-side combine: hot keys never meet in one task unreduced.
        t = ascending_order(t)
        rest = [c for c in t.df.columns if c not in subset]
        pick = F.min_by if keep == "first" else F.max_by
        row = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(rest)])
        got = t.df.groupBy(*map(quoted, subset)).agg(pick(row, position(t)).alias("__row"))
        place = {c: i for i, c in enumerate(rest)}
        return tables.replace(t.with_df(got.select(*[quoted(c) if c in subset else F.col("__row")[f"c{place[c]}"].alias(c) for c in t.df.columns])))


@register
class ErrorDetection(Operator):
    """Flag (column <column>_is_error), remove or null the cells for which func(value) is true."""

    NAME, CATEGORY = "ErrorDetection", "data cleaning"
    PARAMS = (Param("table"), Param("column"), Param("func"), Param("action", "flag", choices=("flag", "remove", "null")))

    def apply(self, tables: TableSet, /, table, column, func, action="flag") -> TableSet:
        t = get_table(tables, table)
        need_columns(t, [column])
        try:
            wrong = compile_cell(func, quoted(column), t.type_of(column), predicate=True).col
        except NotCompilable:
            wrong = F.coalesce(python_column(t.df, func, [column], "cell", T.BooleanType()), F.lit(False))
        if action == "flag":
            return tables.replace(with_column(t, f"{column}_is_error", wrong))
        if action == "remove":
            return tables.replace(t.with_df(t.df.where(~wrong)))
        return tables.replace(with_column(t, column, F.when(~wrong, quoted(column))))


@register
class OutlierDetection(Operator):
    """Remove, flag (<column>_is_outlier) or clip values beyond iqr fences (threshold 1.5) or zscore bounds (3.0)."""

    NAME, CATEGORY = "OutlierDetection", "data cleaning"
    PARAMS = (
        Param("table"), Param("column"), Param("action", "remove", choices=("remove", "flag", "clip")),
        Param("method", "iqr", choices=("iqr", "zscore")), Param("threshold", None),
    )

    def apply(self, tables: TableSet, /, table, column, action="remove", method="iqr", threshold=None) -> TableSet:
        t = get_table(tables, table)
        need_columns(t, [column])
        x = numeric(t, column).cast("double")
        if method == "iqr":
            k = 1.5 if threshold is None else float(threshold)
            q = quantiles(t.df, x, [0.25, 0.75])
            low, high = (q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])) if q else (None, None)
        else:
            k = 3.0 if threshold is None else float(threshold)
            mean, sd = one_row(t, F.avg(x), F.stddev_pop(x))
            low, high = (mean - k * (sd or 0), mean + k * (sd or 0)) if mean is not None else (None, None)
        if low is None:
            if strict():
                raise OperatorError(f"column {column!r} has no numeric values")
            low, high = float("-inf"), float("inf")
        out = F.coalesce((x < low) | (x > high), F.lit(False))
        if action == "flag":
            return tables.replace(with_column(t, f"{column}_is_outlier", out))
        if action == "remove":
            return tables.replace(t.with_df(t.df.where(~out)))
        clipped = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))
        return tables.replace(with_column(t, column, clipped))
