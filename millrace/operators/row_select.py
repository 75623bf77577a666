"""Row selection."""

from __future__ import annotations

from pyspark.sql import types as T

from millrace.errors import OperatorError
from millrace.functions.expressions import NotCompilable, compile_row
from millrace.functions.fallback import python_column
from millrace.model import Table, TableSet, hidden_name, quoted
from millrace.operators.base import Operator, Param, get_table, need_columns, register
from millrace.operators.schema_edit import types_of

_WORDS = {"asc": True, "ascending": True, "true": True, "desc": False, "descending": False, "false": False}


def directions(ascending, n: int) -> list[bool]:
    given = list(ascending) if isinstance(ascending, (list, tuple)) else [ascending] * n
    if len(given) != n:
        raise OperatorError(f"ascending has {len(given)} values for {n} columns")
    out = []
    for a in given:
        if isinstance(a, str):
            if a.lower() not in _WORDS:
                raise OperatorError(f"ascending must be true or false, not {a!r}")
            a = _WORDS[a.lower()]
        out.append(bool(a))
    return out


def sorted_table(t: Table, by: list[str], ascending) -> Table:
    """The table with a new order: stable, missing values last either way. Nothing is sorted yet."""
    ups = directions(ascending, len(by))
    t = t.positioned()
    names = [hidden_name() for _ in by]
    df = t.df.select("*", *[quoted(c).alias(n) for c, n in zip(by, names, strict=True)])
    return t.with_df(df, (*zip(names, ups, strict=True), *t.order))


@register
class Filter(Operator):
    """Keep the rows for which func(row) is true."""

    NAME, CATEGORY = "Filter", "row selection"
    PARAMS = (Param("table"), Param("func"))

    def apply(self, tables: TableSet, /, table, func) -> TableSet:
        t = get_table(tables, table)
        try:
            keep = compile_row(func, types_of(t), predicate=True)
        except NotCompilable:
            keep = python_column(t.df, func, t.columns, "row", T.BooleanType())
        except KeyError as e:
            need_columns(t, [e.args[0]])
            raise
        return tables.replace(t.with_df(t.df.where(keep)))


@register
class Sort(Operator):
    """Sort by columns, stably; missing values come last in both directions."""

    NAME, CATEGORY = "Sort", "row selection"
    PARAMS = (Param("table"), Param("by", many=True), Param("ascending", True))

    def apply(self, tables: TableSet, /, table, by, ascending=True) -> TableSet:
        t = get_table(tables, table)
        need_columns(t, by)
        return tables.replace(sorted_table(t, by, ascending))


@register
class TopK(Operator):
    """The first k rows, after sorting by columns (descending by default) if by is given."""

    NAME, CATEGORY = "TopK", "row selection"
    PARAMS = (Param("table"), Param("k"), Param("by", None, many=True), Param("ascending", False))

    def apply(self, tables: TableSet, /, table, k, by=None, ascending=False) -> TableSet:
        t = get_table(tables, table)
        if isinstance(k, bool) or not isinstance(k, (int, str)) or not str(k).isdigit():
            raise OperatorError(f"k must be an integer of 0 or more, not {k!r}")
        if by:
            need_columns(t, by)
            t = sorted_table(t, by, ascending)
        t = t.positioned()
        return tables.replace(t.with_df(t.df.orderBy(*t.sort_keys()).limit(int(k))))

