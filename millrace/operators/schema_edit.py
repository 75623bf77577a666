"""Schema editing."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import OperatorError
from millrace.functions.expressions import NotCompilable, Value, compile_cell, compile_cells, compile_row
from millrace.functions.fallback import python_column
from millrace.model import TableSet, quoted
from millrace.operators.base import Operator, Param, get_table, need_columns, register
from millrace.operators.cleaning import with_column


def types_of(t) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in t.df.schema.fields if f.name in t.columns}


@register
class RenameColumn(Operator):
    """Rename columns by a mapping of old to new names, all at once."""

    NAME, CATEGORY = "RenameColumn", "schema editing"
    PARAMS = (Param("table"), Param("rename_map"))

    def apply(self, tables: TableSet, /, table, rename_map) -> TableSet:
        t = get_table(tables, table)
        if not isinstance(rename_map, dict):
            raise OperatorError("rename_map must be a mapping")
        need_columns(t, list(rename_map))
        return tables.replace(t.select(*[quoted(c).alias(str(rename_map.get(c, c))) for c in t.columns]))


@register
class AddNewColumn(Operator):
    """Add a column computed by func(row)."""

    NAME, CATEGORY = "AddNewColumn", "schema editing"
    PARAMS = (Param("table"), Param("name"), Param("func"))

    def apply(self, tables: TableSet, /, table, name, func) -> TableSet:
        t = get_table(tables, table)
        try:
            new = compile_row(func, types_of(t))
        except NotCompilable:
            new = python_column(t.df, func, t.columns, "row")
        return tables.replace(with_column(t, name, new))


@register
class DropColumn(Operator):
    """Drop columns."""

    NAME, CATEGORY = "DropColumn", "schema editing"
    PARAMS = (Param("table"), Param("columns", many=True))

    def apply(self, tables: TableSet, /, table, columns) -> TableSet:
        t = get_table(tables, table)
        need_columns(t, columns)
        return tables.replace(t.select(*[quoted(c) for c in t.columns if c not in columns]))


@register
class SplitColumn(Operator):
    """Split a column into the target columns, by a literal separator or by func(value) giving a list; parts lacking are missing."""

    NAME, CATEGORY = "SplitColumn", "schema editing"
    PARAMS = (
        Param("table"), Param("source"), Param("target", many=True), Param("func", None), Param("sep", None), Param("drop", True),
    )

    def apply(self, tables: TableSet, /, table, source, target, func=None, sep=None, drop=True) -> TableSet:
        t = get_table(tables, table)
        need_columns(t, [source])
        c = quoted(source)
        if sep is not None and func is None:
            parts = F.split(c.cast("string"), re.escape(str(sep)), -1)
        elif func is not None:
            try:
                v = compile_cell(func, c, t.type_of(source))
            except NotCompilable:
                v = Value(python_column(t.df, func, [source], "cell"), "any")
                if not isinstance(t.df.select(v.col.alias("x")).schema["x"].dataType, T.ArrayType):
                    v = Value(F.array(v.col), "list")
            parts = v.col if v.kind in ("list", "any") else F.array(v.col)
        else:
            raise OperatorError("either sep or func is needed")
        names = [n for n in t.columns if n not in target and not (drop and n == source)]
        made = [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(target)]
        return tables.replace(t.select(*map(quoted, names), *made))


@register
class Concatenate(Operator):
    """Join columns into target, by sep (missing cells count as empty) or by func(*values) or func(row)."""

    NAME, CATEGORY = "Concatenate", "schema editing"
    PARAMS = (
        Param("table"), Param("columns", many=True), Param("target"), Param("func", None), Param("sep", " "), Param("drop", False),
    )

    def apply(self, tables: TableSet, /, table, columns, target, func=None, sep=" ", drop=False) -> TableSet:
        t = get_table(tables, table)
        need_columns(t, columns)
        if func is None:
            new = F.concat_ws(str(sep), *[F.coalesce(quoted(c).cast("string"), F.lit("")) for c in columns])
        else:
            types = types_of(t)
            try:
                new = compile_cells(func, [(quoted(c), types[c]) for c in columns])
            except (NotCompilable, KeyError):
                try:
                    new = compile_row(func, types)
                except NotCompilable:
                    new = python_column(t.df, func, columns, "cells")
        t = with_column(t, target, new)
        if drop:
            t = t.select(*[quoted(c) for c in t.columns if c not in columns or c == target])
        return tables.replace(t)


@register
class SelectColumn(Operator):
    """Keep the columns given, in that order."""

    NAME, CATEGORY = "SelectColumn", "schema editing"
    PARAMS = (Param("table"), Param("columns", many=True))

    def apply(self, tables: TableSet, /, table, columns) -> TableSet:
        t = get_table(tables, table)
        need_columns(t, columns)
        return tables.replace(t.select(*map(quoted, dict.fromkeys(columns))))


@register
class Subtitle(Operator):
    """Add a column target_col that holds title in every row."""

    NAME, CATEGORY = "Subtitle", "schema editing"
    PARAMS = (Param("table"), Param("title"), Param("target_col"))

    def apply(self, tables: TableSet, /, table, title, target_col) -> TableSet:
        return tables.replace(with_column(get_table(tables, table), target_col, F.lit(title)))
