"""Value normalization."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import OperatorError
from millrace.functions.dates import parse_dates, pattern
from millrace.functions.expressions import NotCompilable, compile_cell
from millrace.functions.fallback import python_column
from millrace.model import TableSet, quoted
from millrace.operators.base import Operator, Param, get_table, need_columns, register, strict
from millrace.operators.cleaning import numeric, one_row, with_column

#: Names of types, and the texts that are truth values.
TYPES = {
    "int": "int", "integer": "int", "int64": "int", "int32": "int32", "float": "float", "double": "float", "float64": "float",
    "float32": "float32", "str": "str", "string": "str", "text": "str", "object": "object", "bool": "bool", "boolean": "bool",
    "datetime": "datetime", "date": "datetime", "datetime64[ns]": "datetime", "category": "str",
}
TRUE, FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")


@register
class ValueTransform(Operator):
    """Apply func(value) to every cell of a column, into target or in place; func sees missing cells too."""

    NAME, CATEGORY = "ValueTransform", "value normalization"
    PARAMS = (Param("table"), Param("column"), Param("func"), Param("target", None))

    def apply(self, tables: TableSet, /, table, column, func, target=None) -> TableSet:
        t = get_table(tables, table)
        need_columns(t, [column])
        try:
            new = compile_cell(func, quoted(column), t.type_of(column)).col
        except NotCompilable:
            new = python_column(t.df, func, [column], "cell")
        return tables.replace(with_column(t, target or column, new))


@register
class StandardizeDatetime(Operator):
    """Parse dates, by input_format or value by value, and write them in format (None keeps timestamps); unparsable ones become missing, or an error with errors='raise'."""

    NAME, CATEGORY = "StandardizeDatetime", "value normalization"
    PARAMS = (
        Param("table"), Param("column"), Param("format", "%Y-%m-%d"), Param("input_format", None),
        Param("errors", "coerce", choices=("coerce", "raise")),
    )

    def apply(self, tables: TableSet, /, table, column, format="%Y-%m-%d", input_format=None, errors="coerce") -> TableSet:  # noqa: A002
        t = get_table(tables, table)
        need_columns(t, [column])
        kind = t.type_of(column)
        dated = isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
        ts = quoted(column).cast("timestamp_ntz") if dated else parse_dates(quoted(column), input_format, errors)
        if strict():
            rows, parsed = one_row(t, F.count(F.lit(1)), F.count(ts))
            if rows and not parsed:
                raise OperatorError(f"no value of column {column!r} is a date")
        if format not in (None, "None"):
            ts = F.date_format(ts, pattern(format))
        return tables.replace(with_column(t, column, ts))


@register
class CastType(Operator):
    """Convert a column to int, float, str, bool or datetime; what can't be converted becomes missing, or an error with errors='raise'."""

    NAME, CATEGORY = "CastType", "value normalization"
    PARAMS = (Param("table"), Param("column"), Param("dtype"), Param("errors", "coerce", choices=("coerce", "raise")))

    def apply(self, tables: TableSet, /, table, column, dtype, errors="coerce") -> TableSet:
        t = get_table(tables, table)
        need_columns(t, [column])
        kind = TYPES.get(str(dtype).lower())
        if kind is None:
            raise OperatorError(f"dtype must be one of {sorted(TYPES)}, not {dtype!r}")
        c, own = quoted(column), t.type_of(column)
        if kind == "object":
            return tables
        if kind == "str":
            new = c.cast("string")
        elif kind == "bool":
            s = F.lower(F.trim(c.cast("string")))
            new = c if isinstance(own, T.BooleanType) else F.when(s.isin(*TRUE, "1.0"), True).when(s.isin(*FALSE, "0.0"), False)
        elif kind == "datetime":
            new = c.cast("timestamp_ntz") if isinstance(own, (T.TimestampType, T.DateType, T.TimestampNTZType)) else parse_dates(c)
        else:
            x = c.cast("int") if isinstance(own, T.BooleanType) else numeric(t, column)
            if kind.startswith("int") and not isinstance(own, (T.IntegralType, T.BooleanType)):
                # With any value missing after conversion all are rounded half to even, else truncated.
                some_missing = not t.df.isStreaming and one_row(t, F.count(F.lit(1)) > F.count(x))[0]
                x = F.bround(x.cast("double")) if some_missing else x
            new = x.cast({"int": "bigint", "int32": "int", "float": "double", "float32": "float"}[kind])
        if errors == "raise":
            new = F.when(c.isNotNull() & new.isNull(), F.raise_error(F.concat(F.lit(f"not of type {dtype}: "), c.cast("string")))).otherwise(new)
            if strict():
                one_row(t, F.count(new))
        return tables.replace(with_column(t, column, new))
