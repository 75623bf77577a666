"""Aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import OperatorError
from millrace.functions.expressions import NotCompilable, compile_series, compile_statistic
from millrace.functions.fallback import _fit, annotated, kind_of, load, result_type, type_of_kinds
from millrace.model import Table, TableSet, hidden_name, quoted
from millrace.operators.base import Operator, Param, get_table, need_columns, register, strict
from millrace.operators.cleaning import numeric, one_row
from millrace.operators.ordering import ascending_order, position
from millrace.operators.quantiles import group_quantiles
from millrace.operators.schema_edit import types_of

#: Other names of the aggregates.
ALIASES = {"avg": "mean", "average": "mean", "total": "sum"}
NAMES = ("mean", "sum", "count", "size", "min", "max", "median", "std", "var", "first", "last", "nunique", "list", "unique")
NUMERIC = ("mean", "sum", "median", "std", "var")


def aggregate(t: Table, column: str, name: str) -> Column:
    """One named aggregate of a column but the median; row order counts for first, last, list and unique."""
    c = quoted(column)
    if name in NUMERIC:
        x = numeric(t, column)
        if name == "sum":
            return F.coalesce(F.sum(x), F.lit(0))
        return {"mean": F.avg, "std": F.stddev_samp, "var": F.var_samp}[name](x)
    if name == "count":
        return F.count(c)
    if name == "size":
        return F.count(F.lit(1))
    if name in ("min", "max"):
        return F.min(c) if name == "min" else F.max(c)
    if name == "nunique":
        return F.countDistinct(c)
    if name in ("first", "last"):
        at = F.when(c.isNotNull(), position(t))  # min_by and max_by skip rows whose key is NULL
        return (F.min_by if name == "first" else F.max_by)(c, at)
    rows = F.collect_list(F.struct(position(t).alias("at"), c.alias("v")))
    values = F.transform(F.array_sort(rows), lambda x: x["v"])
    return values if name == "list" else F.array_distinct(values)


def grouped(t: Table, by: list[str], specs: list[tuple[str, str, str]]) -> DataFrame:
    """A row for each group of the ``by`` columns with an aggregate for each (column, function, alias).

    Medians, callables, and distinct counts where there are several, are planned by themselves and joined: they
    would multiply the rows of the others, or hold a group's values in one task.
    """
    several = len({c for c, s, _ in specs if s == "nunique"}) > 1 or any(s == "median" for _, s, _ in specs)
    together, apart = [], []
    for c, s, alias in specs:
        if s == "median":
            apart.append((group_quantiles(t.df, by, numeric(t, c), [0.5], [alias]), alias))
        elif s == "nunique" and several:
            one = t.df.select(*map(quoted, by), quoted(c).alias("__v")).groupBy(*map(quoted, by), "__v").agg(F.lit(1).alias("__n"))
            apart.append((one.groupBy(*map(quoted, by)).agg(F.count("__v").alias(alias)), alias))
        elif s in NAMES:
            together.append(aggregate(t, c, s).alias(alias))
        else:
            try:
                together.append(compile_series(s, quoted(c), t.type_of(c)).alias(alias))
            except NotCompilable:
                apart.append((t.df.groupBy(*map(quoted, by)).agg(python_aggregate(t, by, c, s).alias(alias)), alias))
    df = t.df.groupBy(*map(quoted, by)).agg(*(together or [F.count(F.lit(1)).alias("__n")]))
    for extra, alias in apart:
        keys = [(k, hidden_name()) for k in by]
        extra = extra.select(*[quoted(k).alias(n) for k, n in keys], quoted(alias))
        same = F.lit(True)
        for k, n in keys:
            same = same & quoted(k).eqNullSafe(F.col(n))
        df = df.join(extra, same, "left").drop(*[n for _, n in keys])
    return df.select(*map(quoted, by), *[quoted(a) for _, _, a in specs])


@register
class GroupBy(Operator):
    """Group by columns (missing values form a group) and aggregate: agg maps a column to a function name, a lambda of the group's values, or a list of names."""

    NAME, CATEGORY = "GroupBy", "aggregation"
    PARAMS = (Param("table"), Param("by", many=True), Param("agg"), Param("rename", None))

    def apply(self, tables: TableSet, /, table, by, agg, rename=None) -> TableSet:
        t = get_table(tables, table)
        if not isinstance(agg, dict) or not agg:
            raise OperatorError("agg must map columns to functions")
        need_columns(t, [*by, *agg])
        if both := [c for c in agg if c in by]:
            raise OperatorError(f"{both} are grouping keys: aggregate a copy, or count another column with 'size'")
        specs = []
        for c, spec in agg.items():
            many = isinstance(spec, (list, tuple))
            for s in spec if many else [spec]:
                name = ALIASES.get(str(s).lower(), str(s).lower())
                specs.append((c, name if name in NAMES else s, f"{c}_{s}" if many else c))
        if any(s in ("first", "last", "list", "unique") for _, s, _ in specs):
            t = ascending_order(t)
        if strict():
            self._check(t, specs)
        df = grouped(t, by, specs)
        names = {c: str((rename or {}).get(c, c)) for c in df.columns}
        keys = [hidden_name() for _ in by]
        df = df.select(*[quoted(c).alias(n) for c, n in names.items()], *[quoted(c).alias(k) for c, k in zip(by, keys, strict=True)])
        return tables.replace(t.with_df(df, [(k, True) for k in keys]))

    @staticmethod
    def _check(t: Table, specs: list) -> None:
        texts = sorted({c for c, s, _ in specs if s in NUMERIC and isinstance(t.type_of(c), T.StringType)})
        if texts:
            row = one_row(t, *[F.count(quoted(c)) for c in texts], *[F.count(numeric(t, c)) for c in texts])
            for i, c in enumerate(texts):
                if row[i] and not row[len(texts) + i]:
                    raise OperatorError(f"column {c!r} is not numeric; convert it with CastType first")


def python_aggregate(t: Table, by: list[str], column: str, source: str) -> Column:
    """A callable of a group's values; its type is annotated, else that of the results of all groups."""
    import pandas as pd

    fn = load(source)
    returns = annotated(fn)
    if returns is None:

        def kind(values: pd.Series) -> str:
            return kind_of(fn(values))

        kind.__annotations__ = {"values": pd.Series, "return": str}
        told = t.df.groupBy(*map(quoted, by)).agg(F.pandas_udf(kind, "string")(quoted(column)).alias("kind"))
        returns = type_of_kinds([r[0] for r in told.select("kind").distinct().collect()])

    def run(values: pd.Series) -> object:
        return _fit(fn(values), returns)

    run.__annotations__ = {"values": pd.Series, "return": {T.DoubleType: float, T.LongType: int, T.BooleanType: bool}.get(type(returns), str)}
    return F.pandas_udf(run, returns)(quoted(column))


@register
class Count(Operator):
    """A new table <table>_count of one cell: the number of rows."""

    NAME, CATEGORY = "Count", "aggregation"
    PARAMS = (Param("table"), Param("target", None), Param("column", "count"))

    def apply(self, tables: TableSet, /, table, target=None, column="count") -> TableSet:
        t = get_table(tables, table)
        return tables.replace(Table(target or f"{table}_count", t.df.agg(F.count(F.lit(1)).alias(column))))


@register
class CalculateStatistic(Operator):
    """A new table <table>_<stat> of one cell: func(frame), such as lambda df: df['x'].mean()."""

    NAME, CATEGORY = "CalculateStatistic", "aggregation"
    #: Rows that may be brought to the driver for a function that can't be compiled.
    LIMIT = 1_000_000
    PARAMS = (Param("table"), Param("stat"), Param("func"), Param("target", None), Param("limit", LIMIT))

    def apply(self, tables: TableSet, /, table, stat, func, target=None, limit=LIMIT) -> TableSet:
        t = get_table(tables, table)
        try:
            df = t.df.agg(compile_statistic(func, types_of(t)).alias(stat))
        except NotCompilable:
            fn = load(func)
            if t.df.limit(limit + 1).count() > limit:
                raise OperatorError(f"StateTooLarge: func can't be compiled and the table has over {limit} rows; raise 'limit' if the driver can hold them") from None
            value = fn(t.ordered().toPandas())
            if hasattr(value, "shape") and getattr(value, "shape", ()) != ():
                raise OperatorError("func must give one value, not a column or table") from None
            kind = result_type([value])
            df = t.df.sparkSession.range(1).select(F.lit(_fit(value, kind)).alias(stat))
        return tables.replace(Table(target or f"{table}_{stat}", df))
