"""Programs and the end of a pipeline."""

from __future__ import annotations

import ast
import re

import pandas as pd

from millrace.errors import OperatorError
from millrace.functions import fallback
from millrace.model import Table, TableSet, make_table, without_nan
from millrace.operators.base import Operator, Param, get_table, register

_SQL = re.compile(r"^\s*(?:select|with)\b", re.I)


@register
class ExeCode(Operator):
    """Run a program over the named tables that makes the table target: a SQL query, or Python with each table as a pandas frame."""

    NAME, CATEGORY = "ExeCode", "program synthesis"
    #: Rows of each table that may be brought to the driver for a Python program.
    LIMIT = 1_000_000
    PARAMS = (Param("tables", many=True), Param("target"), Param("func"), Param("limit", LIMIT))

    def apply(self, state: TableSet, /, tables, target, func, limit=LIMIT) -> TableSet:
        named = [get_table(state, n) for n in tables]
        source = str(func or "").strip()
        if not source:
            raise OperatorError("the program is empty")
        if _SQL.match(source):
            return state.replace(Table(target, without_nan(_run_sql(named, source))))
        return state.replace(self._python(named, target, source, limit))

    def _python(self, named: list[Table], target: str, source: str, limit: int) -> Table:
        if re.match(r"^\s*lambda\b", source):
            raise OperatorError("the program must be statements that assign the target, not a lambda")
        if not fallback.allowed():
            raise OperatorError("Python programs are off (MILLRACE_ALLOW_PYTHON=1 allows them); a SQL query works always")
        fallback.audit(source)
        space = fallback.namespace()
        for t in named:
            if t.df.limit(limit + 1).count() > limit:
                raise OperatorError(f"StateTooLarge: {t.name} has over {limit} rows; use a SQL query, which runs distributed, or raise 'limit'")
            space[t.name] = t.ordered().toPandas()
        exec(compile(ast.parse(source), "<program>", "exec"), space)  # noqa: S102
        if target not in space:
            raise OperatorError(f"the program doesn't assign {target!r}")
        made = space[target]
        if isinstance(made, pd.Series):
            made = made.to_frame()
        if not isinstance(made, pd.DataFrame):
            raise OperatorError(f"{target!r} is not a table but {type(made).__name__}")
        made = made.reset_index(drop=True)
        made.columns = [str(c) for c in made.columns]
        spark = named[0].df.sparkSession
        if made.empty:
            made = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in made.columns) or "empty string")
        return make_table(spark, target, made)


def _run_sql(named: list[Table], source: str):
    """A query over views of the tables; it stays a lazy plan."""
    spark = named[0].df.sparkSession
    for t in named:
        t.visible.createOrReplaceTempView(t.name)
    try:
        df = spark.sql(re.sub(r";\s*$", "", source))
        df.schema  # noqa: B018 - resolved while the views exist
        return df
    finally:
        for t in named:
            spark.catalog.dropTempView(t.name)


@register
class Terminate(Operator):
    """End the pipeline: the one table given is the answer."""

    NAME, CATEGORY = "Terminate", "control"
    PARAMS = (Param("table", many=True),)

    def apply(self, tables: TableSet, /, table) -> TableSet:
        if len(table) != 1:
            raise OperatorError("exactly one table is the answer")
        return tables.marked(get_table(tables, table[0]).name)


def answer_table(tables: TableSet) -> Table | None:
    return tables[tables.answer] if tables.answer else None
