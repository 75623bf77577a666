"""Pipelines over streams: the operators that look at one row at a time run on a streaming DataFrame unchanged.

A stream has no row order. CastType to int of numbers that aren't whole truncates: whether any value of the whole
table is missing, on which rounding depends, can't be known. Windows with state are in ``windows``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.errors import OperatorError
from millrace.model import Table, TableSet, hidden_name
from millrace.plans.dsl import parse_pipeline

#: Operators without state, order or a look at the whole table.
ROW_WISE = {
    "DropNA", "ErrorDetection", "ValueTransform", "StandardizeDatetime", "RenameColumn", "AddNewColumn", "DropColumn", "SplitColumn",
    "Concatenate", "SelectColumn", "Subtitle", "Filter", "Terminate", "CastType", "Explode", "Stack", "Append",
}


def _runs(op: str, params: dict, state: TableSet) -> bool:
    """Whether an operator needs no more than the rows at hand: Union of all rows, and Join with a table that isn't a stream."""
    if op == "Union":
        return params["how"] == "all"
    if op == "Join":
        right = state[params["right"]] if params["right"] in state else None
        return params["how"] in ("inner", "left", "cross") and (right is None or not right.df.isStreaming)
    return op in ROW_WISE


def run_on_stream(stream: DataFrame, name: str, pipeline: str, others: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The pipeline's result as a streaming DataFrame; operators that need the whole table are refused.

    ``others`` are further tables by name, streams or not. The result is the answer, or the table called ``name``.
    """
    at = hidden_name()  # no order: what isn't a stream has none here either
    state = TableSet([Table(n, df.withColumn(at, F.lit(0)), "", ((at, True),)) for n, df in {name: stream, **(others or {})}.items()])
    for call in parse_pipeline(pipeline):
        if not _runs(call.op.NAME, call.params, state):
            raise OperatorError(f"{call.op.NAME} needs the whole table and doesn't run on a stream")
        state = call.execute(state)
    return state[state.answer or name].visible
