"""Tasks and examples in JSON and JSON Lines."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from millrace.model import Table, TableSchema, TableSet, Task, dumps, make_table
from millrace.operators.reshaping import common_type


def _column_type(values: list) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    types = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), list: T.ArrayType(T.StringType())}
    return common_type([types.get(k, T.StringType()) for k in kinds]) if kinds else T.StringType()


def _fit(v, t: T.DataType):
    if v is None:
        return None
    if isinstance(t, T.StringType):
        return v if isinstance(v, str) else json.dumps(v) if isinstance(v, (dict, list)) else str(v)
    if isinstance(t, T.ArrayType):
        return [None if x is None else str(x) for x in v]
    return float(v) if isinstance(t, T.DoubleType) else v


def table_from_dict(spark: SparkSession, d: dict) -> Table:
    """A table of {"name", "schema", "data": {"index", "columns", "data"}}; rows keep their order."""
    columns = [str(c) for c in d["data"]["columns"]]
    rows = d["data"]["data"]
    types = [_column_type([r[i] for r in rows]) for i in range(len(columns))]
    schema = TableSchema.from_dict(d.get("schema") or {})
    told = {c.name: c.description for c in schema.columns}
    fields = [T.StructField(c, t, True, {"description": told[c]} if told.get(c) else {}) for c, t in zip(columns, types, strict=True)]
    data = [tuple(_fit(v, t) for v, t in zip(r, types, strict=True)) for r in rows]
    return make_table(spark, str(d["name"]), (data, T.StructType(fields)), schema.description)


def table_to_dict(table: Table) -> dict:
    rows = [list(r) for r in table.ordered().collect()]
    data = {"index": list(range(len(rows))), "columns": table.columns, "data": rows}
    return {"name": table.name, "schema": table.schema.to_dict(), "data": data}


def task_from_dict(spark: SparkSession, d: dict) -> Task:
    target = d.get("target_table")
    return Task(
        str(d["task_id"]), TableSet(table_from_dict(spark, s) for s in d["sources"]), TableSchema.from_dict(d.get("target_schema") or {}),
        table_from_dict(spark, target) if target else None, list(d.get("gold_pipeline") or []), dict(d.get("metadata") or {}),
    )


def task_to_dict(task: Task) -> dict:
    return {
        "task_id": task.task_id, "sources": [table_to_dict(t) for t in task.sources.values()],
        "target_schema": task.target_schema.to_dict(),
        "target_table": table_to_dict(task.target_table) if task.target_table else None,
        "gold_pipeline": task.gold_pipeline, "metadata": task.metadata,
    }


def load_tasks(spark: SparkSession, path: str) -> list[Task]:
    """Tasks of a .jsonl file (one a line) or a .json file (a list, or one)."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".jsonl"):
        found = [json.loads(x) for x in text.splitlines() if x.strip()]
    else:
        found = json.loads(text)
        found = found if isinstance(found, list) else [found]
    return [task_from_dict(spark, d) for d in found]


def write_jsonl(path: str, rows: Iterable[dict]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(dumps(r) + "\n" for r in rows)


def read_jsonl(path: str) -> list[dict]:
    return [json.loads(x) for x in Path(path).read_text(encoding="utf-8").splitlines() if x.strip()]


def save_task(task: Task, path: str) -> None:
    Path(path).write_text(dumps(task_to_dict(task)), encoding="utf-8")
