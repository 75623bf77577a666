"""Millrace: a Spark-first engine for building, running and checking data-preparation pipelines."""

from __future__ import annotations

import importlib

#: The package's names and the modules that hold them, imported on first use.
_HOME = {
    "ColumnSpec": "model", "Table": "model", "TableSchema": "model", "TableSet": "model", "Task": "model", "make_table": "model",
    "load_tasks": "sources.tasks", "Environment": "plans.environment", "ExecutionResult": "plans.environment", "Limits": "plans.environment",
    "Node": "plans.environment", "ReasoningTree": "plans.environment", "OPERATORS": "operators", "operator_manual": "operators",
    "OperatorCall": "plans.dsl", "parse_pipeline": "plans.dsl", "SolveResult": "agent.protocol", "Step": "agent.protocol",
    "TreeAgent": "agent.solvers", "get_spark": "session", "table_match": "metrics", "synthesize": "synthesis", "evaluate": "agent.evaluate",
}
__version__ = "0.2.0"
__all__ = [*_HOME, "__version__"]


def __getattr__(name: str) -> object:
    if name in _HOME:
        return getattr(importlib.import_module(f"millrace.{_HOME[name]}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
