"""Python callables that can't be compiled: Arrow-batched, and only where that is allowed.

MILLRACE_ALLOW_PYTHON=1, or ``allow(True)``, switches them on. The checks of names below keep honest
programs on the path; they are no security boundary.
"""

from __future__ import annotations

import ast
import datetime
import math
import os
import re
import statistics

import pandas as pd
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import OperatorError

_allowed: bool | None = None
#: A choice of our own: builtins without side effects that user code may use, and modules that it may import.
BUILTINS = (
    "abs", "all", "any", "bool", "chr", "dict", "divmod", "enumerate", "filter", "float", "format", "frozenset",
    "hash", "hex", "int", "isinstance", "iter", "len", "list", "map", "max", "min", "next", "oct", "ord", "pow",
    "print", "range", "repr", "reversed", "round", "set", "slice", "sorted", "str", "sum", "tuple", "type", "zip",
    "Exception", "ValueError", "TypeError", "KeyError", "IndexError", "ZeroDivisionError", "AttributeError", "True",
    "False", "None",
)
MODULES = ("pandas", "numpy", "re", "math", "statistics", "datetime", "json", "collections", "itertools", "functools", "string", "decimal")
_BANNED = {"eval", "exec", "compile", "open", "input", "globals", "locals", "vars", "delattr", "setattr", "getattr", "breakpoint"}


def allow(on: bool | None) -> None:
    """Switch Python callables on or off for this process; None: by the environment variable."""
    global _allowed
    _allowed = on


def allowed() -> bool:
    return os.environ.get("MILLRACE_ALLOW_PYTHON", "0") == "1" if _allowed is None else _allowed


def audit(source: str) -> None:
    """Refuse dunder names, banned builtins and imports outside MODULES."""
    try:
        tree = ast.parse(source.strip())
    except SyntaxError as e:
        raise OperatorError(f"SyntaxError: {e}") from e
    for n in ast.walk(tree):
        names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] if isinstance(n, ast.ImportFrom) else []
        for name in names:
            if name.split(".")[0] not in MODULES:
                raise OperatorError(f"import of {name!r} is not allowed")
        used = n.id if isinstance(n, ast.Name) else n.attr if isinstance(n, ast.Attribute) else ""
        if used.startswith("__") or used in _BANNED:
            raise OperatorError(f"use of {used!r} is not allowed")


def _import(name, globals=None, locals=None, fromlist=(), level=0):  # noqa: A002
    if name.split(".")[0] not in MODULES:
        raise ImportError(f"import of {name!r} is not allowed")
    return __import__(name, globals, locals, fromlist, level)


def namespace() -> dict:
    import builtins

    import numpy as np

    safe = {n: getattr(builtins, n) for n in BUILTINS if hasattr(builtins, n)}
    return {"__builtins__": {**safe, "__import__": _import}, "pd": pd, "np": np, "re": re, "math": math,
            "statistics": statistics, "datetime": datetime, "nan": float("nan")}


def load(source: str):
    """The callable of a lambda or of the last def."""
    if not allowed():
        raise OperatorError("this expression needs Python on the executors, which is off (MILLRACE_ALLOW_PYTHON=1 allows it)")
    audit(source)
    space = namespace()
    tree = ast.parse(source.strip())
    defs = [n.name for n in tree.body if isinstance(n, ast.FunctionDef)]
    if defs:
        exec(compile(tree, "<operator>", "exec"), space)  # noqa: S102
        return space[defs[-1]]
    made = eval(compile(ast.parse(source.strip(), mode="eval"), "<operator>", "eval"), space)  # noqa: S307
    if not callable(made):
        raise OperatorError("the expression is not callable")
    return made


def kind_of(v) -> str | None:
    """What a Python value is: bool, int, float, list, text; None where it is missing."""
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    name = type(v).__name__
    if name in ("bool", "bool_"):
        return "bool"
    if isinstance(v, int) or name.startswith(("int", "uint")):
        return "int"
    if isinstance(v, float) or name.startswith("float"):
        return "float"
    return "list" if isinstance(v, (list, tuple)) else "text"


def type_of_kinds(kinds: list[str | None]) -> T.DataType:
    """The type that holds values of these kinds."""
    some = {k for k in kinds if k}
    if some == {"bool"}:
        return T.BooleanType()
    if some == {"int"}:
        return T.LongType()
    if some and some <= {"int", "float"}:
        return T.DoubleType()
    return T.ArrayType(T.StringType()) if some == {"list"} else T.StringType()


def result_type(values: list) -> T.DataType:
    return type_of_kinds([kind_of(v) for v in values])


def annotated(fn) -> T.DataType | None:
    """The type that a def names as its result: ``def f(x) -> float``."""
    named = getattr(fn, "__annotations__", {}).get("return")
    return {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), list: T.ArrayType(T.StringType())}.get(named)


def _fit(v, t: T.DataType):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(t, T.StringType):
        return str(v)
    if isinstance(t, T.ArrayType):
        return [None if x is None else str(x) for x in v]
    return bool(v) if isinstance(t, T.BooleanType) else int(v) if isinstance(t, T.LongType) else float(v)


def python_column(df: DataFrame, source: str, columns: list[str], how: str, returns: T.DataType | None = None) -> Column:
    """A pandas UDF over ``columns``; ``how``: the callable takes a ``cell``, ``cells``, or a ``row``.

    Its type is ``returns``, else what the callable's def is annotated with, else the one that holds the
    results of all rows: a pass of its own.
    """
    fn = load(source)

    def one(*values):
        if how == "cell":
            return fn(values[0])
        if how == "cells":
            return fn(*values)
        return fn(dict(zip(columns, values, strict=True)))

    def results(frame: pd.DataFrame):
        rows = zip(*(frame[c].astype(object).where(frame[c].notna(), None) if frame[c].dtype != object else frame[c] for c in frame), strict=True)
        return (one(*r) for r in rows)

    picked = F.struct(*[F.col(f"`{c}`") for c in columns])
    returns = returns or annotated(fn)
    if returns is None:

        @F.pandas_udf("string")
        def kinds(frame: pd.DataFrame) -> pd.Series:
            return pd.Series([kind_of(v) for v in results(frame)], dtype=object)

        try:
            returns = type_of_kinds([r[0] for r in df.select(kinds(picked).alias("kind")).distinct().collect()])
        except PythonException as e:
            raise OperatorError(_last_line(e)) from e

    @F.pandas_udf(returns)
    def run(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([_fit(v, returns) for v in results(frame)], dtype=object)

    return run(picked)


def _last_line(e: Exception) -> str:
    """The callable's own error, which ends the traceback that Spark passes on."""
    lines = [x.strip() for x in str(e).splitlines() if re.match(r"\s*\w*(?:Error|Exception|Iteration)\b.*", x)]
    return lines[-1] if lines else str(e).strip().splitlines()[0]
