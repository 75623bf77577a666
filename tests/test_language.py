import math
import re

import pandas as pd
import pytest
from fixtures import simple
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.errors import OperatorError
from millrace.functions.dates import pattern
from millrace.functions.expressions import NotCompilable, compile_cell, compile_row, compile_statistic
from millrace.plans.dsl import parse_call, parse_pipeline, split_calls

COLUMNS = "a double, b double, s string, t string, ok boolean"
ROWS = [(1.0, 2.0, "abc", "b", True), (None, 2.0, None, "x", None), (-3.5, None, " Pad ", "", False), (0.0, 0.0, "Über-9", "9", True), (7.0, 7.0, "", None, None)]

PREDICATES = [
    "r['a'] > 0", "not r['a'] > 0", "r['a'] != 1", "not r['a'] != 1", "r['a'] == r['b']", "not r['a'] == r['b']", "r['a'] != r['b']",
    "r['s'] in ('abc', '')", "r['s'] not in ('abc', '')", "not (r['a'] > 0 and r['b'] > 1)", "0 <= r['a'] <= 5", "not 0 <= r['a'] <= 5",
    "r['s'] is None", "r['s'] is not None and 'b' in r['s']", "pd.isna(r['a']) or r['a'] < 0", "not pd.isna(r['b'])", "r['ok'] == True",
    "r['s'] == r['t']", "r['a'] is not None and r['a'] % 2 == 1",
]


def none_as_pandas(row):
    return {k: v for k, v in zip("a b s t ok".split(), row, strict=True)}


def plain(source, row):
    """Python's own answer, where a comparison with a missing value is False (and != True)."""

    class Missing:
        __lt__ = __gt__ = __le__ = __ge__ = lambda self, o: False
        __eq__ = lambda self, o: isinstance(o, Missing) and False
        __ne__ = lambda self, o: True
        __hash__ = None

    r = none_as_pandas(row)
    numeric = {k: (float("nan") if v is None and k in "ab" else v) for k, v in r.items()}
    return bool(eval(f"lambda r: {source}", {"pd": pd, "math": math, "re": re})(numeric))  # noqa: S307


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], f"i long, {COLUMNS}").cache()


@pytest.mark.parametrize("source", PREDICATES)
def test_predicates_equal_python(df, source):
    types = {f.name: f.dataType for f in df.schema.fields}
    kept = {r.i for r in df.where(compile_row(f"lambda r: {source}", types, predicate=True)).collect()}
    as_value = {r.i for r in df.select("i", compile_row(f"lambda r: {source}", types).alias("v")).collect() if r.v}
    if " is " in source and "['a']" in source:  # a missing number is None here, NaN there
        want = {i for i, r in enumerate(ROWS) if r[0] is not None and r[0] % 2 == 1}
    else:
        want = {i for i, r in enumerate(ROWS) if plain(source, r)}
    assert kept == want and as_value == want


VALUES = [
    "str(x).strip().lower()", "str(x).upper()", "x.split('-')[0]", "x[0]", "x[-2:]", "x[1:3]", "x.removeprefix('Ü')", "x.rstrip(' ')",
    "x.replace('b', '*')", "re.sub('[a-c]+', '<>', x)", "len(x)", "'yes' if x.startswith('a') else 'no'", "x.capitalize()", "f'{x}!'",
    "x.zfill(6)", "x.lstrip().endswith('9')", "x.find('b')", "x.count('b')", "bool(re.fullmatch('[A-Z].*', x, re.IGNORECASE))", "x.title() + '?'",
]


@pytest.mark.parametrize("source", VALUES)
def test_text_values_equal_python(df, source):
    texts = [r for r in df.where("s is not null and s <> ''").collect()]
    v = compile_cell(f"lambda x: {source}", F.col("s"), df.schema["s"].dataType)
    got = {r.s: r.v for r in df.where("s is not null and s <> ''").select("s", v.col.alias("v")).collect()}
    for r in texts:
        assert got[r.s] == eval(f"lambda x: {source}", {"re": re})(r.s)  # noqa: S307


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-9, 9)), st.one_of(st.none(), st.integers(-9, 9))), min_size=1, max_size=8))
def test_arithmetic(spark, pairs):
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a long, b long")
    types = {f.name: f.dataType for f in frame.schema.fields}
    c = compile_row("lambda r: (r['a'] + 2) * r['b'] - abs(r['a']) // 2 + r['a'] % 3", types)
    got = {r.i: r.v for r in frame.select("i", c.alias("v")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == (None if a is None or b is None else (a + 2) * b - abs(a) // 2 + a % 3)


def test_pushdown(spark, sf, capsys):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    types = {f.name: f.dataType for f in lines.schema.fields}
    lines.where(compile_row("lambda r: r['l_quantity'] > 45 and r['l_returnflag'] != 'A'", types, predicate=True)).explain()
    plan = capsys.readouterr().out
    assert "GreaterThan(l_quantity,45.0)" in plan and "Not(EqualNullSafe(l_returnflag,A))" in plan and "Python" not in plan


def test_unknown_syntax_is_refused(spark):
    for source in ("lambda x: open('f')", "lambda x: [y for y in x]", "lambda x: x.__class__", "x", "lambda x: x @ 2", "lambda x: foo(x)"):
        with pytest.raises(NotCompilable):
            compile_cell(source, F.col("s"), spark.createDataFrame([], "s string").schema["s"].dataType)


def test_statistics(df):
    types = {f.name: f.dataType for f in df.schema.fields}
    get = lambda s: df.agg(compile_statistic(s, types)).head()[0]
    assert get("lambda df: float(df['a'].mean())") == pytest.approx(4.5 / 4)
    assert get("lambda df: len(df) - df['a'].notna().sum()") == 1
    assert get("lambda d: pd.to_numeric(d['s'], errors='coerce').sum()") == 0


def test_splitting():
    text = """Here is the plan:
    1. Filter(t, lambda r: r['a'] in ("x;y", 'z')); Sort(t, [a])
    - SplitColumn(t, s, [p, q],
        sep=',')
    Done (as I said).
    ExeCode([t], u, ```python
u = t.head(1)  # ; not a split
```)"""
    calls = split_calls(text)
    assert [c.split("(")[0] for c in calls] == ["Filter", "Sort", "SplitColumn", "ExeCode"]
    assert parse_call(calls[3]).params["func"].strip() == "u = t.head(1)  # ; not a split"
    assert split_calls("```\nDropNA(t)\nCount(t)\n```") == ["DropNA(t)", "Count(t)"]


def test_reading_arguments():
    c = parse_call("Join(left=a, right=b, on=(x, 'y z'), how=inner)")
    assert c.params == {"left": "a", "right": "b", "on": ("x", "y z"), "how": "inner", "target": None}
    assert parse_call("StandardizeDatetime(t, d, format=%Y-%m-%d)").params["format"] == "%Y-%m-%d"
    assert parse_call("TopK(t, 3, by=v, ascending=false)").params == {"table": "t", "k": 3, "by": ["v"], "ascending": False}
    assert parse_call("filter(t, lambda r: r['a'] > -1)").op.NAME == "Filter"
    assert parse_call("MissingValueImputation(t, c, constant, -2)").params["value"] == -2
    again = parse_call(parse_call("GroupBy(t, [k], {v: [sum, mean]})").canonical())
    assert again.params["agg"] == {"v": ["sum", "mean"]}
    for bad in ("DropNA(*x)", "DropNA(t", "not a call", "a.b(t)"):
        with pytest.raises(OperatorError):
            parse_call(bad)
    with pytest.raises(OperatorError):
        parse_pipeline("DropNA(t)\nNope(t)")


def test_date_patterns():
    assert pattern("%Y-%m-%d") == "yyyy-MM-dd" and pattern("%d of %B '%y") == "dd' of 'MMMM' '''yy"
    assert pattern("%m/%d/%Y", True) == "M/d/y" and pattern("%Y%m%d", True) == "yyyyMMdd"
    with pytest.raises(ValueError):
        pattern("%Q")


def test_fixture(spark):
    assert simple(spark).names == ["people", "depts"]
