import pandas as pd
import pytest
from fixtures import rows, simple
from pyspark.sql import functions as F

from millrace.errors import OperatorError
from millrace.functions.fallback import allow
from millrace.model import TableSet, make_table
from millrace.operators import OPERATORS, operator_manual, operators_by_category
from millrace.operators.queries import run_pipeline


@pytest.fixture(scope="module")
def tables(spark):
    return simple(spark)


def of(spark, pipeline, result="t", **frames):
    return rows(run_pipeline(TableSet.of(spark, **frames), pipeline)[result])


def test_there_are_31_operators():
    assert len(OPERATORS) == 31
    assert sorted(map(len, operators_by_category().values())) == [1, 1, 3, 3, 3, 3, 5, 5, 7]
    assert all(name in operator_manual() for name in OPERATORS)


@pytest.mark.parametrize(
    ("pipeline", "result", "n"),
    [
        ("Deduplicate(people, [id])", "people", 4), ("DropNA(people, [salary])", "people", 4), ("DropNA(people)", "people", 3),
        ("DropNA(people, how=all)", "people", 5), ("Filter(people, lambda r: r['dept'] == 'eng')", "people", 3),
        ("Append(depts, depts)", "depts", 6), ("Union([depts, depts])", "depts_depts_union", 3), ("Transpose(depts)", "depts", 2),
        ("Join(people, depts, on=(dept, code))", "people_depts_join", 4), ("Explode(people, tags, sep=',')", "people", 7),
        ("TopK(people, 2)", "people", 2), ("TopK(people, 0)", "people", 0), ("Count(people)", "people_count", 1),
    ],
)
def test_sizes(tables, pipeline, result, n):
    out = run_pipeline(tables, pipeline)
    assert len(rows(out[result])) == n
    assert rows(tables["people"])[0][1] == " Alice "
    assert all(out[k] is tables[k] for k in tables if k != result)


def test_order_is_kept_and_consumed(spark):
    t = ([(1, "x", 3), (2, None, 1), (3, "y", None), (4, None, 2), (5, "x", 2)], "i long, v string, k long")
    assert [r[0] for r in of(spark, "Sort(t, [k])", t=t)] == [2, 4, 5, 1, 3]
    assert [r[0] for r in of(spark, "Sort(t, [k], ascending='desc')", t=t)] == [1, 4, 5, 2, 3]
    assert [r[1] for r in of(spark, "MissingValueImputation(t, v, ffill)", t=t)] == ["x", "x", "y", "y", "x"]
    assert [r[1] for r in of(spark, "MissingValueImputation(t, v, bfill)", t=t)] == ["x", "y", "y", "x", "x"]
    assert [r[1] for r in of(spark, "Sort(t, [i], ascending=False)\nMissingValueImputation(t, v, ffill)", t=t)] == ["x", "x", "y", "y", "x"]
    assert [r[0] for r in of(spark, "Deduplicate(t, [v], keep=last)", t=t)] == [3, 4, 5]
    assert [r[0] for r in of(spark, "Sort(t, [k], ascending=False)\nDeduplicate(t, [v])\nTopK(t, 2)", t=t)] == [1, 4]
    assert of(spark, "GroupBy(t, [v], {i: list, k: first})", t=t) == [("x", [1, 5], 3), ("y", [3], None), (None, [2, 4], 1)]


def test_imputation(spark):
    mixed = ([("abc",), ("1",), ("2",), (None,)], "v string")
    assert of(spark, "MissingValueImputation(t, v)", t=mixed) == [("abc",), ("1",), ("2",), ("1.5",)]
    assert of(spark, "MissingValueImputation(t, v, zero)", t=mixed)[3] == ("0",)
    assert of(spark, "MissingValueImputation(t, v, mode)", t=([(2,), (3,), (None,)], "v long"))[2] == (2,)
    assert of(spark, "MissingValueImputation(t, v, mean)", t=([(2,), (3,), (None,)], "v long")) == [(2.0,), (3.0,), (2.5,)]
    with pytest.raises(OperatorError, match="needs a value"):
        of(spark, "MissingValueImputation(t, v, constant)", t=mixed)


def test_casts_round_only_if_something_is_missing(spark):
    cast = lambda v, to: [r[0] for r in of(spark, f"CastType(t, v, {to})", t=([(x,) for x in v], "v string"))]
    assert cast(["1.7", "2.2", "-1.5"], "int") == [1, 2, -1]
    assert cast(["1.7", "2.5", "x"], "int") == [2, 2, None]
    assert cast([" Yes", "0", "maybe", None], "bool") == [True, False, None, None]
    assert cast(["1d", "1e3", ".5", "nan"], "float") == [None, 1000.0, 0.5, None]


def test_outliers_and_errors(spark):
    v = ([(x,) for x in [1.0, 2.0, 3.0, 4.0, 100.0, None]], "v double")
    assert [r[0] for r in of(spark, "OutlierDetection(t, v)", t=v)] == [1.0, 2.0, 3.0, 4.0, None]
    s = pd.Series([1.0, 2.0, 3.0, 4.0, 100.0])
    q1, q3 = s.quantile([0.25, 0.75])
    assert of(spark, "OutlierDetection(t, v, clip)", t=v)[4][0] == pytest.approx(q3 + 1.5 * (q3 - q1))
    e = ([(1,), (-1,), (3,)], "v long")
    assert of(spark, "ErrorDetection(t, v, lambda x: x < 0)", t=e) == [(1, False), (-1, True), (3, False)]
    assert of(spark, "ErrorDetection(t, v, lambda x: x < 0, remove)", t=e) == [(1,), (3,)]


def test_dates(spark):
    d = ([("2021-01-02",), ("01/03/2021",), ("3 Apr 2020",), ("no",)], "d string")
    assert [r[0] for r in of(spark, "StandardizeDatetime(t, d)", t=d)] == ["2021-01-02", "2021-01-03", "2020-04-03", None]
    assert of(spark, "StandardizeDatetime(t, d, format=%d %B %Y, input_format=%Y-%m-%d)", t=d)[0] == ("02 January 2021",)
    assert of(spark, "StandardizeDatetime(t, d, format='%b', input_format='%m/%d/%Y')", t=d)[1] == ("Jan",)


def test_schema_edits(spark, tables):
    swapped = run_pipeline(tables, "RenameColumn(depts, {code: label, label: code})")["depts"]
    assert swapped.columns == ["label", "code"] and rows(swapped)[0] == ("eng", "Engineering")
    t = ([("a-b-c", None, 1.0), (None, "y", 2.5)], "s string, n string, f double")
    assert of(spark, "SplitColumn(t, s, [p, q], sep='-')", t=t) == [(None, 1.0, "a", "b"), ("y", 2.5, None, None)]
    assert of(spark, "SplitColumn(t, s, [s, z], func=lambda v: v.split('-'))", t=t)[0] == (None, 1.0, "a", "b")
    assert [r[-1] for r in of(spark, "Concatenate(t, [s, n, f], j, sep='-')", t=t)] == ["a-b-c--1.0", "-y-2.5"]
    assert of(spark, "Concatenate(t, [s, n], j, func=lambda a, b: str(a) + '/' + str(b), drop=true)", t=t) == [(1.0, "a-b-c/None"), (2.5, "None/y")]
    assert run_pipeline(TableSet.of(spark, t=t), "SplitColumn(t, s, [p], sep='-', drop=false)")["t"].columns == ["s", "n", "f", "p"]


def test_descriptions_follow(spark):
    from millrace.sources.tasks import table_from_dict

    d = {"name": "t", "schema": {"description": "all", "columns": [{"name": "a", "description": "first"}, "b"]}, "data": {"index": [0], "columns": ["a", "b"], "data": [[1, 2]]}}
    t = run_pipeline(TableSet([table_from_dict(spark, d)]), "RenameColumn(t, {a: c})\nFilter(t, lambda r: r['b'] > 0)\nDropColumn(t, b)")["t"]
    assert t.description == "all" and t.schema.get("c").description == "first"


def test_group_by(spark):
    t = ([("a", 1.0, "1"), ("a", None, "2"), (None, 3.0, "x"), ("b", None, None)], "k string, v double, s string")
    assert of(spark, "GroupBy(t, [k], {v: sum, s: count})", t=t) == [("a", 1.0, 2), ("b", 0.0, 0), (None, 3.0, 1)]
    assert of(spark, "GroupBy(t, k, {v: [avg, std], s: sum})", t=t) == [("a", 1.0, None, 3.0), ("b", None, None, 0.0), (None, 3.0, None, 0.0)]
    assert run_pipeline(TableSet.of(spark, t=t), "GroupBy(t, k, {v: [mean, max]}, rename={v_mean: m})")["t"].columns == ["k", "m", "v_max"]
    with pytest.raises(OperatorError, match="grouping keys"):
        of(spark, "GroupBy(t, [k], {k: count})", t=t)


def test_joins(spark):
    a = ([(1, "p"), (None, "q"), (3, "r")], "k long, x string")
    b = ([(1, "s"), (None, "t"), (4, "u")], "k long, x string")
    j = lambda how: of(spark, f"Join(a, b, on=k, how={how})", "a_b_join", a=a, b=b)
    assert j("inner") == [(1, "p", "s"), (None, "q", "t")]
    assert j("left") == [(1, "p", "s"), (None, "q", "t"), (3, "r", None)]
    assert j("right") == [(1, "p", "s"), (None, "q", "t"), (4, None, "u")]
    assert j("outer") == [(1, "p", "s"), (3, "r", None), (4, None, "u"), (None, "q", "t")]
    assert len(j("cross")) == 9
    assert run_pipeline(TableSet.of(spark, a=a, b=b), "Join(a, b, on=k)")["a_b_join"].columns == ["k", "x", "x_right"]
    c = ([(1.0, "s"), (2.0, "t")], "k double, y string")
    d = ([("1", "z")], "k string, z string")
    assert len(of(spark, "Join(a, c, on=k)", "a_c_join", a=a, c=c)) == 1
    assert len(of(spark, "Join(c, d, on=k)", "c_d_join", c=c, d=d)) == 1


def test_suffix_escalates(spark):
    a = ([(1, 2, 3)], "i long, n long, n_right long")
    b = ([(1, 5)], "j long, n long")
    assert run_pipeline(TableSet.of(spark, a=a, b=b), "Join(a, b, on=(i, j))")["a_b_join"].columns == ["i", "n", "n_right", "j", "n_right2"]


def test_reshaping(spark):
    w = ([("x", "F", 1), ("x", "O", 2), ("y", "F", None), (None, "F", 7), ("z", None, 8)], "i string, c string, v long")
    assert of(spark, "Pivot(t, i, c, v, sum)", t=w) == [("x", 1, 2), ("y", 0, None)]
    assert of(spark, "Pivot(t, i, c, v)", t=w) == [("x", 1, 2)]
    s = ([(1, "a", 2), (2, "b", 3)], "i long, p string, q long")
    assert of(spark, "Stack(t, [i])", t=s) == [(1, "p", "a"), (2, "p", "b"), (1, "q", "2"), (2, "q", "3")]
    assert of(spark, "WideToLong(t, [a, b], [i], y, sep=_)", t=([(1, 10, 20, "k"), (2, 11, 21, "l")], "i long, a_1 long, a_2 long, b_2 string")) == [
        (1, 1, 10, None), (2, 1, 11, None), (1, 2, 20, "k"), (2, 2, 21, "l"),
    ]
    assert of(spark, "Transpose(t)", t=s) == [("i", "1", "2"), ("p", "a", "b"), ("q", "2", "3")]
    assert of(spark, "Explode(t, l)", t=([(1, ["a ", "b"]), (2, []), (3, None)], "i long, l array<string>")) == [(1, "a"), (1, "b"), (2, None), (3, None)]


def test_programs(tables):
    out = run_pipeline(tables, "ExeCode([people, depts], big, 'SELECT name FROM people JOIN depts ON dept = code WHERE salary > 150')")
    assert len(rows(out["big"])) == 2
    with pytest.raises(OperatorError, match="off"):
        run_pipeline(tables, "ExeCode([people], x, 'x = people.head(1)')")
    allow(True)
    try:
        assert len(rows(run_pipeline(tables, "ExeCode([people], x, 'x = people[people.salary > 150]')")["x"])) == 3
        with pytest.raises(OperatorError, match="not allowed"):
            run_pipeline(tables, "ExeCode([people], x, 'import os\\nx = people')")
        odd = run_pipeline(tables, "AddNewColumn(people, n, lambda r: sum(len(x) for x in r['tags'].split(',')))")
        assert [r[-1] for r in rows(odd["people"])] == [2, 1, 1, 2, 1]
        got = run_pipeline(tables, "GroupBy(people, [dept], {salary: lambda s: sorted(s.dropna())[-1] if len(s.dropna()) else None})")
        assert [r[1] for r in rows(got["people"])] == [200.0, None, 5000.0]
    finally:
        allow(None)


@pytest.mark.parametrize(
    ("call", "message"),
    [
        ("DropNA(nope)", "MissingTable:"), ("SelectColumn(people, [nope])", "MissingColumn:"), ("Nope(people)", "unknown operator"),
        ("DropNA()", "missing required parameter"), ("DropNA(people, x=1)", "unexpected parameter"), ("DropNA(people, how=some)", "must be one of"),
        ("TopK(people, -1)", "integer"), ("Sort(people, [id], ascending=[True, False])", "2 values"), ("Terminate([people, depts])", "exactly one"),
        ("CastType(people, id, money)", "dtype"), ("Filter(people, lambda r: r['nope'] > 1)", "MissingColumn:"),
    ],
)
def test_errors(tables, call, message):
    with pytest.raises(OperatorError, match=message):
        run_pipeline(tables, call)


def test_answer_mark_is_lost_by_later_operators(tables):
    done = run_pipeline(tables, "Terminate(people)")
    assert done.answer == "people" and run_pipeline(done, "Filter(people, lambda r: r['id'] > 1)").answer is None


def test_transpose_of_many_rows(spark, monkeypatch):
    """Columns put together from several chunks; no row of the table in the plan, and none collected."""
    from millrace.operators.reshaping import Transpose, unique_names

    monkeypatch.setattr(Transpose, "CHUNK", 100)
    df = spark.range(0, 250).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE id / 2 END AS half", "'h' || (id % 200) AS name", "id % 2 = 0 AS even").repartition(3)
    t = TableSet([make_table(spark, "t", df)])
    made = Transpose().apply(t.replace(t["t"].with_df(t["t"].df.withColumn("__oid", F.col("id")), (("__oid", False),))), table="t", header="name")["t"]
    first, second, third = made.ordered().collect()
    assert made.columns[:3] == ["column", "h49", "h48"] and len(made.columns) == 251 and made.columns[-50] == "h49_2"
    assert (first["column"], second["column"], third["column"]) == ("id", "half", "even")
    assert list(first)[1:] == [str(i) for i in range(249, -1, -1)] and list(third)[1:3] == ["False", "True"]
    assert list(second)[1:] == [None if i % 7 == 0 else str(i / 2) for i in range(249, -1, -1)]
    assert "LocalTableScan" not in made.df._jdf.queryExecution().optimizedPlan().toString()
    numbers = Transpose().apply(TableSet([make_table(spark, "n", spark.range(300))]), table="n")["n"]
    assert numbers.columns[1:] == [str(i) for i in range(300)] and sorted(numbers.ordered().first()[1:]) == list(range(300))
    empty = Transpose().apply(TableSet([make_table(spark, "n", spark.range(0).selectExpr("id", "id AS b"))]), table="n")["n"]
    assert [tuple(r) for r in empty.ordered().collect()] == [("id",), ("b",)]
    alone = Transpose().apply(TableSet([make_table(spark, "n", spark.range(2))]), table="n", header="id")["n"]
    assert sorted(alone.columns) == ["0", "1", "column"] and alone.visible.count() == 0
    with pytest.raises(OperatorError, match="StateTooLarge"):
        Transpose().apply(TableSet([make_table(spark, "n", spark.range(30))]), table="n", limit=20)
    many = TableSet([make_table(spark, "n", spark.range(6_000).selectExpr("id", "'n' || id AS name").repartition(3))])
    tall = run_pipeline(many, "Sort(n, [id])\nTranspose(n)\nStack(n, [column])")["n"]
    got = [tuple(r) for r in tall.ordered().collect()]
    assert got == [x for i in range(6_000) for x in (("id", str(i), str(i)), ("name", str(i), f"n{i}"))]
    named = run_pipeline(many, "Sort(n, [id], ascending=False)\nTranspose(n, header=name)\nStack(n, [column], value_name=v)")["n"]
    assert named.columns == ["column", "variable", "v"] and [tuple(r) for r in named.ordered().head(2)] == [("id", "n5999", 5999), ("id", "n5998", 5998)]
    with pytest.raises(OperatorError, match="StateTooLarge"):
        run_pipeline(many, "Transpose(n)")["n"].columns  # noqa: B018
    twice = TableSet([make_table(spark, "n", spark.createDataFrame([("a", 1), ("a", 2), ("column", 3), (None, 4)], "h string, v int").coalesce(1))])
    assert sorted(tuple(r)[1:] for r in run_pipeline(twice, "Transpose(n, header=h)\nStack(n, [column])")["n"].visible.collect()) == [("None", 4), ("a", 1), ("a_2", 2), ("column_2", 3)]
    with pytest.raises(OperatorError, match="no columns are left"):
        run_pipeline(TableSet([make_table(spark, "n", spark.range(0))]), "Transpose(n)\nStack(n, [column])")
    assert unique_names(["a", "a_2", "a", "a"]) == ["a", "a_2", "a_3", "a_4"] and len(set(unique_names(["x"] * 60_000))) == 60_000
