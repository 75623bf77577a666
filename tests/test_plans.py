import sqlite3
import threading

import pytest
from fixtures import rows, simple
from pyspark.sql import functions as F

from millrace.metrics import MatchOptions, Price, api_cost, gpu_cost, partial_similarity, table_match
from millrace.model import TableSet, make_table
from millrace.plans.environment import Environment, Limits, ReasoningTree, canonical, render_feedback
from millrace.plans.sql import TranslationError, execute_pipeline, join_keys, search_pipeline, translate
from millrace.sources.sqlite import load_benchmark, load_sources, read_table, run_sql, run_sqlite

CONCERTS = {
    "singer": ("id INTEGER PRIMARY KEY, name TEXT, country TEXT, age INTEGER, debut TEXT", [
        (1, "Ana", "France", 30, "2001-05-01"), (2, "Bo", "Spain", 41, "1999-01-31"), (3, "Cy", "France", 52, "1985-07-07"),
        (4, "Di", "Italy", 23, "2015-11-20"), (5, "Ed", None, 41, "2003-02-14")]),
    "concert": ("cid INTEGER PRIMARY KEY, singer_id INTEGER REFERENCES singer(id), city TEXT, year INTEGER, revenue REAL", [
        (1, 1, "Paris", 2019, 100.5), (2, 1, "Lyon", 2020, 50.0), (3, 2, "Madrid", 2019, 75.25), (4, 3, "Paris", 2021, 300.0),
        (5, 3, "Nice", 2019, 20.0), (6, 4, "Rome", 2020, 60.0), (7, 2, "Paris", 2020, 80.0)]),
}
QUERIES = [
    "SELECT name, age FROM singer WHERE age > 30", "SELECT * FROM singer", "SELECT DISTINCT country FROM singer ORDER BY country",
    "SELECT name FROM singer ORDER BY age DESC LIMIT 1", "SELECT city, COUNT(*) FROM concert GROUP BY city", "SELECT AVG(age) FROM singer",
    "SELECT MIN(age), MAX(age) FROM singer", "SELECT COUNT(DISTINCT country) FROM singer", "SELECT COUNT(*) FROM concert WHERE year = 2019",
    "SELECT name FROM singer WHERE country IN ('France', 'Italy') AND name LIKE '%i%'", "SELECT name FROM singer WHERE age BETWEEN 30 AND 41",
    "SELECT singer.name, concert.city FROM singer JOIN concert ON singer.id = concert.singer_id",
    "SELECT s.name, c.year FROM singer AS s, concert AS c WHERE s.id = c.singer_id AND c.revenue >= 60",
    "SELECT s.name, SUM(c.revenue) AS total FROM singer s JOIN concert c ON s.id = c.singer_id GROUP BY s.name",
    "SELECT city, SUM(revenue) FROM concert GROUP BY city HAVING COUNT(*) > 1",
    "SELECT year, COUNT(*) FROM concert GROUP BY year ORDER BY COUNT(*) DESC, year", "SELECT name FROM singer WHERE NOT (age < 30 OR country IS NULL)",
    "SELECT name FROM singer WHERE country != 'France'", "SELECT country, AVG(age), COUNT(*) FROM singer GROUP BY country",
    "SELECT name AS n, debut AS d FROM singer WHERE debut < '2000-01-01' ORDER BY 2",
]


@pytest.fixture(scope="module")
def concerts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "concerts.sqlite")
    db = sqlite3.connect(path)
    for name, (columns, data) in CONCERTS.items():
        db.execute(f"CREATE TABLE {name} ({columns})")
        db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(data[0]))})", data)
    db.commit()
    db.close()
    return path, load_sources(spark, path)


@pytest.mark.parametrize("sql", QUERIES)
def test_translated_queries_equal_sqlite(spark, concerts, sql):
    path, tables = concerts
    names, want = run_sqlite(path, sql)
    for pipeline in translate(sql, tables):
        made = execute_pipeline(tables, pipeline)
        assert sorted(map(repr, rows(made))) == sorted(repr(tuple(r)) for r in want), pipeline
    if "ORDER BY" in sql:
        # Sort puts missing values last, SQLite first.
        last = sorted(want, key=lambda r: None in r)
        assert rows(execute_pipeline(tables, translate(sql, tables)[0])) == last
    assert search_pipeline(sql, tables, run_sql(spark, tables, sql)) is not None and names


@pytest.mark.parametrize(
    "sql",
    ["SELECT name FROM singer WHERE id IN (SELECT singer_id FROM concert)", "SELECT name FROM singer UNION SELECT city FROM concert",
     "SELECT CASE WHEN age > 3 THEN 1 END FROM singer", "SELECT a.name FROM singer a JOIN singer b ON a.id = b.id", "SELECT name, name FROM singer",
     "SELECT s.name FROM singer s LEFT JOIN concert c ON s.id = c.singer_id", "SELECT UPPER(name) FROM singer", "SELECT nope FROM singer",
     "SELECT name, COUNT(*) FROM singer GROUP BY country", "SELECT age + 1 FROM singer"],
)
def test_refused(concerts, sql):
    with pytest.raises(TranslationError):
        translate(sql, concerts[1])


def test_sqlite_source(spark, concerts, monkeypatch):
    path, tables = concerts
    assert tables.names == ["singer", "concert"]
    assert "Primary key" in tables["singer"].schema.get("id").description and "referencing singer.id" in tables["concert"].schema.get("singer_id").description
    monkeypatch.setattr("millrace.sources.sqlite.RANGE", 2)
    assert rows(read_table(spark, path, "concert")) == CONCERTS["concert"][1]
    with pytest.raises(sqlite3.OperationalError):
        sqlite3.connect(f"file:{path}?mode=ro", uri=True).execute("DELETE FROM singer")
    assert join_keys("SELECT a.x FROM a JOIN b ON a.k = b.j") == {"k", "j"}


def test_benchmark_records(tmp_path):
    p = tmp_path / "b.json"
    p.write_text('[{"db_id": "a", "question": "q", "query": "SELECT 1;"}, {"db_id": "b", "question": "q"}, {"db_id": "b", "SQL": "x", "question_id": 7}]')
    assert [(q.db_id, q.query, q.question_id) for q in load_benchmark(str(p))] == [("a", "SELECT 1", "0"), ("b", "x", "7")]
    assert len(load_benchmark(str(p), limit=1)) == 1 and load_benchmark(str(p), db_ids=["b"])[0].query == "x"


def test_environment(spark):
    tables = simple(spark)
    env = Environment()
    r = env.execute(tables, "Deduplicate(people, [id])\nDropNA(people, [nope])\nCount(people)")
    assert len(r.applied) == 1 and r.error.startswith("DropNA: MissingColumn:") and r.failed.startswith("DropNA")
    told = render_feedback(r)
    assert "OK Deduplicate" in told and "FAILED DropNA" in told and "| id |" in told
    assert env.execute(tables, "nothing here").error.startswith("EmptyPipeline:")
    assert env.execute(tables, "Nope(people)").error.startswith("ParseError:")
    assert Environment(Limits(operators=1)).execute(tables, "Count(people)\nCount(depts)").error.startswith("TooManyOperators:")
    k = ([(1,)] * 400, "k long")
    big = TableSet.of(spark, a=k, b=k)
    assert "StateTooLarge:" in Environment(Limits(rows=1000)).execute(big, "Join(a, b, on=k)").error
    empty = TableSet.of(spark, a=([("x",)], "k string"), b=([("y",)], "k string"))
    assert "EmptyResult:" in env.execute(empty, "Join(a, b, on=k)").error
    assert "no numeric" in env.execute(empty, "MissingValueImputation(a, k)").error


def test_timeout_from_any_thread(spark):
    tables = TableSet([make_table(spark, "t", spark.range(0, 10**11).withColumn("v", F.rand(1)))])
    out = []
    run = lambda: out.append(Environment(Limits(timeout=2)).execute(tables, "MissingValueImputation(t, v, mean)"))
    thread = threading.Thread(target=run)
    thread.start()
    thread.join(60)
    assert out and out[0].error.startswith("Timeout:")


def test_tree(spark):
    env, tree = Environment(), ReasoningTree(simple(spark))
    a = tree.expand(tree.root, env.execute(tree.root.state, "Deduplicate(people, [id])\nDropNA(people, [salary])"))
    assert [n.id for n in a] == ["n1", "n2"]
    b = tree.expand(a[0], env.execute(a[0].state, "Deduplicate(people, keep='first', subset=['id'])\nNope2(people)"))
    assert b[-1].error.startswith("ParseError") and b[-1].state is None
    again = tree.expand(tree.root, env.execute(tree.root.state, "Deduplicate(people, subset=id)"))
    assert again == [a[0]]
    assert tree.resolve("Deduplicate(people,[id])\nDropNA(people,  salary)") == (a[1], None)
    assert tree.resolve("n2")[0] is a[1] and tree.resolve("n99")[1].startswith("UnknownNode:")
    node, told = tree.resolve("Deduplicate(people,[name])\nDropNA(people, [id])")
    assert node is a[1] and told.startswith("InexactPrefix:")
    assert tree.resolve("Deduplicate(people,[id])\nCount(people)")[1].startswith("PrefixMismatch:")
    assert "n2 DropNA" in tree.render() and "FAILED" in tree.render()
    assert canonical("DropNA( people )") == canonical("DropNA(people, how='any')")
    tree.expand(a[0], env.execute(a[0].state, "Count(people)"))  # a second child: the state is kept
    assert tree.kept and all(df.storageLevel.useMemory for df in tree.kept)
    held = list(tree.kept)
    with tree:
        pass
    assert not tree.kept and not any(df.storageLevel.useMemory for df in held) and a[0].state["people"].df.count() == 4


def test_table_match(spark):
    f = lambda data, ddl="a long, b string": spark.createDataFrame(data, ddl)
    base = f([(1, "x"), (2, None), (2, None)])
    assert table_match(base, f([(2, None), (1, " x "), (2, None)])) and table_match(base, base.select("b", "a"))
    assert not table_match(base, f([(1, "x"), (2, None)])) and not table_match(base, f([(1, "x"), (1, "x"), (2, None)]))
    assert table_match(base, f([(1.0000000001, "x"), (2.0, None), (2.0, None)], "a double, b string"))
    assert table_match(f([(1, "5")]), f([("1", "5.0")], "a string, b string"))
    assert not table_match(f([("0123",)], "a string"), f([(123,)], "a long")) and not table_match(f([("1_0",)], "a string"), f([(10,)], "a long"))
    renamed = base.toDF("p", "q")
    assert not table_match(base, renamed) and table_match(base, renamed.select("q", "p"), MatchOptions(names=False))
    assert table_match(f([(float("nan"),), (float("inf"),)], "a double"), f([(None,), (float("inf"),)], "a double"))


def test_table_match_tries_pairings_of_equal_columns(spark):
    f = lambda data, ddl: spark.createDataFrame(data, ddl)
    free = MatchOptions(names=False)
    gold = f([(1, 2, 5), (2, 1, 6)], "a int, b int, c int")
    assert table_match(f([(2, 1, 5), (1, 2, 6)], "x int, y int, c int"), gold, free)
    assert table_match(f([(5, 2, 1), (6, 1, 2)], "p int, q int, r int"), gold, free)
    assert not table_match(f([(1, 1, 5), (2, 2, 6)], "x int, y int, c int"), gold, free)
    # Any two columns have the same pairs of values, all three don't.
    even = [(x, y, x ^ y) for x in (0, 1) for y in (0, 1)]
    odd = [(x, y, 1 - (x ^ y)) for x in (0, 1) for y in (0, 1)]
    assert not table_match(f(odd, "x int, y int, z int"), f(even, "a int, b int, c int"), free)
    assert table_match(f(odd, "x int, y int, z int"), f(odd[::-1], "a int, b int, c int"), free)
    equal = "x0 int, x1 int, x2 int, x3 int, x4 int, x5 int, x6 int"
    assert table_match(f([(None,) * 7, (1,) * 7], equal), f([(1,) * 7, (None,) * 7], equal.replace("x", "y")), free)
    assert not table_match(f([(None,) * 7, (1,) * 7], equal), f([(1,) * 6 + (None,), (None,) * 6 + (1,)], equal.replace("x", "y")), free)


def test_similarity_and_costs(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string")
    assert partial_similarity(a, a) == 1.0
    half = partial_similarity(a.withColumnRenamed("b", "c"), a)
    assert half == pytest.approx((1 / 3 + 1 + 1) / 3)
    assert 0 <= partial_similarity(a.limit(0), a) < 0.8
    assert gpu_cost(3600) == 0.91 and api_cost(10**6, 10**6, Price(1.0, 2.0)) == 3.0 and api_cost(10, 0, Price(1e6, 0, 0.0), 10) == 0


def test_sqlite_bounds_and_filters(spark, tmp_path, monkeypatch):
    """Rowids far apart are read in parts of equal size; filters and chosen columns reach SQLite's query."""
    from millrace.sources import sqlite as S

    path = str(tmp_path / "far.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE far (id INTEGER PRIMARY KEY, n INTEGER, x REAL, t TEXT, mixed)")
        rows = [(i, i % 3, i / 2, f"t{i % 4}", i if i % 2 else f"m{i}") for i in range(25)]
        rows += [(1 << 62, 7, None, None, None), (-(1 << 61), None, -1.5, "low", 2.5)]
        db.executemany("INSERT INTO far VALUES (?, ?, ?, ?, ?)", rows)
        db.execute("CREATE TABLE none (a INTEGER)")
        db.execute("CREATE TABLE keyed (a TEXT PRIMARY KEY, b INTEGER) WITHOUT ROWID")
        db.execute("INSERT INTO keyed VALUES ('x', 1), ('y', 2)")
    db.close()
    monkeypatch.setattr(S, "RANGE", 10)
    t = read_table(spark, path, "far")
    assert sorted(r.id for r in t.visible.collect()) == sorted(r[0] for r in rows)
    assert [r.id for r in t.ordered().collect()] == sorted(r[0] for r in rows)
    assert read_table(spark, path, "none").visible.count() == 0 and read_table(spark, path, "keyed").visible.where("b > 1").count() == 1
    for filters, want in [
        ([("n", "=", 1), ("x", ">", 3)], lambda r: r[1] == 1 and r[2] is not None and r[2] > 3), ([("t", "in", ["t1", "low"])], lambda r: r[3] in ("t1", "low")),
        ([("t", ">=", "t2")], lambda r: r[3] is not None and r[3] >= "t2"), ([("mixed", "=", "5")], lambda r: r[4] == 5), ([("mixed", ">", "m")], lambda r: isinstance(r[4], str)),
        ([("x", "is null")], lambda r: r[2] is None), ([("t", "is not null"), ("n", "<=", 1)], lambda r: r[3] is not None and r[1] is not None and r[1] <= 1),
        ([("id", ">", 1_000_000)], lambda r: r[0] > 10**6), ([("n", "<", 1.5)], lambda r: r[1] is not None and r[1] < 1.5),
    ]:
        assert sorted(r.id for r in read_table(spark, path, "far", filters=filters).visible.collect()) == sorted(r[0] for r in rows if want(r)), filters
    some = read_table(spark, path, "far", ["t", "id"], [("id", "=", 3)])
    assert some.columns == ["t", "id"] and some.visible.collect() == [("t3", 3)]
    with pytest.raises(ValueError, match="unknown columns"):
        read_table(spark, path, "far", ["t"], [("id", "=", 3)])
    told = '[["n", "=", 1], ["t", "in", ["a", "b"]], ["t", "is not null"], ["n", ">", 1180591620717411303424]]'
    reader = S.SqliteSource({"path": path, "dbtable": "far", "columns": '["n", "t"]', "filters": told})
    reader = reader.reader(reader.schema())
    assert [p.low for p in reader.partitions()] == [-(1 << 61), 9, 19] and reader.partitions()[-1].high is None
    sql, values = reader.query(reader.partitions()[0])
    assert sql.startswith('SELECT "n", "t" FROM "far" WHERE "n" = ? AND (typeof("t") <> \'text\' OR "t" IN (?, ?)) AND "t" IS NOT NULL AND rowid >= ?')
    assert values[:3] == [1, "a", "b"]
