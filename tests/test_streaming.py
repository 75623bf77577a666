"""Windows over streams against the batch result and plain loops; late rows; operators on streams."""

import datetime as dt
import random
from collections import Counter

import pytest

from millrace.errors import OperatorError
from millrace.streaming import run_on_stream
from millrace.streaming.windows import read_files, run_over_files, windowed

START = dt.datetime(2024, 5, 1)
WANTED = {"n": ("count", "id"), "total": ("sum", "v"), "low": ("min", "v"), "mean": ("mean", "v")}


def written(spark, folder, files):
    """One Parquet file for each list of (id, minute, key, value), in turn."""
    for rows in files:
        made = [(i, None if m is None else START + dt.timedelta(minutes=m), k, v) for i, m, k, v in rows]
        spark.createDataFrame(made, "id long, t timestamp, k string, v long").coalesce(1).write.mode("append").parquet(str(folder))
    return read_files(spark, str(folder))


def events(n=300, seed=1):
    rng = random.Random(seed)
    return [(i, rng.randrange(600), rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize("how", [{"size": "1 hour"}, {"size": "2 hours", "slide": "30 minutes", "keys": ["k"]}, {"gap": "20 minutes", "keys": ["k"]}])
def test_out_of_order_files_equal_the_batch(spark, tmp_path, how):
    """Rows in any order within the delay: the stream's windows are the batch's, but for those still open."""
    rows = events()
    stream = written(spark, tmp_path / "in", [rows[a : a + 75] for a in range(0, 300, 75)])
    got = run_over_files(windowed(stream, "t", WANTED, delay="11 hours", **how))
    assert got.late == 0 and got.read == 300 and got.batches >= 4
    assert got.rows.count() == 0  # all windows are younger than the delay
    # A later row closes them all.
    written(spark, tmp_path / "in", [[(999, 100_000, "z", 1)]])
    got = run_over_files(windowed(read_files(spark, str(tmp_path / "in")), "t", WANTED, delay="11 hours", **how))
    batch = windowed(spark.read.parquet(str(tmp_path / "in")), "t", WANTED, **how).where("window_end < timestamp'2024-06-01'")
    assert got.rows.count() > 5 and Counter(map(tuple, got.rows.collect())) == Counter(map(tuple, batch.collect()))


def test_late_rows_are_left_out_and_counted(spark, tmp_path):
    files = [[(1, 5, "a", 1), (2, 65, "a", 2)], [(3, 300, "a", 3)], [(8, 301, "a", 0)], [(4, 10, "a", 100), (5, 310, "a", 5), (6, None, "a", 7)], [(7, 1000, "b", 1)]]
    got = run_over_files(windowed(written(spark, tmp_path / "in", files), "t", {"n": ("count", "id"), "v": ("sum", "v")}, "1 hour", delay="1 hour"))
    assert got.late == 1 and got.read == 8
    found = {(r.window_start - START).seconds // 3600: (r.n, r.v) for r in got.rows.collect()}
    assert found == {0: (1, 1), 1: (1, 2), 5: (3, 8)}


def test_windows_of_tables_odd_rows_and_names(spark):
    rows = [(1, START, None, 1), (1, START, None, 1), (2, None, "a", 5), (3, START + dt.timedelta(minutes=59, seconds=59), "a", None)]
    df = spark.createDataFrame(rows, "id long, `the time` timestamp_ntz, `a0` string, v long")
    got = windowed(df, "the time", {"n": ("count", "id"), "v": ("sum", "v")}, "1 hour", keys=["a0"]).collect()
    assert {(r.a0, r.n, r.v) for r in got} == {(None, 2, 2), ("a", 1, None)}
    assert windowed(df.limit(0), "the time", {"n": ("count", "id")}, gap="1 hour").count() == 0
    for wrong in ({}, {"size": "1 hour", "gap": "1 hour"}, {"gap": "1 hour", "slide": "1 hour"}):
        with pytest.raises(OperatorError, match="size"):
            windowed(df, "the time", {}, **wrong)
    with pytest.raises(OperatorError, match="unknown aggregates"):
        windowed(df, "the time", {"x": ("median", "v")}, "1 hour")
    with pytest.raises(OperatorError, match="one name"):
        windowed(df, "the time", {"a0": ("sum", "v")}, "1 hour", keys=["a0"])


def test_operators_on_streams(spark, tmp_path):
    stream = written(spark, tmp_path / "in", [[(1, 0, "x,y", 1), (2, 1, None, None)], [(3, 2, "z", 3)]])
    names = spark.createDataFrame([(1, "one"), (3, "three")], "id long, name string")
    run = lambda text, **others: run_over_files(run_on_stream(stream, "s", text, others)).rows
    assert sorted((r.id, r.k) for r in run("Explode(s, k, sep=',')\nDropNA(s, [k])").collect()) == [(1, "x"), (1, "y"), (3, "z")]
    assert sorted((r.id, r.v or "") for r in run("CastType(s, v, str)").collect()) == [(1, "1"), (2, ""), (3, "3")]
    assert run("Stack(s, [id], [k, v], field, cell)").count() == 6
    assert sorted((r.id, r.name) for r in run("Join(s, n, on=id, how=inner, target=s)", n=names).collect()) == [(1, "one"), (3, "three")]
    again = read_files(spark, str(tmp_path / "in"))
    assert run("Union([s, n], how=all, target=s)", n=again).count() == 6
    for text in ("Sort(s, [v])", "Union([s, s], how=distinct)", "Join(n, s, on=id)", "GroupBy(s, [k], {v: sum})"):
        with pytest.raises(OperatorError, match="whole table"):
            run(text, n=names)
