"""Work along the row order and quantiles, on many partitions, against plain windows and percentiles."""

import random
import threading

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.model import Table, TableSet, make_table
from millrace.operators import quantiles as Q
from millrace.operators.base import strict
from millrace.operators.ordering import ascending_order, before, in_blocks, numbered
from millrace.operators.queries import run_pipeline
from millrace.plans.environment import Environment


@pytest.fixture(scope="module")
def lines(spark):
    """600,000 rows over 64 partitions, a third of the values missing, in an order unlike that of the rows."""
    df = spark.range(0, 600_000, 1, 64).select(
        F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("k"),
        F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) > 0, F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000))).alias("v"),
    )
    return df


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("mode", ["ffill", "bfill"])
def test_fill_equals_a_plain_window(spark, lines, mode, adaptive):
    was = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        order = W.orderBy(F.asc("k") if mode == "ffill" else F.desc("k")).rowsBetween(W.unboundedPreceding, 0)
        want = lines.select("k", F.last("v", True).over(order).alias("w"))
        for _ in range(2):
            got = run_pipeline(TableSet([make_table(spark, "t", lines)]), f"Sort(t, [k])\nMissingValueImputation(t, v, {mode})")["t"].visible
            assert got.join(want, "k").where("not (v <=> w)").count() == 0 and got.count() == 600_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was[0])
        spark.conf.set("spark.sql.shuffle.partitions", was[1])


@pytest.fixture
def small(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(9)]), rng.choice(["a", "b", None]), i, None) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, s string, i long, nothing void").repartition(7)
    return Table("t", df, "", (("k", False), ("s", True), ("i", False)))


@pytest.mark.parametrize("blocks", [1, 5, 40])
def test_numbers_and_rows_before(small, blocks):
    rows = small.df.collect()
    want = [r.i for r in sorted(rows, key=lambda r: (r.k is None, -(r.k or 0), r.s is None, r.s or "", -r.i))]
    got = {r.i: r.n for r in numbered(small, "n", blocks).collect()}
    assert [got[i] for i in want] == list(range(1, 301))
    above = {r.i: r.p for r in before(small, F.col("s"), "p", blocks).collect()}
    text = {r.i: r.s for r in rows}
    assert above[want[0]] is None and all(above[b] == text[a] for a, b in zip(want, want[1:], strict=False))
    assert in_blocks(small, True, blocks).count() == 300


def test_ascending_orders_mirror_descending_ones(spark, small):
    want = [r.i for r in small.df.orderBy(*small.sort_keys()).collect()]
    up = ascending_order(small)
    assert all(x for _, x in up.order) and [r.i for r in up.df.orderBy(*up.sort_keys()).collect()] == want
    texts = Table("t", small.df, "", (("s", False), ("i", True)))
    want = [r.i for r in texts.df.orderBy(*texts.sort_keys()).collect()]
    up = ascending_order(texts)
    assert [r.i for r in up.df.orderBy(*up.sort_keys()).collect()] == want


@pytest.mark.parametrize("most", [0, Q.MOST])
def test_quantiles_of_groups_of_any_size(spark, most):
    df = spark.range(0, 20_000, 1, 6).select(
        F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        (F.pmod(F.xxhash64("id"), F.lit(700)) / 8.0).alias("x"),
    )
    df = df.union(spark.createDataFrame([("empty", None), ("one", 3.5)], "g string, x double"))
    got = {r.g: (r.a, r.b) for r in Q.group_quantiles(df, ["g"], F.col("x"), [0.5, 0.9], ["a", "b"], most).collect()}
    want = {r.g: tuple(r.q) for r in df.groupBy("g").agg(F.percentile("x", [0.5, 0.9]).alias("q")).collect() if r.q}
    assert got.keys() == want.keys()
    assert all(a == pytest.approx(b) for k in got for a, b in zip(got[k], want[k], strict=True))
    whole = df.agg(F.percentile("x", [0.25, 0.75])).head()[0]
    assert Q.quantiles(df, F.col("x"), [0.25, 0.75], most) == pytest.approx(whole)
    assert Q.quantiles(df.limit(0), F.col("x"), [0.5], most) is None
    assert Q.most_frequent(spark.createDataFrame([(2,), (1,), (2,), (1,), (None,), (None,), (None,)], "v int"), F.col("v")) == 1


def test_checks_of_one_thread_stay_on_while_another_ends(spark):
    """The environment's checks belong to its own thread."""
    seen, go, done = [], threading.Event(), threading.Event()

    class Slow(Environment):
        def _step(self, state, call):
            go.set()
            done.wait(20)
            seen.append(strict())
            return state

    t = TableSet([make_table(spark, "t", spark.range(2))])
    slow = threading.Thread(target=lambda: Slow().execute(t, "DropNA(t)"))
    slow.start()
    go.wait(20)
    Environment().execute(t, "DropNA(t)")
    done.set()
    slow.join()
    assert seen == [True] and strict() is False


def test_types_of_results_come_from_all_rows(spark, monkeypatch):
    monkeypatch.setenv("MILLRACE_ALLOW_PYTHON", "1")
    t = TableSet([make_table(spark, "t", spark.range(0, 1000, 1, 4))])
    odd = "lambda r: int('7') if r['id'] < 900 else (0.5 if r['id'] < 950 else None)"
    made = run_pipeline(t, f"AddNewColumn(t, x, {odd})")["t"].visible
    assert made.schema["x"].dataType.simpleString() == "double" and made.where("x = 0.5").count() == 50
    mixed = run_pipeline(t, "AddNewColumn(t, x, lambda r: int('7') if r['id'] < 900 else 'many')")["t"].visible
    assert {r.x for r in mixed.collect()} == {"7", "many"}


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from millrace import session

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session)
