"""Queries and their SQL for joins on order and inequality, windows and grouping sets, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.relational.aggregates import Aggregator, aggregate_by
from millrace.relational.asof import as_of_join
from millrace.relational.groupings import cube, grouping_sets, rollup
from millrace.relational.inequality import inequality_join
from millrace.relational.intervals import interval_join
from millrace.relational.windows import ranked, rolling, running, shifted

_QUERIES: dict[str, tuple[Callable[..., DataFrame], str]] = {}


def _query(sql: str):
    """Registers a function of the tables that its parameters name."""

    def known(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return known


#: Lines in an order that is their own.
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_L = ", ".join(_LINE)
#: Errors, each a span of as many minutes as its value; the first covers all times.
_SPANS = """SELECT event_id, CASE WHEN first THEN ts - INTERVAL 400 DAYS ELSE ts END AS a, CASE WHEN first THEN ts + INTERVAL 800 DAYS ELSE ts + INTERVAL 1 MINUTE * CAST(floor(value) AS INTEGER) END AS b
  FROM (SELECT *, event_id = min(event_id) OVER () AS first FROM events WHERE event_type = 'error') e"""


@_query(f"SELECT s.event_id AS span_id, p.event_id AS event_id FROM ({_SPANS}) s JOIN events p ON p.event_type = 'purchase' AND s.a <= p.ts AND p.ts <= s.b")
def interval_join_events(events: DataFrame) -> DataFrame:
    """Purchases within spans of minutes, one of which covers all."""
    errors = events.where("event_type = 'error'")
    first = F.col("event_id") == F.lit(errors.agg(F.min("event_id")).first()[0])
    spans = errors.select(
        F.col("event_id").alias("span_id"),
        F.when(first, F.expr("ts - interval 400 days")).otherwise(F.col("ts")).alias("a"),
        F.when(first, F.expr("ts + interval 800 days")).otherwise(F.expr("ts + make_dt_interval(0, 0, cast(floor(value) as int), 0)")).alias("b"),
    )
    points = events.where("event_type = 'purchase'").select("event_id", "ts")
    return interval_join(spans, points, ("a", "b"), ("ts", "ts")).select("span_id", "event_id")


@_query("""SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  AND o_orderdate - INTERVAL 400 DAYS <= l_shipdate AND l_shipdate <= o_orderdate + INTERVAL 400 DAYS""")
def interval_join_keyed(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Lines shipped within 400 days of their order's date."""
    spans = orders.select("o_orderkey", F.expr("o_orderdate - interval 400 days").alias("a"), F.expr("o_orderdate + interval 400 days").alias("b"))
    lines = lineitem.select(*_LINE, "l_shipdate")
    found = interval_join(spans, lines, ("a", "b"), ("l_shipdate", "l_shipdate"), [("o_orderkey", "l_orderkey")])
    return found.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@_query("SELECT a.p_partkey AS small, b.p_partkey AS large FROM part a JOIN part b ON a.p_retailprice < b.p_retailprice AND a.p_size - 45 >= b.p_size")
def inequality_join_parts(part: DataFrame) -> DataFrame:
    """Parts much larger than dearer ones."""
    a = part.select(F.col("p_partkey").alias("small"), "p_retailprice", (F.col("p_size") - 45).alias("low"))
    b = part.select(F.col("p_partkey").alias("large"), F.col("p_retailprice").alias("price"), "p_size")
    return inequality_join(a, b, [("p_retailprice", "<", "price"), ("low", ">=", "p_size")]).select("small", "large")


@_query("""SELECT a.event_id AS event_id, b.event_id AS next_id FROM events a JOIN events b ON a.event_type = 'error' AND b.event_type = 'purchase'
  AND a.ts < b.ts AND a.ts + INTERVAL 1 MINUTE * CAST(floor(a.value) AS INTEGER) > b.ts""")
def inequality_join_times(events: DataFrame) -> DataFrame:
    """Purchases that follow an error within its minutes: both comparisons along one column, so few blocks meet."""
    errors = events.where("event_type = 'error'").select("event_id", "ts", F.expr("ts + make_dt_interval(0, 0, cast(floor(value) as int), 0)").alias("until"))
    bought = events.where("event_type = 'purchase'").select(F.col("event_id").alias("next_id"), F.col("ts").alias("then"))
    return inequality_join(errors, bought, [("ts", "<", "then"), ("until", ">", "then")]).select("event_id", "next_id")


_ASOF = "SELECT e.event_id AS event_id, {value} FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON {on}"


def _sides(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("then"), "value", F.col("event_id").alias("bought"))
    return events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought


@_query(_ASOF.format(value="p.event_id AS bought, p.value AS value", on="e.user_id = p.user_id AND e.ts >= p.ts"))
def as_of_backward(events: DataFrame) -> DataFrame:
    """Each user's last purchase before their other events."""
    found = as_of_join(*_sides(events), "ts", "then", [("user_id", "user_id")], ties=["bought"])
    return found.select("event_id", "bought", "value")


@_query(_ASOF.format(value="p.event_id AS bought, p.value AS value", on="e.user_id = p.user_id AND e.ts <= p.ts"))
def as_of_forward(events: DataFrame) -> DataFrame:
    """Each user's next purchase."""
    found = as_of_join(*_sides(events), "ts", "then", [("user_id", "user_id")], "forward", ties=["bought"])
    return found.select("event_id", "bought", "value")


@_query(_ASOF.format(value="CASE WHEN p.ts >= e.ts - INTERVAL 20 MINUTES THEN p.event_id END AS bought", on="e.ts >= p.ts"))
def as_of_tolerance(events: DataFrame) -> DataFrame:
    """The last purchase of anyone, at most 20 minutes before: no key at all."""
    found = as_of_join(*_sides(events), "ts", "then", tolerance="20 minutes", ties=["bought"])
    return found.select("event_id", "bought")


@_query("""WITH h AS (SELECT event_id, ts, value, event_type, CASE WHEN event_id % 10 < 8 THEN -1 ELSE user_id END AS u FROM events)
  SELECT e.event_id AS event_id, p.event_id AS bought FROM (SELECT * FROM h WHERE event_type <> 'purchase') e ASOF JOIN (SELECT * FROM h WHERE event_type = 'purchase') p ON e.u = p.u AND e.ts >= p.ts""")
def as_of_hot_key(events: DataFrame) -> DataFrame:
    """A key that holds eight tenths of the rows; rows without a match go."""
    hot = events.withColumn("user_id", F.when(F.col("event_id") % 10 < 8, -1).otherwise(F.col("user_id")))
    found = as_of_join(*_sides(hot), "ts", "then", [("user_id", "user_id")], how="inner", ties=["bought"])
    return found.select("event_id", "bought")


@_query(f"""SELECT {_L}, round(sum(l_quantity) OVER w, 4) AS quantity, count(*) OVER w AS lines, max(l_extendedprice) OVER w AS dearest, round(avg(l_quantity) OVER w, 6) AS mean
  FROM lineitem WINDOW w AS (ORDER BY {_L} ROWS UNBOUNDED PRECEDING)""")
def window_running(lineitem: DataFrame) -> DataFrame:
    """Running aggregates over the whole table, as one sequence."""
    got = running(lineitem, [], _LINE, {
        "quantity": ("sum", "l_quantity"), "lines": ("count", F.lit(1)), "dearest": ("max", "l_extendedprice"), "mean": ("mean", "l_quantity")
    })
    return got.select(*_LINE, F.round("quantity", 4).alias("quantity"), "lines", "dearest", F.round("mean", 6).alias("mean"))


@_query(f"""SELECT {_L}, min(l_extendedprice) OVER w AS low, max(l_extendedprice) OVER w AS high, round(sum(l_quantity) OVER w, 4) AS quantity
  FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate, {_L} ROWS BETWEEN 50 PRECEDING AND 10 FOLLOWING)""")
def window_rolling(lineitem: DataFrame) -> DataFrame:
    """Rolling aggregates of 61 lines by return flag, of which there are three."""
    got = rolling(lineitem, ["l_returnflag"], ["l_shipdate", *_LINE], {
        "low": ("min", "l_extendedprice"), "high": ("max", "l_extendedprice"), "quantity": ("sum", "l_quantity")
    }, 50, 10)
    return got.select(*_LINE, "low", "high", F.round("quantity", 4).alias("quantity"))


@_query(f"""SELECT {_L}, min(l_extendedprice) OVER w AS low, count(l_tax) OVER w AS lines
  FROM lineitem WINDOW w AS (ORDER BY l_shipdate, {_L} ROWS BETWEEN 3000 PRECEDING AND 1000 FOLLOWING)""")
def window_wide(lineitem: DataFrame) -> DataFrame:
    """Frames of 4,001 lines, made of running aggregates of chunks as long."""
    got = rolling(lineitem.select(*_LINE, "l_shipdate", "l_tax"), [], ["l_shipdate", *_LINE], {"low": ("min", "l_extendedprice"), "lines": ("count", "l_tax")}, 3000, 1000, wide=4000)
    return got.select(*_LINE, "low", "lines")


@_query(f"SELECT {_L}, lag(l_partkey) OVER w AS last, lead(l_partkey, 3) OVER w AS third FROM lineitem WINDOW w AS (PARTITION BY l_linestatus ORDER BY l_shipdate DESC, {_L})")
def window_shifted(lineitem: DataFrame) -> DataFrame:
    """The part of the line before and of the third behind, by line status, of which there are two."""
    return shifted(lineitem, ["l_linestatus"], ["-l_shipdate", *_LINE], {"last": ("l_partkey", 1), "third": ("l_partkey", -3)}).select(*_LINE, "last", "third")


@_query(f"SELECT {_L}, rank() OVER w AS rank, dense_rank() OVER w AS dense FROM lineitem WINDOW w AS (ORDER BY l_quantity DESC)")
def window_ranked(lineitem: DataFrame) -> DataFrame:
    """Ranks over the whole table with long ties."""
    return ranked(lineitem.select(*_LINE, "l_quantity"), [], ["-l_quantity"], {"rank": "rank", "dense": "dense_rank"}).select(*_LINE, "rank", "dense")


_SUMS = """count(*) AS lines, count(l_tax) AS taxed, round(sum(l_quantity), 4) AS quantity, min(l_extendedprice) AS cheapest, max(l_extendedprice) AS dearest,
  round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd"""
_WANTED = {
    "lines": ("size", None), "taxed": ("count", "l_tax"), "quantity": ("sum", "l_quantity"), "cheapest": ("min", "l_extendedprice"),
    "dearest": ("max", "l_extendedprice"), "mean": ("mean", "l_quantity"), "sd": ("std", "l_quantity"),
}


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in (("quantity", 4), ("mean", 6), ("sd", 6))})


#: Some flags are missing, so groups of a missing key stand beside totals.
_FLAGS = "(SELECT * REPLACE (CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag) FROM lineitem)"


@_query(f"""SELECT l_returnflag, l_linestatus, l_linenumber, {_SUMS}, CAST(GROUPING_ID(l_returnflag, l_linestatus, l_linenumber) AS BIGINT) AS grouping_id
  FROM {_FLAGS} t GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)""")
def grouping_cube(lineitem: DataFrame) -> DataFrame:
    """All selections of three keys."""
    lines = lineitem.withColumn("l_returnflag", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_returnflag")))
    return _rounded(cube(lines, ["l_returnflag", "l_linestatus", "l_linenumber"], _WANTED))


@_query(f"""SELECT l_suppkey, l_shipdate, {_SUMS}, CAST(GROUPING_ID(l_suppkey, l_shipdate) AS BIGINT) AS grouping_id
  FROM lineitem GROUP BY ROLLUP (l_suppkey, l_shipdate)""")
def grouping_rollup(lineitem: DataFrame) -> DataFrame:
    """Suppliers' days, suppliers, and all."""
    return _rounded(rollup(lineitem, ["l_suppkey", "l_shipdate"], _WANTED))


@_query(f"""SELECT l_returnflag, l_linestatus, l_linenumber, {_SUMS}, CAST(GROUPING_ID(l_returnflag, l_linestatus, l_linenumber) AS BIGINT) AS grouping_id
  FROM {_FLAGS} t GROUP BY GROUPING SETS ((l_returnflag, l_linenumber), (l_linestatus), ())""")
def grouping_sets_chosen(lineitem: DataFrame) -> DataFrame:
    """Sets none of which holds all keys."""
    lines = lineitem.withColumn("l_returnflag", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_returnflag")))
    got = grouping_sets(lines, [["l_returnflag", "l_linenumber"], ["l_linestatus"], []], _WANTED)
    # Keys are numbered as they first appear: flag, number, status; the SQL's are flag, status, number.
    i = F.col("grouping_id")
    bits = F.shiftleft(F.getbit(i, F.lit(2)), 2) + F.shiftleft(F.getbit(i, F.lit(0)), 1) + F.getbit(i, F.lit(1))
    return _rounded(got.withColumn("grouping_id", bits.cast("long")))


@_query("""SELECT g, round(list_sum(list_slice(list_reverse_sort(list_distinct(list(l_extendedprice))), 1, 3)), 4) AS top, count(*) AS n
  FROM (SELECT CASE WHEN l_orderkey % 10 < 8 THEN 'hot' WHEN l_returnflag <> 'A' THEN l_returnflag END AS g, l_extendedprice FROM lineitem) t GROUP BY g""")
def aggregate_by_hot(lineitem: DataFrame) -> DataFrame:
    """The sum of the three highest different prices, by labels of which one holds eight tenths of the lines."""
    top = Aggregator(list, lambda s, v: sorted({*s, *(x for x in v if x is not None)})[-3:], lambda a, b: sorted({*a, *b})[-3:], lambda s: float(sum(s)) if s else None, "double")
    count = Aggregator(int, lambda s, v: s + len(v), lambda a, b: a + b, lambda s: s, "long")
    lines = lineitem.withColumn("g", F.when(F.col("l_orderkey") % 10 < 8, "hot").when(F.col("l_returnflag") != "A", F.col("l_returnflag")))
    return aggregate_by(lines, ["g"], {"top": (top, "l_extendedprice"), "n": (count, "l_extendedprice")}).withColumn("top", F.round("top", 4))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(f):
        names = f.__code__.co_varnames[: f.__code__.co_argcount]
        return lambda spark, sf_dir: f(*[spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names])

    return {n: bound(f) for n, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in _QUERIES.items()}
