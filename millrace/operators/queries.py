"""A query and its SQL for every operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.functions import fallback
from millrace.model import Table, TableSet, make_table, quoted, read_parquet_table
from millrace.plans.dsl import parse_pipeline

#: name -> (tables, SQL views to make missing values with, pipeline, result table, SQL)
SPECS: dict[str, tuple[list[str], dict[str, str], str, str, str]] = {}


def _spec(name: str, tables: str, pipeline: str, result: str, sql: str, **views: str) -> None:
    SPECS[name] = (tables.split(), views, pipeline, result, sql)


#: Events in which some values are missing.
GAPS = "SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events"

_spec("DropNA", "events", "DropNA(e, [value])", "e", f"SELECT * FROM ({GAPS}) t WHERE value IS NOT NULL", e=GAPS)
_spec("MissingValueImputation_mean", "events", "MissingValueImputation(e, value, mean)\nSelectColumn(e, [event_id, value])", "e",
      f"SELECT event_id, coalesce(value, avg(value) OVER ()) AS value FROM ({GAPS}) t", e=GAPS)
_spec("MissingValueImputation_median", "events", "MissingValueImputation(e, value, median)\nSelectColumn(e, [event_id, value])", "e",
      f"SELECT event_id, coalesce(value, median(value) OVER ()) AS value FROM ({GAPS}) t", e=GAPS)
_spec("MissingValueImputation_mode", "orders", "MissingValueImputation(o, p, mode)", "o",
      """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders),
      m AS (SELECT p AS m FROM o WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1)
      SELECT o_orderkey, coalesce(p, (SELECT m FROM m)) AS p FROM o""",
      o="SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders")
_spec("MissingValueImputation_ffill", "events", "Sort(e, [event_id])\nMissingValueImputation(e, value, ffill)\nSelectColumn(e, [event_id, value])", "e",
      f"SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM ({GAPS}) t", e=GAPS)
_spec("MissingValueImputation_bfill", "events", "Sort(e, [event_id])\nMissingValueImputation(e, value, bfill)\nSelectColumn(e, [event_id, value])", "e",
      f"SELECT event_id, first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM ({GAPS}) t", e=GAPS)
_spec("MissingValueImputation_constant", "events", "MissingValueImputation(e, value, constant, -1.5)", "e",
      f"SELECT event_id, user_id, event_type, coalesce(value, -1.5) AS value FROM ({GAPS}) t", e=GAPS)
_spec("MissingValueImputation_zero", "events", "MissingValueImputation(e, value, zero)", "e",
      f"SELECT event_id, user_id, event_type, coalesce(value, 0) AS value FROM ({GAPS}) t", e=GAPS)
_spec("Deduplicate", "orders", "Sort(orders, [o_orderkey])\nDeduplicate(orders, [o_custkey], first)", "orders",
      "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
_spec("Deduplicate_last", "orders", "Sort(orders, [o_orderkey])\nDeduplicate(orders, [o_custkey], keep=last)\nSelectColumn(orders, [o_custkey, o_orderkey])", "orders",
      "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
_spec("Deduplicate_rows", "lineitem", "SelectColumn(lineitem, [l_returnflag, l_linestatus, l_linenumber])\nDeduplicate(lineitem)", "lineitem",
      "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
_spec("ErrorDetection_flag", "lineitem", "SelectColumn(lineitem, [l_orderkey, l_linenumber, l_discount])\nErrorDetection(lineitem, l_discount, lambda v: v > 0.08)", "lineitem",
      "SELECT l_orderkey, l_linenumber, l_discount, l_discount > 0.08 AS l_discount_is_error FROM lineitem")
_spec("ErrorDetection_remove", "events", "ErrorDetection(e, value, lambda v: v is None or v > 50, action=remove)", "e",
      f"SELECT * FROM ({GAPS}) t WHERE NOT (value IS NULL OR value > 50)", e=GAPS)
_spec("ErrorDetection_null", "events", "ErrorDetection(e, value, lambda v: v > 50, action='null')", "e",
      f"SELECT event_id, user_id, event_type, CASE WHEN value > 50 THEN NULL ELSE value END AS value FROM ({GAPS}) t", e=GAPS)
_BOUNDS = "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)"
_spec("OutlierDetection_iqr", "lineitem", "SelectColumn(lineitem, [l_orderkey, l_linenumber, l_extendedprice])\nOutlierDetection(lineitem, l_extendedprice, flag, iqr, 0.5)", "lineitem",
      f"{_BOUNDS} SELECT l_orderkey, l_linenumber, l_extendedprice, l_extendedprice < a - 0.5 * (b - a) OR l_extendedprice > b + 0.5 * (b - a) AS l_extendedprice_is_outlier FROM lineitem, q")
_spec("OutlierDetection_zscore", "lineitem", "SelectColumn(lineitem, [l_orderkey, l_linenumber, l_quantity])\nOutlierDetection(lineitem, l_quantity, remove, zscore, 1.2)", "lineitem",
      "WITH q AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem, q WHERE NOT (l_quantity < m - 1.2 * s OR l_quantity > m + 1.2 * s)")
_spec("OutlierDetection_clip", "lineitem", "SelectColumn(lineitem, [l_orderkey, l_linenumber, l_extendedprice])\nOutlierDetection(lineitem, l_extendedprice, clip, iqr, 0.25)", "lineitem",
      f"{_BOUNDS} SELECT l_orderkey, l_linenumber, least(greatest(l_extendedprice, a - 0.25 * (b - a)), b + 0.25 * (b - a)) AS l_extendedprice FROM lineitem, q")
_spec("ValueTransform", "part", "ValueTransform(part, p_name, lambda x: str(x).strip().upper())", "part",
      "SELECT p_partkey, upper(trim(p_name)) AS p_name, p_brand, p_type, p_size, p_retailprice FROM part")
_spec("ValueTransform_target", "part", "ValueTransform(part, p_brand, lambda x: x.replace('#', '-').lower(), target=b)\nSelectColumn(part, [p_partkey, b])", "part",
      "SELECT p_partkey, lower(replace(p_brand, '#', '-')) AS b FROM part")
_spec("StandardizeDatetime", "orders", "StandardizeDatetime(o, d, format=%d/%m/%Y, input_format=%Y-%m-%d)", "o",
      "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS d FROM orders", o="SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd') AS d FROM orders")
_spec("StandardizeDatetime_mixed", "orders", "StandardizeDatetime(o, d)", "o", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders",
      o="SELECT o_orderkey, date_format(o_orderdate, CASE o_orderkey % 3 WHEN 0 THEN 'yyyy-MM-dd' WHEN 1 THEN 'MM/dd/yyyy' ELSE 'd MMM yyyy' END) AS d FROM orders")
_spec("CastType_str", "orders", "CastType(orders, o_orderkey, str)\nSelectColumn(orders, [o_orderkey])", "orders", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders")
_spec("CastType_int", "orders", "CastType(o, k, int)", "o", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey AS BIGINT) END AS k FROM orders",
      o="SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE cast(o_orderkey AS string) END AS k FROM orders")
_spec("CastType_float", "lineitem", "CastType(l, q, float)", "l", "SELECT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem",
      l="SELECT l_orderkey, l_linenumber, cast(l_quantity AS string) AS q FROM lineitem")
_spec("CastType_bool", "lineitem", "CastType(l, f, bool)", "l", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN TRUE WHEN 'N' THEN FALSE END AS f FROM lineitem",
      l="SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN ' Yes' WHEN 'N' THEN 'f' ELSE 'maybe' END AS f FROM lineitem")
_spec("RenameColumn", "nation", "RenameColumn(nation, {n_name: n_regionkey, n_regionkey: n_name})", "nation", "SELECT n_nationkey, n_name AS n_regionkey, n_regionkey AS n_name FROM nation")
_spec("AddNewColumn", "lineitem", "AddNewColumn(lineitem, net, lambda r: r['l_extendedprice'] * (1 - r['l_discount']))\nSelectColumn(lineitem, [l_orderkey, l_linenumber, net])", "lineitem",
      "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
_spec("AddNewColumn_case", "lineitem", "AddNewColumn(lineitem, band, lambda r: 'high' if r['l_quantity'] > 40 and r['l_tax'] != 0 else 'low')\nSelectColumn(lineitem, [l_orderkey, l_linenumber, band])", "lineitem",
      "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 AND l_tax <> 0 THEN 'high' ELSE 'low' END AS band FROM lineitem")
_spec("DropColumn", "customer", "DropColumn(customer, [c_acctbal, c_name])", "customer", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
_spec("SplitColumn", "customer", "SplitColumn(customer, c_name, [a, b], sep='#')\nSelectColumn(customer, [c_custkey, a, b])", "customer",
      "SELECT c_custkey, split_part(c_name, '#', 1) AS a, CASE WHEN contains(c_name, '#') THEN split_part(c_name, '#', 2) END AS b FROM customer")
_spec("Concatenate", "part", "Concatenate(part, [p_brand, p_type, p_size], t, sep='-')\nSelectColumn(part, [p_partkey, t])", "part",
      "SELECT p_partkey, p_brand || '-' || p_type || '-' || CAST(p_size AS VARCHAR) AS t FROM part")
_spec("SelectColumn", "supplier", "SelectColumn(supplier, [s_name, s_suppkey])", "supplier", "SELECT s_name, s_suppkey FROM supplier")
_spec("Subtitle", "region", "Subtitle(region, 'the world', scope)", "region", "SELECT r_regionkey, r_name, 'the world' AS scope FROM region")
_spec("Filter", "lineitem", "Filter(lineitem, lambda r: r['l_quantity'] > 45 and not (r['l_returnflag'] == 'A' or r['l_discount'] <= 0.05))", "lineitem",
      "SELECT * FROM lineitem WHERE l_quantity > 45 AND NOT (l_returnflag = 'A' OR l_discount <= 0.05)")
_spec("Filter_null", "events", "Filter(e, lambda r: r['value'] != 10 and r['event_type'] in ('click', 'view', 'purchase'))", "e",
      f"SELECT * FROM ({GAPS}) t WHERE value IS DISTINCT FROM 10 AND event_type IN ('click', 'view', 'purchase')", e=GAPS)
_spec("Sort", "orders", "Sort(orders, [o_orderdate, o_orderkey], ascending=[False, True])", "orders", "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey")
_spec("TopK", "orders", "TopK(orders, 25, [o_totalprice, o_orderkey])", "orders", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
_spec("GroupBy", "lineitem",
      "GroupBy(lineitem, [l_returnflag, l_linestatus], {l_quantity: [sum, mean, min, max, median, std, var, count, nunique], l_orderkey: nunique, l_partkey: size})", "lineitem",
      """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity_sum, avg(l_quantity) AS l_quantity_mean, min(l_quantity) AS l_quantity_min,
      max(l_quantity) AS l_quantity_max, median(l_quantity) AS l_quantity_median, stddev_samp(l_quantity) AS l_quantity_std, var_samp(l_quantity) AS l_quantity_var,
      count(l_quantity) AS l_quantity_count, count(DISTINCT l_quantity) AS l_quantity_nunique, count(DISTINCT l_orderkey) AS l_orderkey, count(*) AS l_partkey
      FROM lineitem GROUP BY ALL""")
_spec("GroupBy_null_key", "events", "GroupBy(e, [k], {value: sum, event_id: count})", "e",
      "SELECT CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS k, round(sum(value), 4) AS value, count(event_id) AS event_id FROM events GROUP BY 1",
      e="SELECT CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS k, value, event_id FROM events")
_spec("GroupBy_ordered", "orders", "Sort(orders, [o_orderkey])\nGroupBy(orders, [o_orderpriority], {o_custkey: first, o_totalprice: last, o_orderstatus: lambda s: s.nunique()})", "orders",
      "SELECT o_orderpriority, arg_min(o_custkey, o_orderkey) AS o_custkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice, count(DISTINCT o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1")
_spec("GroupBy_list", "nation", "Sort(nation, [n_nationkey])\nGroupBy(nation, [n_regionkey], {n_name: list})\nExplode(nation, n_name)", "nation", "SELECT n_regionkey, n_name FROM nation")
_spec("GroupBy_lambda", "lineitem", "GroupBy(lineitem, [l_shipdate], {l_quantity: lambda s: s.max() - s.min()})", "lineitem",
      "SELECT l_shipdate, max(l_quantity) - min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1")
_spec("Count", "orders", "Count(orders)", "orders_count", "SELECT count(*) AS count FROM orders")
_spec("CalculateStatistic", "orders", "CalculateStatistic(orders, spread, lambda df: float(df['o_totalprice'].max()) - df['o_totalprice'].min())", "orders_spread",
      "SELECT max(o_totalprice) - min(o_totalprice) AS spread FROM orders")
_spec("CalculateStatistic_distinct", "orders", "CalculateStatistic(orders, n, lambda df: df['o_custkey'].nunique(), target=s)", "s", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
_CUST = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS k FROM customer"
#: Keys from 10 on match no customer, so that each side has rows without a partner.
_NAT = "SELECT CASE WHEN n_nationkey = 4 THEN NULL WHEN n_nationkey < 10 THEN n_nationkey ELSE n_nationkey + 100 END AS k, n_name FROM nation"
for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    _spec(f"Join_{_how}", "customer nation", f"Join(c, n, on=k, how={_how}, target=j)", "j",
          f"SELECT coalesce(c.k, n.k) AS k, c_custkey, n_name FROM ({_CUST}) c {_sql} ({_NAT}) n ON c.k IS NOT DISTINCT FROM n.k", c=_CUST, n=_NAT)
_spec("Join_cross", "region nation", "Join(region, nation, how=cross)\nSelectColumn(region_nation_join, [r_name, n_name])", "region_nation_join", "SELECT r_name, n_name FROM region, nation")
_spec("Join_names", "customer orders", "Join(orders, customer, on=(o_custkey, c_custkey))\nSelectColumn(orders_customer_join, [o_orderkey, c_name, c_custkey, o_custkey])", "orders_customer_join",
      "SELECT o_orderkey, c_name, c_custkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
_spec("Join_suffix", "nation", "Join(nation, m, on={left: [n_nationkey], right: [n_regionkey]})", "nation_m_join",
      """SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_nationkey AS n_nationkey_right, b.n_name AS n_name_right, b.n_regionkey AS n_regionkey_right
      FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey""", m="SELECT * FROM nation")
_spec("Union_distinct", "nation region", "Union([a, b], distinct, target=u)", "u",
      "SELECT n_regionkey AS k, NULL AS name FROM nation UNION SELECT r_regionkey AS k, r_name AS name FROM region",
      a="SELECT n_regionkey AS k FROM nation", b="SELECT r_regionkey AS k, r_name AS name FROM region")
_spec("Union_all", "nation region", "Union([a, b], how=all)", "a_b_union",
      "SELECT n_regionkey AS k, NULL AS name FROM nation UNION ALL SELECT r_regionkey AS k, r_name AS name FROM region",
      a="SELECT n_regionkey AS k FROM nation", b="SELECT r_regionkey AS k, r_name AS name FROM region")
_spec("Append", "region", "Append(region, region)", "region", "SELECT * FROM region UNION ALL SELECT * FROM region")
_spec("Pivot", "orders", "Pivot(orders, [o_orderpriority], [o_orderstatus], [o_custkey], aggfunc=count)", "orders",
      "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS \"F\", nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS \"O\", nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS \"P\" FROM orders GROUP BY 1")
_spec("Pivot_values", "orders", "Pivot(orders, [o_orderpriority], [o_orderstatus], [o_totalprice, o_orderkey], aggfunc=max)", "orders",
      "SELECT o_orderpriority, " + ", ".join(f"max({c}) FILTER (WHERE o_orderstatus = '{s}') AS {c}_{s}" for c in ("o_totalprice", "o_orderkey") for s in "FOP") + " FROM orders GROUP BY 1")
_spec("Stack", "supplier", "Stack(supplier, [s_suppkey], [s_name, s_acctbal, s_nationkey], field, v)\nFilter(supplier, lambda r: r['field'] != 's_acctbal')", "supplier",
      "SELECT s_suppkey, 's_name' AS field, s_name AS v FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey' AS field, CAST(s_nationkey AS VARCHAR) AS v FROM supplier")
_spec("WideToLong", "part", "WideToLong(p, [size, price], [id], year, sep='_', suffix='[0-9]+')", "p",
      """SELECT p_partkey AS id, 2019 AS year, p_size AS size, p_retailprice AS price FROM part UNION ALL
      SELECT p_partkey AS id, 2020 AS year, p_size + 1 AS size, NULL AS price FROM part""",
      p="SELECT p_partkey AS id, p_size AS size_2019, p_size + 1 AS size_2020, p_retailprice AS price_2019 FROM part")
_spec("Transpose", "region", "Sort(region, [r_regionkey])\nTranspose(region, header=r_name)\nStack(region, [column])", "region",
      "SELECT 'r_regionkey' AS \"column\", r_name AS variable, r_regionkey AS value FROM region")
_spec("Transpose_mixed", "supplier", "Sort(supplier, [s_suppkey])\nTranspose(supplier)\nStack(supplier, [column])", "supplier",
      """WITH s AS (SELECT *, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS VARCHAR) AS variable FROM supplier)
      SELECT 's_suppkey' AS "column", variable, CAST(s_suppkey AS VARCHAR) AS value FROM s
      UNION ALL SELECT 's_name', variable, s_name FROM s UNION ALL SELECT 's_nationkey', variable, CAST(s_nationkey AS VARCHAR) FROM s""",
      supplier="SELECT s_suppkey, s_name, s_nationkey FROM supplier")
_spec("Explode", "part", "SelectColumn(part, [p_partkey, p_name])\nExplode(part, p_name, sep=' ')", "part", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS p_name FROM part")
_spec("ExeCode_sql", "orders", "ExeCode([orders], top, 'SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12')", "top",
      "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
_spec("ExeCode_python", "nation", "ExeCode([nation], top, 'top = nation.groupby(\"n_regionkey\", as_index=False).agg(n=(\"n_name\", \"count\"), last=(\"n_name\", \"max\"))')", "top",
      "SELECT n_regionkey, count(n_name) AS n, max(n_name) AS last FROM nation GROUP BY 1")
_spec("Terminate", "region", "Filter(region, lambda r: r['r_name'].startswith('A'))\nTerminate([region])", "region", "SELECT * FROM region WHERE starts_with(r_name, 'A')")
_LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN (l_orderkey + l_linenumber) % 3 > 0 THEN NULL ELSE l_extendedprice END AS v FROM lineitem"
for _mode, _fn, _frame in (("ffill", "last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"), ("bfill", "first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING")):
    _spec(f"MissingValueImputation_{_mode}_lines", "lineitem", f"Sort(l, [l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice])\nMissingValueImputation(l, v, {_mode})\nSelectColumn(l, [l_orderkey, l_linenumber, v])", "l",
          f"SELECT l_orderkey, l_linenumber, {_fn}(v IGNORE NULLS) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN {_frame}) AS v FROM ({_LINES}) t", l=_LINES)
#: One label holds most rows.
_HOT = "SELECT CASE WHEN l_orderkey % 10 < 8 THEN 'hot' ELSE l_returnflag END AS g, l_extendedprice, l_partkey, l_suppkey FROM lineitem"
_spec("GroupBy_median_hot", "lineitem", "GroupBy(l, [g], {l_extendedprice: median, l_partkey: nunique, l_suppkey: nunique})", "l",
      f"SELECT g, median(l_extendedprice) AS l_extendedprice, count(DISTINCT l_partkey) AS l_partkey, count(DISTINCT l_suppkey) AS l_suppkey FROM ({_HOT}) t GROUP BY g", l=_HOT)
_spec("GroupBy_descending", "orders", "Sort(orders, [o_orderdate, o_orderkey], ascending=[False, False])\nGroupBy(orders, [o_orderpriority], {o_orderkey: first, o_custkey: last})", "orders",
      "SELECT o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_min(o_custkey, (o_orderdate, o_orderkey)) AS o_custkey FROM orders GROUP BY 1")
_spec("GroupBy_first_null_keys", "events", "Sort(e, [value, event_id])\nGroupBy(e, [event_type], {event_id: [first, last]})", "e",
      f"""SELECT event_type, arg_min(event_id, (CASE WHEN value IS NULL THEN 1 ELSE 0 END, coalesce(value, 0), event_id)) AS event_id_first,
      arg_max(event_id, (CASE WHEN value IS NULL THEN 1 ELSE 0 END, coalesce(value, 0), event_id)) AS event_id_last FROM ({GAPS}) t GROUP BY 1""", e=GAPS)
_spec("CastType_datetime", "orders", "CastType(o, d, datetime)", "o", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS d FROM orders",
      o="SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'no date' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS d FROM orders")
_spec("Pivot_first", "orders", "Sort(o, [o_orderkey])\nPivot(o, [o_orderpriority], [o_orderstatus], [o_totalprice])", "o",
      "SELECT o_orderpriority, " + ", ".join(f"arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = '{x}') AS \"{x}\"" for x in "FOP") + " FROM orders GROUP BY 1",
      o="SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM orders")
_spec("Pivot_levels", "orders", "Pivot(o, [a, b], [o_orderstatus], [o_totalprice], aggfunc=max, dropna=False)", "o",
      """WITH o AS (SELECT o_orderpriority AS a, o_custkey % 7 AS b, o_orderstatus, o_totalprice FROM orders WHERE o_custkey % 7 > 0 OR o_orderpriority < '3'),
      g AS (SELECT * FROM (SELECT DISTINCT a FROM o) x, (SELECT DISTINCT b FROM o) y)
      SELECT g.a AS a, g.b AS b, """ + ", ".join(f"max(o_totalprice) FILTER (WHERE o_orderstatus = '{x}') AS \"{x}\"" for x in "FOP") + " FROM g LEFT JOIN o ON g.a = o.a AND g.b = o.b GROUP BY 1, 2",
      o="SELECT o_orderpriority AS a, o_custkey % 7 AS b, o_orderstatus, o_totalprice FROM orders WHERE o_custkey % 7 > 0 OR o_orderpriority < '3'")
_spec("Explode_lists", "part", "Explode(p, words)", "p",
      """SELECT p_partkey, unnest(CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN [NULL] ELSE string_split(p_name, ' ') END) AS words FROM part""",
      p="SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN array() ELSE split(p_name, ' ') END AS words FROM part")
_spec("SplitColumn_func", "customer", "SplitColumn(customer, c_name, [a, b], func=lambda v: v.split('#'))\nSelectColumn(customer, [c_custkey, a, b])", "customer",
      "SELECT c_custkey, split_part(c_name, '#', 1) AS a, CASE WHEN contains(c_name, '#') THEN split_part(c_name, '#', 2) END AS b FROM customer")
_spec("Concatenate_func", "part", "Concatenate(part, [p_brand, p_type], t, func=lambda a, b: a.lower() + '/' + b)\nSelectColumn(part, [p_partkey, t])", "part",
      "SELECT p_partkey, lower(p_brand) || '/' || p_type AS t FROM part")
_spec("flagship", "lineitem orders customer",
      """Filter(lineitem, lambda r: r['l_discount'] > 0.05)
      Join(orders, lineitem, on=(o_orderkey, l_orderkey), how=inner, target=ol)
      Join(ol, customer, on=(o_custkey, c_custkey), how=inner, target=olc)
      GroupBy(olc, by=[c_mktsegment], agg={'l_extendedprice': 'sum', 'o_orderkey': 'nunique'})
      Sort(olc, by=[l_extendedprice], ascending=False)
      Terminate([olc])""", "olc",
      """SELECT c_mktsegment, round(sum(l_extendedprice), 4) AS l_extendedprice, count(DISTINCT o_orderkey) AS o_orderkey
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_discount > 0.05 GROUP BY 1""")

#: Results whose floating sums depend on the order of addition: both sides are rounded.
ROUNDED = {
    "MissingValueImputation_mean": {"value": 6}, "GroupBy": {"l_quantity_std": 6, "l_quantity_var": 6, "l_quantity_mean": 6, "l_quantity_sum": 4},
    "GroupBy_null_key": {"value": 4}, "flagship": {"l_extendedprice": 4}, "OutlierDetection_clip": {"l_extendedprice": 6},
    "AddNewColumn": {"net": 6}, "CalculateStatistic": {"spread": 6},
}


def load(spark: SparkSession, sf_dir: str, tables: list[str], views: dict[str, str]) -> TableSet:
    """The named tables, and tables made of them by SQL."""
    read: list[Table] = [read_parquet_table(spark, f"{sf_dir}/{n}.parquet", n) for n in tables]
    made = []
    if views:
        for t in read:
            t.visible.createOrReplaceTempView(t.name)
        made = [make_table(spark, n, spark.sql(q)) for n, q in views.items()]
        for t in made:
            t.df.schema  # noqa: B018 - resolved while the views exist
    return TableSet([*read, *made])


def run_pipeline(tables: TableSet, text: str) -> TableSet:
    for call in parse_pipeline(text):
        tables = call.execute(tables)
    return tables


#: Queries whose program runs in Python, which is switched on while they are planned.
PYTHON = {"ExeCode_python"}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    tables, views, pipeline, result, _ = SPECS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pyspark.sql import functions as F

        was = fallback.allowed()
        fallback.allow(was or name in PYTHON)
        try:
            made = run_pipeline(load(spark, sf_dir, tables, views), pipeline)[result]
        finally:
            fallback.allow(was)
        # Only a pipeline that asks for an order pays for one.
        df = made.ordered() if any(call.op.NAME in ("Sort", "TopK") for call in parse_pipeline(pipeline)) else made.visible
        return df.withColumns({c: F.round(quoted(c), n) for c, n in ROUNDED.get(name, {}).items()})

    run.__name__ = name
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _query(n) for n in SPECS}


def oracle_sql() -> dict[str, str]:
    out = {}
    for n, spec in SPECS.items():
        sql = spec[4]
        if r := ROUNDED.get(n):
            sql = f"SELECT * REPLACE ({', '.join(f'round({c}, {d}) AS {c}' for c, d in r.items())}) FROM ({sql}) r"
        out[n] = sql
    return out
