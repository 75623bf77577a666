"""Queries that run the events as a stream, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.streaming import run_on_stream
from millrace.streaming.windows import read_files, run_over_files, windowed

_DELAY = "30 minutes"
#: Windows that the last event has closed: it is 30 minutes and more behind their end.
_CLOSED = "WHERE window_end <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 30 MINUTES"
_SUMS = "count(*) AS n, round(sum(value), 4) AS value, max(value) AS most"
_WANTED = {"n": ("count", "event_id"), "value": ("sum", "value"), "most": ("max", "value")}


def _run(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    made = run_over_files(windowed(read_files(spark, sf_dir, glob="events.parquet"), "ts", _WANTED, delay=_DELAY, **how)).rows
    return made.withColumns({"value": F.round("value", 4), **{c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}})


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of each kind of event."""
    return _run(spark, sf_dir, size="1 hour", keys=["event_type"])


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six hours, every two."""
    return _run(spark, sf_dir, size="6 hours", slide="2 hours")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' sessions, which three hours without an event end."""
    return _run(spark, sf_dir, gap="3 hours", keys=["user_id"])


def stream_row_wise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators on one row at a time, items exploded and columns stacked."""
    events = read_files(spark, sf_dir, glob="events.parquet").select("event_id", "user_id", "event_type", "value")
    out = run_on_stream(
        events, "e",
        "CastType(e, user_id, str)\nCastType(e, value, int)\nAddNewColumn(e, tags, lambda r: r['event_type'] + ',' + r['user_id'])\n"
        "Explode(e, tags, sep=',')\nStack(e, [event_id, tags], [value, event_type], field, cell)\nFilter(e, lambda r: r['field'] == 'value')",
    )
    return run_over_files(out).rows


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_sessions, stream_row_wise)}
SQL = {
    "stream_tumbling": f"""SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, {_SUMS}
      FROM events GROUP BY 1, 2, 3) w {_CLOSED}""",
    "stream_sliding": f"""SELECT * FROM (SELECT s AS window_start, s + INTERVAL 6 HOURS AS window_end, {_SUMS}
      FROM (SELECT *, time_bucket(INTERVAL 2 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 2 HOURS * unnest([0, 1, 2]) AS s FROM events) e GROUP BY 1, 2) w {_CLOSED}""",
    "stream_sessions": f"""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER u + INTERVAL 3 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
      SELECT * FROM (SELECT min(ts) AS window_start, max(ts) + INTERVAL 3 HOURS AS window_end, user_id, {_SUMS} FROM s GROUP BY user_id, s) w {_CLOSED}""",
    "stream_row_wise": """SELECT event_id, unnest([event_type, CAST(user_id AS VARCHAR)]) AS tags, 'value' AS field, CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) AS cell FROM events""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
