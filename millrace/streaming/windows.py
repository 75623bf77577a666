"""Windows over event time with state: tumbling, sliding and session windows, late rows, and runs over files.

The same function makes the windows of a stream and of a table, so a replayed stream can be held against the
batch result. State is bounded by the watermark: a window is given out once, when the latest event time
seen is ``delay`` past its end, and what comes later for it is late; late rows are counted.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from millrace.errors import OperatorError
from millrace.model import quoted
from millrace.session import shared_dir

#: name -> aggregate; those that need all rows of a window at once aren't among them.
KINDS = {
    "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "mean": F.avg,
    "approx_nunique": F.approx_count_distinct, "list": F.collect_list,
}


def windowed(
    rows: DataFrame, time: str, wanted: Mapping[str, tuple[str, Column | str]], size: str | None = None, slide: str | None = None, gap: str | None = None,
    keys: Sequence[str] = (), delay: str = "10 minutes",
) -> DataFrame:
    """window_start, window_end, the keys and the aggregates of each window: of ``size`` every ``slide`` (``size`` itself
    if not given), or sessions that a ``gap`` without rows of the keys ends.

    ``wanted``: name -> (sum, count, min, max, mean, approx_nunique or list, column or expression). Rows without a time
    are in no window; NULL is a key of its own; repeated rows all count; an empty stream gives no windows. A session's
    end is its last row's time and the gap. ``delay`` is how late rows may come.
    """
    if (size is None) == (gap is None) or slide is not None and size is None:
        raise OperatorError("either a size (and a slide) or a gap is needed")
    names = ["window_start", "window_end", *keys, *wanted]
    if len(set(names)) < len(names):
        raise OperatorError(f"columns of one name among {names}")
    if unknown := [k for k, _ in wanted.values() if k not in KINDS]:
        raise OperatorError(f"unknown aggregates {unknown}; known: {list(KINDS)}")
    missing = [c for c in (time, *keys) if c not in rows.columns]
    if missing:
        raise OperatorError(f"no columns {missing}; columns: {rows.columns}")
    if isinstance(rows.schema[time].dataType, T.TimestampNTZType):
        rows = rows.withColumn(time, quoted(time).cast("timestamp"))  # watermarks need instants
    own = {n: f"a{i}" for i, n in enumerate(wanted)}
    values = {n: (quoted(c) if isinstance(c, str) else c).alias(f"v{i}") for i, (n, (_, c)) in enumerate(wanted.items())}
    rows = rows.select(quoted(time).alias("t"), *[quoted(k).alias(f"k{i}") for i, k in enumerate(keys)], *values.values())
    rows = rows.where("t is not null").withWatermark("t", delay)
    window = F.session_window("t", gap) if gap is not None else F.window("t", size, slide or size)
    made = rows.groupBy(window.alias("w"), *[f"k{i}" for i in range(len(keys))]).agg(
        *[KINDS[kind](f"v{i}").alias(own[n]) for i, (n, (kind, _)) in enumerate(wanted.items())]
    )
    return made.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *[F.col(a).alias(n) for n, a in own.items()],
    )


@dataclass(frozen=True)
class StreamRun:
    """What a run over all files there were has given: its rows, and counts of batches, rows read and late rows."""

    rows: DataFrame
    batches: int
    read: int
    late: int


class _Counts(StreamingQueryListener):
    def __init__(self):
        self.run: str | None = None
        self.batches = self.read = self.late = 0
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.run in (None, str(p.runId)):
            self.batches += 1
            self.read += max(0, p.numInputRows)
            self.late += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryTerminated(self, event) -> None:
        if self.run in (None, str(event.runId)):
            self.ended.set()


def run_over_files(stream: DataFrame, mode: str = "append", tag: str = "stream") -> StreamRun:
    """Run a stream over the files that its source has now, into a table in the shared folder.

    The folder holds the checkpoint too: a run that lost its driver goes on where its last batch ended. The
    counts come from the progress of every batch, however many there are. A row is late where its window was
    given out before its batch.
    """
    spark: SparkSession = stream.sparkSession
    path = f"{shared_dir(spark)}/millrace/{tag}-{uuid.uuid4().hex}"
    counts = _Counts()
    spark.streams.addListener(counts)
    try:
        query: StreamingQuery = (
            stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows")
            .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        counts.ended.wait(60)  # events arrive behind the query's end
    finally:
        spark.streams.removeListener(counts)
    return StreamRun(spark.read.schema(stream.schema).parquet(f"{path}/rows"), counts.batches, counts.read, counts.late)


def read_files(spark: SparkSession, path: str, files: int = 1, glob: str | None = None) -> DataFrame:
    """A stream of the Parquet files at ``path``, ``files`` of them in a batch, in the order in which they were written."""
    schema = spark.read.parquet(path if glob is None else f"{path}/{glob}").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return (reader if glob is None else reader.option("pathGlobFilter", glob)).parquet(path)
