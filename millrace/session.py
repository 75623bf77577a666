"""Spark session defaults and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A table may be broadcast up to this many rows or bytes; callers join by shuffle beyond it.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def get_spark(app: str = "millrace", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects (UTC, ANSI, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset a local one is set once, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir isn't set: on {master} it must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, made, True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that read its part again. The files go
    with ``discard``, with the folder, or when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    atexit.register(_delete, spark, path)
    made = spark.read.schema(df.schema).parquet(path)
    made.millrace_path = path
    return made


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for t in tables:
        if t is not None and (path := getattr(t, "millrace_path", None)):
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
