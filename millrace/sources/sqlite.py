"""SQLite files as read-only sources, and benchmarks of questions over them."""

from __future__ import annotations

import json
import re
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.model import Table, TableSet, hidden_name, quoted, without_nan

#: Rows that one partition reads.
RANGE = 500_000
_IDENT = re.compile(r'"')


def _quote(name: str) -> str:
    return '"' + _IDENT.sub('""', name) + '"'


def connect(path: str) -> sqlite3.Connection:
    """Read-only."""
    return sqlite3.connect(f"{Path(path).absolute().as_uri()}?mode=ro", uri=True)


def spark_type(declared: str) -> T.DataType:
    """By SQLite's rules of type affinity."""
    d = declared.upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "DEC", "NUM")):
        return T.DoubleType()
    return T.StringType()


def table_names(db: sqlite3.Connection) -> list[str]:
    return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY rowid")]


def table_schema(db: sqlite3.Connection, table: str) -> T.StructType:
    """Columns with what the catalogue says of them: keys, references and declared types.

    SQLite doesn't hold values to their declared types: a column of numbers with text in it is text.
    """
    refs = {r[3]: (r[2], r[4]) for r in db.execute(f"PRAGMA foreign_key_list({_quote(table)})")}
    fields = []
    for _, name, declared, _, _, key in db.execute(f"PRAGMA table_info({_quote(table)})"):
        kind = spark_type(declared or "")
        if not isinstance(kind, T.StringType):
            held = {r[0] for r in db.execute(f"SELECT DISTINCT typeof({_quote(name)}) FROM {_quote(table)}")}
            if held & {"text", "blob"}:
                kind = T.StringType()
            elif "real" in held:
                kind = T.DoubleType()
        told = [f"Primary key of {table}."] if key else []
        if name in refs:
            told.append(f"Foreign key referencing {refs[name][0]}.{refs[name][1]}.")
        if declared:
            told.append(f"Declared SQL type {declared}.")
        fields.append(T.StructField(name, kind, True, {"description": " ".join(told)}))
    return T.StructType(fields)


@dataclass
class _Rows(InputPartition):
    low: int | None
    high: int | None


#: Comparisons of a column with a value (in: with a list) or none, that SQLite makes as Spark does between values of one kind.
COMPARED = ("=", ">", ">=", "<", "<=", "in", "is null", "is not null")


class _Reader(DataSourceReader):
    """Parts of a table by bounds that each hold RANGE rows, wherever their rowids lie; filters go into SQLite's query.

    Filters are an option, not what Spark would push: it keeps pushed filters with the source, for every later query of
    the same DataFrame.
    """

    def __init__(self, options, schema: T.StructType):
        self.path, self.table, self.schema = options["path"], options["dbtable"], schema
        self.position = options.get("position")
        made = [self._condition(*f) for f in json.loads(options.get("filters", "[]"))]
        self.conditions = [c for c in made if c is not None]

    def _condition(self, name: str, op: str, value=None) -> tuple[str, list] | None:
        """SQL and its values; Spark makes every test again, so a condition need only not lose a row."""
        column, text = self._column(name), name in self.schema.fieldNames() and isinstance(self.schema[name].dataType, T.StringType)
        if op in ("is null", "is not null"):
            return f"{column} {op.upper()}", []
        values = list(value) if op == "in" else [value]
        if not all(isinstance(v, str if text else (int, float)) and not isinstance(v, bool) for v in values):
            return None
        if any(isinstance(v, int) and abs(v) >= 1 << 63 for v in values):
            return None
        test = f"{column} IN ({', '.join('?' * len(values))})" if op == "in" else f"{column} {op} ?"
        # A column of text may hold numbers, which become text only when they are read.
        return (f"(typeof({column}) <> 'text' OR {test})" if text else test), values

    def partitions(self) -> list[_Rows]:
        table = _quote(self.table)
        with closing(connect(self.path)) as db:
            try:
                at = db.execute(f"SELECT min(rowid) FROM {table}").fetchone()[0]
            except sqlite3.OperationalError:  # a table without rowid is read in one piece
                return [_Rows(None, None)]
            bounds = []
            while at is not None:  # each step goes on from the last bound, so all steps together pass the index once
                bounds.append(at)
                at = next(iter(db.execute(f"SELECT rowid FROM {table} WHERE rowid >= ? ORDER BY rowid LIMIT 1 OFFSET ?", (at, RANGE)).fetchone() or [None]))
        return [_Rows(a, z) for a, z in zip(bounds, [*bounds[1:], None], strict=True)] if bounds else [_Rows(0, 0)]

    def _column(self, name: str) -> str:
        return "rowid" if name == self.position else _quote(name)

    def query(self, partition: _Rows) -> tuple[str, list]:
        """SQLite's query for a part, and its values."""
        columns = ", ".join("0" if n == self.position and partition.low is None else self._column(n) for n in self.schema.fieldNames())
        tests = list(self.conditions)
        if partition.low is not None:
            tests.append(("rowid >= ?", [partition.low]))
            if partition.high is not None:
                tests.append(("rowid < ?", [partition.high]))
        where = f" WHERE {' AND '.join(t for t, _ in tests)}" if tests else ""
        return f"SELECT {columns or 1} FROM {_quote(self.table)}{where}", [v for _, vs in tests for v in vs]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        make = [_maker(f.dataType) for f in self.schema.fields]
        with closing(connect(self.path)) as db:
            for row in db.execute(*self.query(partition)):
                yield tuple(None if v is None else f(v) for f, v in zip(make, row, strict=False))


def _maker(t: T.DataType):
    if isinstance(t, T.LongType):
        return int
    if isinstance(t, T.DoubleType):
        return float
    return lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_ro").options(path=..., dbtable=...)``; partitions hold equally many rows.

    ``columns``, a JSON list, names those to read; others never leave SQLite. ``filters``, a JSON list of [column, one of
    COMPARED, value], leave out rows by SQLite's own query, as far as it can test as Spark does.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_ro"

    def schema(self) -> T.StructType:
        with closing(connect(self.options["path"])) as db:
            s = table_schema(db, self.options["dbtable"])
        if "columns" in self.options:
            s = T.StructType([s[c] for c in json.loads(self.options["columns"])])
        extra = [T.StructField(self.options["position"], T.LongType())] if "position" in self.options else []
        return T.StructType([*s.fields, *extra])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


def read_table(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, filters: list[tuple] | None = None) -> Table:
    """One SQLite table, ordered by rowid; of ``columns`` alone, and of rows that pass all ``filters``, if given.

    A filter is (column, one of COMPARED, value), the column one of those read.
    """
    spark.dataSource.register(SqliteSource)
    at = hidden_name()
    with closing(connect(path)) as db:
        schema = table_schema(db, table)
    known = schema.fieldNames() if columns is None else columns
    if wrong := [f for f in filters or [] if f[0] not in known or f[1] not in COMPARED]:
        raise ValueError(f"filters of unknown columns or comparisons: {wrong}; columns: {known}, comparisons: {COMPARED}")
    wanted = {} if columns is None else {"columns": json.dumps(columns)}
    df = spark.read.format("sqlite_ro").options(path=path, dbtable=table, position=at, filters=json.dumps(filters or []), **wanted).load()
    for f in schema.fields:
        if f.name in df.columns:
            df = df.withMetadata(f.name, f.metadata)
    made = Table(table, without_nan(df), "", ((at, True),))
    for name, op, *value in filters or []:
        made = made.with_df(made.df.where(_test(quoted(name), op, *value)))
    return made


def _test(c: Column, op: str, value=None) -> Column:
    if op == "in":
        return c.isin(*value)
    if op in ("is null", "is not null"):
        return c.isNull() if op == "is null" else c.isNotNull()
    v = F.lit(value)
    return {"=": c == v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]


def load_sources(spark: SparkSession, path: str, tables: list[str] | None = None) -> TableSet:
    with closing(connect(path)) as db:
        names = table_names(db)
    return TableSet(read_table(spark, path, n) for n in names if tables is None or n.lower() in {t.lower() for t in tables})


def dedupe_names(names: list[str]) -> list[str]:
    """``id, id`` as ``id, id_2``."""
    out: list[str] = []
    for n in names:
        k, own = 2, n
        while own in out:
            own, k = f"{n}_{k}", k + 1
        out.append(own)
    return out


def run_sql(spark: SparkSession, tables: TableSet, query: str) -> DataFrame:
    """A query over the tables as views, by Spark; SQLite's TOTAL(x) is a sum that is never missing."""
    for t in tables.values():
        t.visible.createOrReplaceTempView(t.name)
    df = spark.sql(re.sub(r"(?i)\btotal\s*\(([^()]*)\)", r"coalesce(cast(sum(\1) as double), 0.0)", query.rstrip().rstrip(";")))
    return df.toDF(*dedupe_names(df.columns))


def run_sqlite(path: str, query: str) -> tuple[list[str], list[tuple]]:
    """The same by SQLite itself: names and rows."""
    with closing(connect(path)) as db:
        cursor = db.execute(query)
        return dedupe_names([d[0] for d in cursor.description]), cursor.fetchall()


def referenced_tables(query: str, names: list[str]) -> list[str]:
    """Tables of ``names`` that FROM or JOIN clauses mention."""
    found = {m.strip('"`[]').lower() for m in re.findall(r"(?i)(?:\bfrom|\bjoin|,)\s+([\"`\[]?\w+[\"`\]]?)", query)}
    return [n for n in names if n.lower() in found]


@dataclass(frozen=True)
class Question:
    """One benchmark record."""

    db_id: str
    question: str
    query: str
    evidence: str = ""
    difficulty: str = ""
    question_id: str = ""


def load_benchmark(path: str, limit: int | None = None, db_ids: list[str] | None = None) -> list[Question]:
    """Records of a JSON list or JSON Lines file; those without SQL are left out."""
    text = Path(path).read_text(encoding="utf-8")
    records = json.loads(text) if text.lstrip().startswith("[") else [json.loads(x) for x in text.splitlines() if x.strip()]
    out = []
    for i, r in enumerate(records):
        sql = str(r.get("query") or r.get("SQL") or r.get("sql") or "").strip().rstrip(";").strip()
        if sql and (db_ids is None or r["db_id"] in db_ids):
            out.append(Question(r["db_id"], r.get("question", ""), sql, r.get("evidence", "") or "", r.get("difficulty", "") or "", str(r.get("question_id", r.get("id", i)))))
    return out[:limit]


def database_path(root: str, db_id: str) -> str:
    """The file of a database in one of the usual layouts."""
    for p in (f"database/{db_id}/{db_id}.sqlite", f"{db_id}/{db_id}.sqlite", f"database/{db_id}/{db_id}.db", f"{db_id}.sqlite", f"{db_id}.db"):
        if (full := Path(root) / p).exists():
            return str(full)
    raise FileNotFoundError(f"no SQLite file for {db_id!r} below {root}")
