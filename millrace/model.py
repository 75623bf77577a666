"""Tables, table sets and tasks: lazily planned DataFrames with names, descriptions and a row order.

Row order is metadata. Hidden columns (prefix ``__o``) carry the keys that define it; operators extend or
replace them and only a consumer of order sorts by them, so a plan that never asks for order prunes them.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN = "__o"
_numbers = itertools.count()
#: Names of types as they appear in prompts and feedback.
LABELS = {
    "bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8", "double": "float64", "float": "float32",
    "string": "object", "boolean": "bool", "timestamp_ntz": "datetime64[ns]", "timestamp": "datetime64[ns]",
    "date": "datetime64[ns]",
}


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def hidden_name() -> str:
    return f"{HIDDEN}{next(_numbers)}"


@dataclass(frozen=True)
class ColumnSpec:
    """Name, informational type and description of one column."""

    name: str
    dtype: str = ""
    description: str = ""

    @classmethod
    def from_dict(cls, d: str | Mapping) -> ColumnSpec:
        if isinstance(d, str):
            return cls(d)
        return cls(str(d["name"]), str(d.get("dtype") or ""), str(d.get("description") or d.get("desc") or ""))

    def to_dict(self) -> dict:
        return {"name": self.name, "dtype": self.dtype, "description": self.description}


@dataclass(frozen=True)
class TableSchema:
    """Description of a table and its columns in order."""

    description: str = ""
    columns: tuple[ColumnSpec, ...] = ()

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    def get(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if c.name == name), None)

    @classmethod
    def from_dict(cls, d: str | Mapping) -> TableSchema:
        if isinstance(d, str):
            return cls(d)
        text = d.get("description") or d.get("table_description") or ""
        return cls(str(text), tuple(ColumnSpec.from_dict(c) for c in d.get("columns", ())))

    def to_dict(self) -> dict:
        return {"description": self.description, "columns": [c.to_dict() for c in self.columns]}

    @classmethod
    def infer(cls, df: DataFrame, description: str = "") -> TableSchema:
        specs = tuple(
            ColumnSpec(f.name, LABELS.get(f.dataType.simpleString(), "object"), (f.metadata or {}).get("description", ""))
            for f in df.schema.fields
            if not f.name.startswith(HIDDEN)
        )
        return cls(description, specs)


@dataclass(frozen=True)
class Table:
    """A named DataFrame; ``order`` lists (hidden column, ascending) from the first key on."""

    name: str
    df: DataFrame
    description: str = ""
    order: tuple[tuple[str, bool], ...] = ()

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    @property
    def schema(self) -> TableSchema:
        return TableSchema.infer(self.visible, self.description)

    @property
    def visible(self) -> DataFrame:
        """The DataFrame without hidden columns, in no particular order."""
        return self.df.select(*map(quoted, self.columns))

    @property
    def hidden(self) -> list[Column]:
        return [quoted(c) for c in self.df.columns if c.startswith(HIDDEN)]

    def type_of(self, column: str) -> T.DataType:
        return self.df.schema[column].dataType

    def with_df(self, df: DataFrame, order: tuple | None = None) -> Table:
        """The same table over other data: its description stays, columns keep theirs by name."""
        told = {f.name: (f.metadata or {}).get("description") for f in self.df.schema.fields}
        for f in df.schema.fields:
            if told.get(f.name) and not (f.metadata or {}).get("description"):
                df = df.withMetadata(f.name, {"description": told[f.name]})
        return Table(self.name, df, self.description, self.order if order is None else tuple(order))

    def select(self, *columns: Column) -> Table:
        """A projection that keeps the row order."""
        return self.with_df(self.df.select(*columns, *self.hidden))

    def positioned(self) -> Table:
        """A table whose rows have an order: its own, else that of the partitions as they are read (a stream has none)."""
        if self.order:
            return self
        name = hidden_name()
        if self.df.isStreaming:
            return self.with_df(self.df.withColumn(name, F.lit(0)), ((name, True),))
        return self.with_df(self.df.withColumn(name, F.monotonically_increasing_id()), ((name, True),))

    def sort_keys(self, backwards: bool = False) -> list[Column]:
        keys = []
        for name, up in self.order:
            c = quoted(name)
            if backwards:
                keys.append(c.desc_nulls_first() if up else c.asc_nulls_first())
            else:
                keys.append(c.asc_nulls_last() if up else c.desc_nulls_last())
        return keys

    def ordered(self) -> DataFrame:
        """The visible columns sorted by the table's order."""
        if not self.order:
            return self.visible
        return self.df.orderBy(*self.sort_keys()).select(*map(quoted, self.columns))

    def renamed(self, name: str) -> Table:
        return Table(name, self.df, self.description, self.order)


class TableSet(Mapping[str, Table]):
    """An ordered, immutable mapping of names to tables; ``answer`` is the marked result, if any."""

    def __init__(self, tables: Iterable[Table] = (), answer: str | None = None):
        self._tables = {t.name: t for t in tables}
        self.answer = answer

    def __getitem__(self, name: str) -> Table:
        return self.require(name)

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def __contains__(self, name: object) -> bool:
        return name in self._tables

    def require(self, name: str) -> Table:
        if name not in self._tables:
            raise KeyError(f"no table {name!r}; available tables: {sorted(self._tables)}")
        return self._tables[name]

    @property
    def names(self) -> list[str]:
        return list(self._tables)

    def replace(self, table: Table) -> TableSet:
        """A set with the table in its old place, or at the end; an answer mark is dropped."""
        return TableSet({**self._tables, table.name: table}.values())

    def marked(self, name: str) -> TableSet:
        return TableSet(self._tables.values(), name)

    def unique_name(self, base: str) -> str:
        if base not in self._tables:
            return base
        return next(n for i in itertools.count(2) if (n := f"{base}_{i}") not in self._tables)

    def fingerprint(self) -> str:
        """A digest of names, columns and rows; one aggregate a table."""
        import hashlib

        parts = []
        for t in self.values():
            hashes = t.visible.select(F.xxhash64(*[F.coalesce(quoted(c).cast("string"), F.lit("\x00")) for c in t.columns] or [F.lit(0)]).alias("h"))
            n, x, s = hashes.agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.pmod("h", F.lit(1 << 31)))).head()
            parts.append((t.name, t.columns, n, x, s))
        return hashlib.sha256(repr(parts).encode()).hexdigest()[:16]

    @classmethod
    def of(cls, spark: SparkSession, **frames: Any) -> TableSet:
        """Tables from DataFrames, pandas frames or (rows, ddl) pairs, in the order given."""
        return cls(make_table(spark, name, data) for name, data in frames.items())


def make_table(spark: SparkSession, name: str, data: Any, description: str = "") -> Table:
    """A table of a DataFrame as it is, or of local rows in their order; NaN becomes NULL."""
    if isinstance(data, DataFrame):
        return Table(name, without_nan(data), description)
    if isinstance(data, tuple):
        df = spark.createDataFrame(list(data[0]), data[1])
    else:
        df = spark.createDataFrame(data)
    order = hidden_name()
    return Table(name, without_nan(df).withColumn(order, F.monotonically_increasing_id()), description, ((order, True),))


def without_nan(df: DataFrame) -> DataFrame:
    """Floating NaN as NULL: the two are one missing value here, and Spark would sort NaN highest."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(quoted(c), F.lit(None).cast(df.schema[c].dataType)) for c in floats}) if floats else df


def read_parquet_table(spark: SparkSession, path: str, name: str) -> Table:
    """A Parquet table ordered by file and row; predicates on it are still pushed down."""
    df = spark.read.parquet(path)
    a, b = hidden_name(), hidden_name()
    df = df.select("*", F.col("_metadata.file_path").alias(a), F.col("_metadata.row_index").alias(b))
    return Table(name, df, "", ((a, True), (b, True)))


@dataclass
class Task:
    """Sources, the schema wanted, and for evaluation the true table and pipeline."""

    task_id: str
    sources: TableSet
    target_schema: TableSchema
    target_table: Table | None = None
    gold_pipeline: list[str] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name; columns of conflicting types become text."""
    types: dict[str, set[str]] = {}
    for f in frames:
        for c, t in f.dtypes:
            types.setdefault(c, set()).add(t)
    numeric = {"bigint", "int", "smallint", "tinyint", "double", "float"}

    def fit(f: DataFrame) -> DataFrame:
        casts = {}
        for c, t in f.dtypes:
            if len(types[c]) > 1:
                casts[c] = quoted(c).cast(("double" if types[c] & {"double", "float"} else "bigint") if types[c] <= numeric else "string")
        return f.withColumns(casts) if casts else f

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(fit, frames))


def to_json_cell(value: Any) -> Any:
    return value if value is None or isinstance(value, (bool, int, float, str, list)) else str(value)


def dumps(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, default=to_json_cell)
