"""Aggregates in Python of any kind whose partial results can be merged.

Each task folds its rows, batch by batch, into one state for each group that it meets; only states are shuffled, and merged
in two steps, so a group with most of the rows costs its last task no more than a few dozen states. What has no
merge (a median by a function of all values, say) needs all of a group at once, and is left to ``GroupBy``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.model import quoted, without_nan
from millrace.relational.cells import named, written

#: Groups of which a task keeps states at once; parts of a group's states that are merged before the last merge.
HELD, PARTS = 50_000, 64


@dataclass(frozen=True)
class Aggregator:
    """``init()`` gives a state, ``step(state, values)`` takes in a list of values (missing ones as None), ``merge(a, b)`` makes
    one of two states, ``finish(state)`` the result, of the DDL type ``result``. States must be picklable, and small."""

    init: Callable[[], Any]
    step: Callable[[Any, list], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]
    result: str


def aggregate_by(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Aggregator, str]], held: int = HELD, parts: int = PARTS) -> DataFrame:
    """The keys and the aggregates of each group; ``wanted``: name -> (aggregator, column).

    NULL (and NaN) is a key of its own. Rows are taken in no particular order, repeated ones all count. An empty table
    has no groups, but without keys there is one row for a table with rows. Keys and results may have any names that differ.
    """
    named(df, [*keys, *(c for _, c in wanted.values())])
    if clash := set(keys) & set(wanted):
        raise ValueError(f"results named as keys: {sorted(clash)}")
    rows = without_nan(written(df).select(*[quoted(k).alias(f"k{i}") for i, k in enumerate(keys)], *[quoted(c).alias(f"v{i}") for i, (_, c) in enumerate(wanted.values())]))
    how, names = [a for a, _ in wanted.values()], [f"k{i}" for i in range(len(keys))]
    fields = [rows.schema[n] for n in names]
    states = T.StructType([*fields, T.StructField("state", T.BinaryType())])
    types = [to_arrow_type(f.dataType) for f in fields]

    def out(found: dict[tuple, list]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in found], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(s) for s in found.values()], pa.binary())], [*names, "state"])

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for batch in batches:
            keyed = list(zip(*[batch.column(n).to_pylist() for n in names], strict=True)) if names else [()] * batch.num_rows
            at: dict[tuple, list[int]] = {}
            for i, k in enumerate(keyed):
                at.setdefault(k, []).append(i)
            values = [batch.column(f"v{j}").to_pylist() for j in range(len(how))]
            for k, places in at.items():
                state = found.get(k) or [a.init() for a in how]
                found[k] = [a.step(s, [v[i] for i in places]) for a, s, v in zip(how, state, values, strict=True)]
            if len(found) > held:
                yield out(found)
                found = {}
        if found:
            yield out(found)

    def merged(state: pd.Series) -> list:
        at = [pickle.loads(bytes(s)) for s in state]  # noqa: S301 - made by tasks of this very job
        made = at[0]
        for other in at[1:]:
            made = [a.merge(x, y) for a, x, y in zip(how, made, other, strict=True)]
        return made

    # Over groups, as keys that repeat a value of another type would be lost in pandas: only the states pass through it.
    @F.pandas_udf("binary")
    def together(state: pd.Series) -> bytes:
        return pickle.dumps(merged(state))

    results = T.StructType([T.StructField(f"r{i}", T._parse_datatype_string(a.result)) for i, a in enumerate(how)])

    @F.pandas_udf(results)
    def finished(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for state in batches:
            rows = [[a.finish(s) for a, s in zip(how, pickle.loads(bytes(x)), strict=True)] for x in state]  # noqa: S301
            yield pd.DataFrame({f"r{i}": pd.Series([r[i] for r in rows], dtype=object) for i in range(len(how))})

    made = rows.mapInArrow(fold, states).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts)))
    made = made.groupBy(*names, "part").agg(together("state").alias("state"))
    made = made.groupBy(*names).agg(together("state").alias("state"))
    if not names:
        made = made.where("state is not null")
    made = made.withColumn("r", finished("state"))
    return made.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], *[F.col("r")[f"r{i}"].alias(n) for i, n in enumerate(wanted)])
