"""What several operators of this package share: words, batches by size, small joins."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import count

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import BROADCAST_ROWS

#: Bytes of UTF-8 that belong to a word: digits, ASCII letters (lower-cased) and all of a non-ASCII character.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """The text's words as UTF-8, A-Z lower-cased: maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``."""
    return (text or "").encode().translate(_FOLD).split()


@cache
def _libc() -> ctypes.CDLL:
    """The C library that this process has loaded already."""
    return ctypes.CDLL(None)


def release() -> None:
    """Give freed memory back to the system, so that an idle worker process holds little."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about ``most`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        values = batch.column(column)
        length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        sizes = length(values).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch, values
        release()


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    return next(n for i in count() if (n := f"{stem}_{i}").lower() not in taken)


def with_outputs(docs: DataFrame, needed: list[str], make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[Column]]:
    """``make`` applied to ``docs``, and the columns that give back those of ``docs``.

    Columns other than ``needed`` bear names of their own meanwhile, so neither the outputs nor the temporary
    columns of ``make`` meet them. ``needed`` ones must not be outputs of ``make``.
    """
    own = {c: c if c in needed else f"own column {i}" for i, c in enumerate(docs.columns)}
    made = make(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()]))
    return made, [F.col(f"`{n}`").alias(c) for c, n in own.items()]


def per_text(
    df: DataFrame, column: str, fields: str, make: Callable[[list], list[list]], most: int = 2 << 20
) -> DataFrame:
    """Append the columns of the DDL string ``fields``: ``make(texts)`` gives a list of values for each.

    Columns of ``df`` that clash with the new names (in any case) are dropped first. Each task handles
    batches of about ``most`` bytes of text, so memory doesn't grow with the partition.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType, _parse_datatype_string

    new: StructType = _parse_datatype_string(fields)
    taken = {f.name.lower() for f in new}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
    out = StructType([*df.schema.fields, *new.fields])
    types = [to_arrow_type(f.dataType) for f in new]
    names = [f.name for f in out]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, most):
            got = make(part.column(column).to_pylist())
            made = [pa.array(v, t) for v, t in zip(got, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names)

    return df.mapInArrow(run, out)


def small_join(left: DataFrame, small: DataFrame, rows: int, on, how: str = "inner") -> DataFrame:
    """Join with a table of ``rows`` rows: broadcast up to BROADCAST_ROWS, by shuffle beyond."""
    return left.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)
