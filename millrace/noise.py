"""Reversible corruptions: each family proposes a dirty table and the operators that restore it exactly."""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.dates import pattern
from millrace.model import Table, TableSet, hidden_name, quoted
from millrace.operators import get_operator
from millrace.operators.cleaning import with_column
from millrace.operators.combination import stacked
from millrace.operators.ordering import before, numbered
from millrace.plans.dsl import parse_call
from millrace.sources.markdown import serialize_table


@dataclass
class Corruption:
    """A dirty table, the calls that clean it, and the column touched (None: rows)."""

    family: str
    table: Table
    cleaner: list[str]
    column: str | None


Family = Callable[[Table, str, random.Random], "Corruption | None"]
FAMILIES: dict[str, Family] = {}
ROW_FAMILIES = {"duplicate_rows", "null_rows", "error_sentinel", "outlier_row"}
#: Fixed values.
DATE_FORMATS = ["%m/%d/%Y", "%d-%b-%Y", "%m/%d/%y", "%B %d, %Y", "%Y/%m/%d"]
SENTINELS = ["N/A", "n/a", "unknown", "-", "???"]
PREFIXES = ["$", "#", "~", "* "]


def family(f: Family) -> Family:
    FAMILIES[f.__name__] = f
    return f


def _is_text(t: Table, c: str) -> bool:
    return isinstance(t.type_of(c), T.StringType)


def _facts(t: Table, c: str, *aggregates):
    """Rows, non-missing rows and further facts of a column, in one pass."""
    return t.df.agg(F.count(F.lit(1)).alias("rows"), F.count(quoted(c)).alias("n"), *aggregates).head()


def _every(c: str, condition) -> F.Column:
    return F.coalesce(F.min(F.when(quoted(c).isNotNull(), condition)), F.lit(False)).alias("every")


def _appended(t: Table, rows: DataFrame) -> Table:
    """The table with rows (of its visible columns) behind its own."""
    at = hidden_name()
    extra = Table(t.name, rows.withColumn(at, F.monotonically_increasing_id()), "", ((at, True),))
    made = stacked([t, extra], t.name, t.description)
    return t.with_df(made.df, made.order)


def _some_rows(t: Table, rng: random.Random, most: int) -> DataFrame:
    """Up to ``most`` rows, chosen by a seeded hash of their cells."""
    key = F.xxhash64(*[quoted(c).cast("string") for c in t.columns], F.lit(rng.randrange(1 << 30)))
    return t.visible.orderBy(key).limit(rng.randint(1, most))


@family
def date_reformat(t: Table, c: str, rng: random.Random) -> Corruption | None:
    if not _is_text(t, c):
        return None
    got = _facts(t, c, _every(c, quoted(c).rlike(r"^\d{4}-\d{2}-\d{2}$")))
    if not got.rows or got.n < got.rows or not got.every:
        return None
    fmt = rng.choice(DATE_FORMATS)
    new = F.date_format(F.try_to_timestamp(quoted(c), F.lit("yyyy-MM-dd")), pattern(fmt))
    return Corruption("date_reformat", with_column(t, c, new), [f"StandardizeDatetime({t.name}, {c!r}, format='%Y-%m-%d', input_format={fmt!r})"], c)


@family
def duplicate_rows(t: Table, c: str, rng: random.Random) -> Corruption | None:
    n = t.df.count()
    if n < 2 or t.visible.distinct().count() < n:
        return None
    return Corruption("duplicate_rows", _appended(t, _some_rows(t, rng, 3)), [f"Deduplicate({t.name}, keep=first)"], None)


@family
def null_rows(t: Table, c: str, rng: random.Random) -> Corruption | None:
    if isinstance(t.type_of(c), T.IntegralType):
        return None
    got = _facts(t, c)
    if not got.rows or got.n < got.rows:
        return None
    extra = _some_rows(t, rng, 2).withColumn(c, F.lit(None).cast(t.type_of(c)))
    return Corruption("null_rows", _appended(t, extra), [f"DropNA({t.name}, [{c!r}])"], None)


@family
def null_ffill(t: Table, c: str, rng: random.Random) -> Corruption | None:
    if not _is_text(t, c):
        return None
    got = _facts(t, c)
    if not got.rows or got.n < got.rows:
        return None
    t = t.positioned()
    above = hidden_name()
    t = t.with_df(before(t, quoted(c), above))
    half = F.pmod(F.xxhash64(*[quoted(n).cast("string") for n in t.df.columns if n != above], F.lit(rng.randrange(1 << 30))), F.lit(2)) == 0
    blank = F.coalesce((quoted(above) == quoted(c)) & half, F.lit(False))
    dirty = with_column(t, c, F.when(~blank, quoted(c)))
    dirty = dirty.with_df(dirty.df.drop(above))
    if dirty.df.where(quoted(c).isNull()).isEmpty():
        return None
    return Corruption("null_ffill", dirty, [f"MissingValueImputation({t.name}, {c!r}, ffill)"], c)


@family
def null_placeholder(t: Table, c: str, rng: random.Random) -> Corruption | None:
    if not isinstance(t.type_of(c), (T.StringType, T.LongType, T.DoubleType)):
        return None
    if t.df.where(quoted(c).isNull()).limit(1).count():
        return None
    top = t.df.groupBy(quoted(c).alias("v")).count().where("count > 1").orderBy(F.desc("count"), "v").limit(1).collect()
    if not top:
        return None
    v = top[0].v
    return Corruption("null_placeholder", with_column(t, c, F.when(quoted(c) != F.lit(v), quoted(c))), [f"MissingValueImputation({t.name}, {c!r}, constant, {v!r})"], c)


@family
def error_sentinel(t: Table, c: str, rng: random.Random) -> Corruption | None:
    if not _is_text(t, c):
        return None
    mark = rng.choice(SENTINELS)
    got = _facts(t, c, F.max(quoted(c) == mark).alias("there"))
    if not got.rows or got.there:
        return None
    extra = _some_rows(t, rng, 2).withColumn(c, F.lit(mark))
    return Corruption("error_sentinel", _appended(t, extra), [f"ErrorDetection({t.name}, {c!r}, lambda x: str(x) == {mark!r}, action='remove')"], None)


@family
def outlier_row(t: Table, c: str, rng: random.Random) -> Corruption | None:
    if not isinstance(t.type_of(c), (T.LongType, T.DoubleType)):
        return None
    got = _facts(t, c, F.min(quoted(c)).alias("low"), F.max(quoted(c)).alias("high"))
    if got.rows < 4 or got.n < got.rows:
        return None
    far = got.high + 50 * ((got.high - got.low) + max(abs(got.high), abs(got.low), 1))
    extra = _some_rows(t, rng, 1).withColumn(c, F.lit(far).cast(t.type_of(c)))
    return Corruption("outlier_row", _appended(t, extra), [f"OutlierDetection({t.name}, {c!r}, remove, iqr, 1.5)"], None)


@family
def numeric_as_text(t: Table, c: str, rng: random.Random) -> Corruption | None:
    kind = t.type_of(c)
    if not isinstance(kind, (T.LongType, T.DoubleType)):
        return None
    got = _facts(t, c)
    if not got.rows or got.n < got.rows:
        return None
    to = "int" if isinstance(kind, T.LongType) else "float"
    return Corruption("numeric_as_text", with_column(t, c, quoted(c).cast("string")), [f"CastType({t.name}, {c!r}, {to})"], c)


def _text_change(name: str, holds, change, cleaner: Callable[[str, str], str]) -> Family:
    """A family that changes each text of a column for which ``holds`` is true throughout."""

    def propose(t: Table, c: str, rng: random.Random) -> Corruption | None:
        if not _is_text(t, c):
            return None
        got = _facts(t, c, _every(c, holds(quoted(c))))
        if not got.rows or got.n < got.rows or not got.every:
            return None
        new, told = change(quoted(c), rng)
        return Corruption(name, with_column(t, c, new), [cleaner(f"{t.name}, {c!r}", told)], c)

    propose.__name__ = name
    return family(propose)


_text_change(
    "case_noise", lambda c: (F.lower(c) == c) & (F.upper(c) != c) & (F.lower(F.upper(c)) == c),
    lambda c, rng: (F.upper(c), ""), lambda at, _: f"ValueTransform({at}, lambda x: str(x).lower())",
)
_text_change(
    "whitespace_noise", lambda c: ~c.rlike(r"^\s|\s$") & (c != ""),
    lambda c, rng: (F.concat(F.lit(" " * rng.randint(1, 3)), c, F.lit(" " * rng.randint(0, 3))), ""),
    lambda at, _: f"ValueTransform({at}, lambda x: str(x).strip())",
)


def _decorate(c, rng: random.Random):
    p = rng.choice(PREFIXES)
    return F.concat(F.lit(p), c), p


_text_change("unit_decoration", lambda c: c != "", _decorate, lambda at, p: f"ValueTransform({at}, lambda x: str(x).removeprefix({p!r}))")
_text_change(
    "separator_typo", lambda c: c.contains(" ") & ~c.contains("_"),
    lambda c, rng: (F.translate(c, " ", "_"), ""), lambda at, _: f"ValueTransform({at}, lambda x: str(x).replace('_', ' '))",
)


#: Operators whose inverse a model may be asked for: those that change cells one by one.
INVERTIBLE = ("CastType", "MissingValueImputation", "StandardizeDatetime", "ValueTransform")


class ModelInverse:
    """A family whose corruption and cleaner a model writes; the gate judges it like the others.

    The corruption must be a lambda that compiles to a Column, or Python callables must be allowed.
    """

    def __init__(self, model, values: int = 12):
        self.model, self.values = model, values

    def __call__(self, t: Table, c: str, rng: random.Random) -> Corruption | None:
        op = get_operator(rng.choice(INVERTIBLE))
        some = [r[0] for r in t.ordered().select(quoted(c)).limit(self.values).collect()]
        ask = f"""Spoil column {c!r} of table {t.name!r} in a way that one call of the operator below undoes exactly, for every value.
Answer with one JSON object and nothing else:
{{"kind": "a short name", "corrupt": "lambda x: expression for one cell", "cleaning": "{op.NAME}({t.name}, {c!r}, ...)"}}

{op.manual()}

{serialize_table(t)}

Values: {", ".join(map(repr, some))}"""
        try:
            text = self.model.generate([{"role": "user", "content": ask}]).text
            told = json.loads(text[text.index("{") : text.rindex("}") + 1])
            spoil, cleaning = str(told["corrupt"]), str(told["cleaning"]).strip()
            dirty = parse_call(f"ValueTransform({t.name}, {c!r}, {spoil})").execute(TableSet([t]))[t.name]
            name = parse_call(cleaning).op.NAME
        except Exception:  # whatever the client or its text is, there is just no proposal
            return None
        return Corruption(str(told.get("kind") or f"inverse_{name}"), dirty, [cleaning], c)


def signature(t: Table) -> tuple:
    """Columns, types and rows in order, as a digest."""
    t = t.positioned()
    rows = numbered(t, "__at")
    h = F.xxhash64("__at", *[F.coalesce(quoted(c).cast("string"), F.lit("\x00")) for c in t.columns])
    return (tuple(t.visible.dtypes), *rows.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).head())


def restores(clean: Table, corruption: Corruption) -> bool:
    """The gate: cleaning gives back rows, order and types exactly, and the dirty table differs."""
    try:
        state = TableSet([corruption.table])
        for call in corruption.cleaner:
            state = parse_call(call).execute(state)
        was = signature(clean)
        return signature(corruption.table) != was and signature(state[clean.name]) == was
    except Exception:
        return False


@dataclass
class NoisyTables:
    """Dirty tables, the cleaning pipeline, and the families applied."""

    tables: TableSet
    cleaner: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)


def inject_noise(
    tables: TableSet, seed: int = 0, max_steps: int = 5, protected: set[str] = frozenset(), row_noise: bool = True,
    families: dict[str, Family] | None = None, attempts: int = 12,
) -> NoisyTables:
    """Corrupt tables by up to ``max_steps`` families that pass the gate; cleaning runs in reverse order."""
    rng = random.Random(seed)
    out = NoisyTables(tables)
    pool = {n: f for n, f in (families or FAMILIES).items() if row_noise or n not in ROW_FAMILIES}
    for _ in range(max_steps):
        for _ in range(attempts):
            t = out.tables[rng.choice(out.tables.names)]
            free = [c for c in t.columns if c not in protected]
            if not free or not pool:
                continue
            name, column = rng.choice(sorted(pool)), rng.choice(free)
            made = pool[name](t, column, rng)
            if made is None or not restores(t, made):
                continue
            out.tables = out.tables.replace(made.table)
            out.cleaner = [*made.cleaner, *out.cleaner]
            out.families.append(made.family)
            break
    return out
