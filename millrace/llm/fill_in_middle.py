"""Fill-in-the-middle: a text is cut at two of its units, and its middle is put last behind markers.

A pandas UDF over Arrow batches: the regex library's finditer gives the ends of the units (any pattern;
code points by default), which a compact array of 4 bytes a unit holds; two look-ups in it slice the text.
hashlib draws the cuts and the form from the document's id, and digests what came out. The output is
parsed back into the exact text, so what a model sees is known to be whole.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from operator import methodcaller

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import release, with_outputs

#: Characters of text handled between two releases of memory.
BATCH = 2 << 20
#: A unit: one code point, line ends included.
CODE_POINT = r"(?s)."
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"
_end = methodcaller("end")


@dataclass(frozen=True)
class Markers:
    """Texts before the prefix, the suffix and the middle."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        own = self.prefix, self.suffix, self.middle
        if not all(own) or len(set(own)) < 3:
            raise ValueError("three different texts are needed as markers")
        for a in own:
            for b in own:
                if a != b and a in b or any(a.endswith(b[:i]) for i in range(1, len(b)) if i < len(a) or a != b):
                    raise ValueError(f"marker {b!r} could begin within {a!r}, so outputs couldn't be taken apart")

    def within(self, text: str) -> bool:
        return self.prefix in text or self.suffix in text or self.middle in text


@dataclass(frozen=True)
class Rule:
    """Which share of the texts, in percent, is rearranged, and which of those with the suffix first; the seed."""

    seed: str = "1"
    rearranged: int = 90
    suffix_first: int = 20


def draws(seed: str, doc_id: object) -> list[int]:
    """Four numbers of 32 bits from the id."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(found[i : i + 8], 16) for i in range(0, 32, 8)]


def rearrange(text: str, doc_id: object, unit: regex.Pattern, marks: Markers, rule: Rule) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output) of one text; form: plain, psm or spm."""
    # Without concurrent=False the library gives up and takes back Python's lock at every unit.
    ends = array("I", map(_end, unit.finditer(text, concurrent=False)))
    n = len(ends)
    h1, h2, h3, h4 = draws(rule.seed, doc_id)
    if not text or marks.within(text) or h3 % 100 >= rule.rearranged:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    # What lies behind the last unit belongs to the suffix.
    i, j = ends[a - 1] if a else 0, ends[b - 1] if b else 0
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h4 % 100 < rule.suffix_first:
        return n, "spm", i, j - i, f"{marks.suffix}{suffix}{marks.prefix}{prefix}{marks.middle}{middle}"
    return n, "psm", i, j - i, f"{marks.prefix}{prefix}{marks.suffix}{suffix}{marks.middle}{middle}"


def restore(output: str, form: str, marks: Markers = Markers()) -> str:  # noqa: B008 - immutable
    """The text that an output of this form was made of."""
    if form == "plain":
        return output
    first, second = (marks.prefix, marks.suffix) if form == "psm" else (marks.suffix, marks.prefix)
    if not output.startswith(first):
        raise ValueError(f"no output of form {form}")
    one, _, rest = output[len(first) :].partition(second)
    other, _, middle = rest.partition(marks.middle)
    return one + middle + other if form == "psm" else other + middle + one


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _udf(unit: str, marks: Markers, rule: Rule):
    @F.pandas_udf(FIELDS)
    def made(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern, names = regex.compile(unit), [f.split()[0] for f in FIELDS.split(", ")]
        for ids, texts in parts:
            out: list[tuple] = []
            size = 0
            for doc_id, text in zip(ids, texts, strict=True):
                row = rearrange(text or "", doc_id, pattern, marks, rule)
                out.append((*row, _digest(row[4]), _digest(restore(row[4], row[1], marks))))
                size += len(row[4])
                if size > BATCH:
                    yield _frame(out, names)
                    out, size = [], 0
                    release()
            if out:
                yield _frame(out, names)

    return made


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=names)
    return made.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})


def fill_in_middle(
    docs: DataFrame, unit: str = CODE_POINT, marks: Markers = Markers(), rule: Rule = Rule(), text: str = "text", doc_id: str = "doc_id",  # noqa: B008
) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars, output and the digests of output and restored text.

    ``unit`` is a pattern whose matches, from left to right, are the units between which a text is cut; what lies
    between two matches goes with the later one. A null text counts as empty; empty texts, and those that
    hold a marker, stay plain (then prefix_chars and middle_chars are null). A null id is drawn for as an
    empty one; repeated rows and equal ids with equal texts get equal results. Columns of ``docs`` with the
    names of outputs are dropped, others are kept, whatever their names. An empty table gives no rows. Texts
    are handled whole, one at a time, with 4 bytes for each unit of the one at hand.
    """
    fields = [f.split()[0] for f in FIELDS.split(", ")]
    kept = [c for c in docs.columns if c.lower() not in fields]
    made, own = with_outputs(
        docs.select(*[F.col(f"`{c}`") for c in kept]), [text, doc_id],
        lambda d: d.withColumn("made", _udf(unit, marks, rule)(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`"))),
    )
    return made.select(*own, *[F.col("made")[f].alias(f) for f in fields])


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """All documents, cut between code points."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"
    )


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substring(t, 1, a) AS x, substring(t, a + 1, b - a) AS y, substring(t, b + 1, n - b) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
