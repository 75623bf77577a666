"""strptime and strftime formats in Spark's pattern letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a directive means when formatting.
FORMAT = {
    "Y": "yyyy", "m": "MM", "d": "dd", "y": "yy", "b": "MMM", "B": "MMMM", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS",
    "p": "a", "I": "hh", "j": "DDD", "a": "E", "A": "EEEE",
}
#: When parsing, numbers needn't be padded.
PARSE = {**FORMAT, "m": "M", "d": "d", "H": "H", "M": "m", "S": "s", "I": "h", "Y": "y"}
#: Tried in turn where no input format is given; the first that fits a value holds for it.
CANDIDATES = [
    "%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%m/%d/%Y", "%m/%d/%Y %H:%M", "%m/%d/%Y %H:%M:%S",
    "%Y/%m/%d", "%d-%b-%Y", "%d %b %Y", "%d %B %Y", "%B %d, %Y", "%b %d, %Y", "%d.%m.%Y", "%Y%m%d", "%d/%m/%Y", "%m-%d-%Y",
]


def pattern(fmt: str, parsing: bool = False) -> str:
    """The Spark pattern of a strptime or strftime format; letters outside directives are quoted."""
    out, plain, i = [], "", 0
    table = PARSE if parsing else FORMAT

    def flush() -> None:
        nonlocal plain
        if plain:
            out.append("'" + plain.replace("'", "''") + "'" if any(c.isalpha() or c == "'" for c in plain) else plain)
            plain = ""

    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            i += 1
            if fmt[i] == "%":
                plain += "%"
            elif fmt[i] in table:
                flush()
                letters = table[fmt[i]]
                # Neighbouring numbers need their widths.
                out.append(FORMAT[fmt[i]] if parsing and (out and out[-1][-1:].isalpha() or fmt[i + 1 : i + 2] == "%") else letters)
            else:
                raise ValueError(f"unsupported date directive %{fmt[i]}")
        else:
            plain += fmt[i]
        i += 1
    flush()
    return "".join(out)


def parse_dates(c: Column, fmt: str | None = None, errors: str = "coerce") -> Column:
    """Timestamps without zone of a text column; by ``fmt``, or value by value among CANDIDATES."""
    text = F.trim(c.cast("string"))
    if fmt:
        p = F.lit(pattern(fmt, True))
        return (F.to_timestamp(text, pattern(fmt, True)) if errors == "raise" else F.try_to_timestamp(text, p)).cast("timestamp_ntz")
    tried = F.coalesce(*[F.try_to_timestamp(text, F.lit(pattern(f, True))) for f in CANDIDATES])
    if errors == "raise":
        tried = F.when(text.isNotNull() & tried.isNull(), F.raise_error(F.concat(F.lit("not a date: "), text)).cast("timestamp")).otherwise(tried)
    return tried.cast("timestamp_ntz")
