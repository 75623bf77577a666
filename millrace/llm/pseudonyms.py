"""PII pseudonyms by format-preserving Feistel permutations.

Values are found by pattern and then validated (check digits, number ranges, calendar). Each valid value
is permuted by a keyed Feistel network within its format: the same kind, length, separators and letter
case, and still valid. The permutation depends on the key, the kind and the value's own characters only,
so equal values get equal pseudonyms in all documents, whatever their separators, and different values
different ones. Nothing is looked up or shared between rows.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import ipaddress
import os
import re
import secrets
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from millrace.llm.common import slices

#: Rounds of the network.
ROUNDS = 8
#: Where a deployment names its key: a Spark setting, else a variable of the driver's environment.
KEY_SETTING, KEY_VARIABLE = "spark.millrace.pii.key", "MILLRACE_PII_KEY"
_made: dict[str, bytes] = {}


def private_key(spark) -> bytes:
    """The key that KEY_SETTING or KEY_VARIABLE names; without either a random one for this application alone.

    With a named key values stay linked from run to run; with a random one within the run, and nobody can
    invert them afterwards.
    """
    named = spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE)
    if named:
        return named.encode()
    return _made.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def _round(key: bytes, tweak: bytes, i: int, half: int, size: int) -> int:
    mac = hmac.digest(key, b"%s|%d|%d|%d" % (tweak, i, half, size), "sha256")
    return int.from_bytes(mac[:16], "big") % size


def permute(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(``size``).

    A Feistel network of additions over the pairs (left, right) with left below a and right below b, where
    a * b is the least such product of near-equal factors that is ``size`` or more; results outside the
    range are put through again, which ends because the network is a permutation.
    """
    if size < 2:
        return value
    a = max(2, int(size**0.5))
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for i in range(ROUNDS):
            if i % 2:
                right = (right + _round(key, tweak, i, left, b)) % b
            else:
                left = (left + _round(key, tweak, i, right, a)) % a
        value = left * b + right
        if value < size:
            return value


def _permute_digits(digits: str, key: bytes, tweak: bytes, fits: Callable[[str], bool] = lambda d: True) -> str:
    """Another string of as many digits for which ``fits`` holds; cycles until it does."""
    while True:
        digits = str(permute(int(digits), 10 ** len(digits), key, tweak)).zfill(len(digits))
        if fits(digits):
            return digits


def _refill(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def card(text: str, key: bytes) -> str | None:
    """13 to 19 digits with a right Luhn digit: the first digit and the length stay."""
    d = _only_digits(text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = d[0] + _permute_digits(d[1:-1], key, b"card%d%s" % (len(d), d[:1].encode()))
    return _refill(text, body + luhn_digit(body))


#: Country codes of one and of two digits (ITU-T E.164); the others have three.
_ONE, _TWO = "17", frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def phone(text: str, key: bytes) -> str | None:
    """A North American number, or one of another country behind its + and code, which stay.

    Of ten digits in the North American form those in the ranges in use (area and exchange start with 2 to
    9, the area doesn't end in 11) are permuted among themselves, and so are the others.
    """
    if text[0] == "+" and "(0)" in text:
        # The digit to dial within the country isn't one of the number's own.
        before, _, after = text.partition("(0)")
        new = phone(before + after, key)
        return new and f"{new[: len(before)]}(0){new[len(before) :]}"
    d = _only_digits(text)
    if text[0] == "+" and d[0] != "1":
        n = 1 if d[0] in _ONE else 2 if d[:2] in _TWO else 3
        if not 8 <= len(d) <= 15:
            return None
        return _refill(text, d[:n] + _permute_digits(d[n:], key, b"phone+%s|%d" % (d[:n].encode(), len(d))))
    lead, local = d[:-10], d[-10:]

    def in_use(x: str) -> bool:
        return x[0] > "1" and x[3] > "1" and x[1:3] != "11"

    if lead not in ("", "1") or len(local) != 10:
        return None
    used = in_use(local)
    return _refill(text, lead + _permute_digits(local, key, b"phone", lambda x: in_use(x) == used))


def social(text: str, key: bytes) -> str | None:
    """A US social security number of an area, group and serial that are issued."""

    def fits(x: str) -> bool:
        return x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"

    d = _only_digits(text)
    return _refill(text, _permute_digits(d, key, b"social", fits)) if len(d) == 9 and fits(d) else None


def address(text: str, key: bytes) -> str | None:
    """An IPv4 address in dotted decimals; each octet is of as many digits as before."""
    parts = text.split(".")
    if len(parts) != 4 or any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    spans = [{1: (0, 10), 2: (10, 90), 3: (100, 156)}[len(p)] for p in parts]
    value = size = 0
    for p, (low, n) in zip(parts, spans, strict=True):
        value, size = value * n + int(p) - low, (size or 1) * n
    value = permute(value, size, key, b"ipv4" + bytes(len(p) for p in parts))
    out = []
    for low, n in reversed(spans):
        value, k = divmod(value, n)
        out.append(str(low + k))
    return ".".join(reversed(out))


def address6(text: str, key: bytes) -> str | None:
    """An IPv6 address in groups of hexadecimal digits: groups of zero stay, others keep their number of digits.

    An address gets the same pseudonym with or without leading zeros and ``::``, in either letter case.
    """
    if "::" not in text and text.count(":") != 7 or not any(c.isdigit() for c in text):
        return None
    try:
        groups = ipaddress.IPv6Address(text).exploded.split(":")
    except ValueError:
        return None
    spans = [(1 << 4 * (len(f"{int(g, 16):x}") - 1), 1 << 4 * len(f"{int(g, 16):x}")) if int(g, 16) else (0, 1) for g in groups]
    value = size = 0
    for g, (low, high) in zip(groups, spans, strict=True):
        value, size = value * (high - low) + int(g, 16) - low, (size or 1) * (high - low)
    value = permute(value, size, key, b"ipv6" + bytes(b.bit_length() for _, b in spans))
    new = []
    for low, high in reversed(spans):
        value, k = divmod(value, high - low)
        new.append(low + k)
    new.reverse()
    before, _, after = text.partition("::")
    head, tail = ([x for x in part.split(":") if x] for part in (before, after))
    make = lambda old, n: (f"{n:X}" if old.upper() == old and old.lower() != old else f"{n:x}").zfill(len(old))
    at = len(groups) - len(tail)
    out = [":".join(map(make, head, new)), ":".join(map(make, tail, new[at:]))]
    return "::".join(out) if "::" in text else out[0]


#: The days that a date may name.
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def date(text: str, key: bytes) -> str | None:
    """A calendar date of 1900 to 2099 as Y-M-D, D.M.Y or M/D/Y.

    Dates whose month and day have as many digits are permuted among themselves, so one written without
    leading zeros keeps its length, and a date gets the same pseudonym however it is written.
    """
    sep = next(c for c in text if not c.isdigit())
    p = text.split(sep)
    order = (0, 1, 2) if len(p[0]) == 4 else (2, 0, 1) if sep == "/" else (2, 1, 0)
    try:
        old = datetime.date(*(int(p[i]) for i in order))
    except ValueError:
        return None
    if not _FIRST <= old.toordinal() <= _LAST:
        return None
    shape = lambda d: (d.month > 9, d.day > 9)
    new = old
    while True:
        new = datetime.date.fromordinal(_FIRST + permute(new.toordinal() - _FIRST, _LAST - _FIRST + 1, key, b"date"))
        if shape(new) == shape(old):
            break
    got: list[str] = [""] * 3
    for i, n in zip(order, (new.year, new.month, new.day), strict=True):
        got[i] = str(n).zfill(len(p[i]))
    return sep.join(got)


def iban(text: str, key: bytes) -> str | None:
    """Country, check digits and account: the account is permuted and the check digits made right."""
    raw = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(raw) <= 34 or number(raw[4:] + raw[:4]) % 97 != 1:
        return None
    body = characters(raw[4:], key, b"iban" + raw[:2].encode())
    check = 98 - number(f"{body}{raw[:2]}00") % 97
    it = iter(f"{raw[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in text)


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASS_OF = {c: k for k in _CLASSES for c in k}


def characters(text: str, key: bytes, tweak: bytes) -> str:
    """Every ASCII letter and digit permuted within its class, all at once; other characters stay."""
    kinds = [_CLASS_OF[c] for c in text if c in _CLASS_OF]
    value, size = 0, 1
    for c in text:
        if k := _CLASS_OF.get(c):
            value, size = value * len(k) + k.index(c), size * len(k)
    shape = "".join(str(len(k)) if k[0] != "A" else "U" for k in kinds).encode()
    value = permute(value, size, key, tweak + shape)
    out = []
    for k in reversed(kinds):
        value, i = divmod(value, len(k))
        out.append(k[i])
    it = iter(reversed(out))
    return "".join(next(it) if c in _CLASS_OF else c for c in text)


def email(text: str, key: bytes) -> str | None:
    """The local part is permuted, the domain stays."""
    local, _, domain = text.rpartition("@")
    return f"{characters(local, key, b'email' + domain.lower().encode())}@{domain}" if ".." not in text else None


def secret(text: str, key: bytes) -> str | None:
    """An access key or the value of a password, key or token: the label stays."""
    label = re.match(r"""(?i)(?:AKIA|[a-z_-]+\s*[=:]\s*["']?|[a-z]+[_-])""", text)[0]
    return label + characters(text[len(label) :], key, b"secret")


#: In order of precedence where two begin at the same place.
_KINDS: list[tuple[str, str, Callable[[str, bytes], str | None]]] = [
    ("secret", r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?i:password|passwd|secret|api[_-]?key|token)\s*[=:]\s*[\"']?[\w\-+/]{8,}|(?:sk|ghp|gho|pk)[_-][0-9A-Za-z]{16,}", secret),
    ("email", r"[A-Za-z0-9][\w.+%-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,}", email),
    ("iban", r"[A-Z]{2}\d\d(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", iban),
    ("date", r"\d{4}-\d\d?-\d\d?(?![\d-])|\d\d?[./-]\d\d?[./-]\d{4}(?!\d)", date),
    ("address", r"(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", address),
    ("address6", r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])", address6),
    ("social", r"\d{3}-\d\d-\d{4}(?![\d-])", social),
    ("card", r"\d(?:[ -]?\d){12,18}(?![\d])", card),
    ("phone", r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|\+[1-9]\d{0,14}(?:[ .-]?\(\d{1,5}\)[ .-]?\d{0,12}|(?:\.|[ -](?!\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)))\d{1,12}){0,7}(?<=\d\d)(?!\d)", phone),
]
_FIND = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(f"(?P<{n}>{p})" for n, p, _ in _KINDS) + ")", re.ASCII)
_MAY = re.compile(r"[0-9@]|(?:sk|ghp|gho|pk)[_-]|(?:password|passwd|secret|api[_-]?key|token)\s*[=:]", re.I)
_MAKE = {n: f for n, _, f in _KINDS}


@lru_cache(maxsize=1 << 14)
def _pseudonym(kind: str, text: str, key: bytes) -> str | None:
    """The pseudonym, or None where the text isn't valid; kept per worker as values repeat."""
    subkey = hashlib.sha256(key + kind.encode()).digest()
    return _MAKE[kind](text, subkey)


def pseudonymize(text: str | None, key: bytes) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with pseudonyms in place, and where they are: (from, to, kind) in characters."""
    if not text or not _MAY.search(text):
        return text, []
    out, spans, start, at = [], [], 0, 0
    while m := _FIND.search(text, at):
        kind = m.lastgroup
        if (new := _pseudonym(kind, m[0], key)) is None:
            # Not a valid value of this kind: another kind may begin here, else go on behind its first run.
            new, kind, end = _other(text, m, key)
            if new is None:
                at = end
                continue
        else:
            end = m.end()
        begin = m.start()
        out += [text[start:begin], new]
        place = (spans[-1][1] if spans else 0) + begin - start
        spans.append((place, place + len(new), kind))
        start = at = end
    return ("".join([*out, text[start:]]) if spans else text), spans


_PATTERNS = {n: re.compile(p, re.ASCII) for n, p, _ in _KINDS}
#: Kinds of which a match may hold what follows the value.
_SHORTER = {n: _PATTERNS[n] for n in ("iban", "card", "phone")}
_RUN = re.compile(r"[A-Za-z0-9]+", re.ASCII)


_BREAK = re.compile(r"[ .-]")


def _other(text: str, m: re.Match, key: bytes) -> tuple[str | None, str, int]:
    kinds = [n for n, _, _ in _KINDS]
    kinds = kinds[kinds.index(m.lastgroup) :]
    found = [(k, o[0]) for k in kinds if (o := _PATTERNS[k].match(text, m.start()))]
    # The longest matches first; then what may have a word or number behind it, up to an earlier separator.
    shorter = [(k, t[: x.start()]) for k, t in found if k in _SHORTER for x in reversed([*_BREAK.finditer(t)])]
    for kind, t in [*found[1:], *(c for c in shorter if _SHORTER[c[0]].fullmatch(c[1]))]:
        if (new := _pseudonym(kind, t, key)) is not None:
            return new, kind, m.start() + len(t)
    run = _RUN.match(text, m.start())
    return None, "", run.end() if run else m.start() + 1


def replace_private(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """Replace ``text`` by its pseudonymized form and append pii_spans array<struct<from, to, kind>>.

    Spans count characters of the new text. Null and empty texts stay and have no spans; values that fail
    validation stay. Whole texts are searched, however long; repeated rows are treated alike; an empty table
    gives no rows. An input column named pii_spans is replaced by the output, all others stay.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "pii_spans" or c == text])

    def make(texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
        got = [pseudonymize(t, key) for t in texts]
        spans = [[{"from": a, "to": b, "kind": k} for a, b, k in s] for _, s in got]
        return pa.array([t for t, _ in got], pa.string()), pa.array(spans, _SPANS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            i = b.schema.get_field_index(text)
            new, spans = make(b.column(i).to_pylist())
            yield b.set_column(i, text, new).append_column("pii_spans", spans)

    fields = T.StructType([*kept.schema.fields, T.StructField("pii_spans", from_arrow_type(_SPANS))])
    return kept.mapInArrow(run, fields)


_SPANS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("kind", pa.string())]))


def op7_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, under the application's key."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = replace_private(docs, private_key(spark))
    return done.select("doc_id", "text", F.size("pii_spans").alias("n_replaced"), "pii_spans")
