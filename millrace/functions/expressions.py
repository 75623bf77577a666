"""Python lambdas compiled to Columns.

Only whitelisted syntax is translated and nothing is evaluated, so the result is safe by construction and
stays inside Catalyst. Truth is two-valued as in Python: a comparison with NULL is False, ``!=`` is True.
Predicates are compiled by polarity, with ``not`` pushed inwards, so that plain comparisons reach the scan.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.model import quoted


class NotCompilable(Exception):
    """The source is outside the supported subset."""


@dataclass
class Value:
    """A Column, and its kind: text, number, truth, list, time, none or any."""

    col: Column
    kind: str
    literal: object = None
    fixed: bool = False


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "text"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.BooleanType):
        return "truth"
    if isinstance(t, T.ArrayType):
        return "list"
    return "time" if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "any"


def parse_callable(source: str) -> tuple[list[str], ast.expr]:
    """Parameters and body of a lambda, or of the last ``def`` that is one return statement."""
    try:
        tree = ast.parse(source.strip(), mode="eval").body
        if isinstance(tree, ast.Lambda):
            return [a.arg for a in [*tree.args.args, *([tree.args.vararg] if tree.args.vararg else [])]], tree.body
    except SyntaxError:
        pass
    try:
        defs = [n for n in ast.parse(source.strip()).body if isinstance(n, ast.FunctionDef)]
    except SyntaxError as e:
        raise NotCompilable(f"not Python: {e}") from e
    if not defs:
        raise NotCompilable("neither a lambda nor a def")
    body = [s for s in defs[-1].body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
    if len(body) == 1 and isinstance(body[0], ast.Return) and body[0].value is not None:
        return [a.arg for a in defs[-1].args.args], body[0].value
    raise NotCompilable("a def of more than one return statement")


def as_text(v: Value) -> Column:
    """``str(x)``, with None for NULL."""
    if v.kind == "truth":
        return F.when(v.col.isNull(), "None").when(v.col, "True").otherwise("False")
    return F.coalesce(v.col.cast("string"), F.lit("None"))


def as_number(v: Value) -> Column:
    return v.col if v.kind == "number" else F.expr("null").cast("double") if v.kind == "none" else F.trim(v.col.cast("string")).try_cast("double")


def _escape(chars: str) -> str:
    return re.sub(r"([\\\]\[^-])", r"\\\1", chars)


def strip_text(c: Column, chars: str | None = None, left: bool = True, right: bool = True) -> Column:
    """``str.strip`` and its one-sided forms: white space of all kinds, or the given characters."""
    some = r"\s" if chars is None else f"[{_escape(chars)}]"
    if left:
        c = F.regexp_replace(c, f"^{some}+", "")
    return F.regexp_replace(c, f"{some}+$", "") if right else c


def java_regex(pattern: str) -> str:
    """A Python pattern for Java: named groups differ, the rest of the common subset doesn't."""
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))


_COMPARE = {ast.Lt: "lt", ast.LtE: "le", ast.Gt: "gt", ast.GtE: "ge", ast.Eq: "eq", ast.NotEq: "ne"}
_OPPOSITE = {"lt": "ge", "le": "gt", "gt": "le", "ge": "lt"}


class Compiler:
    """Compiles the body of one callable; ``row`` names the parameter that is a row, ``cells`` the others."""

    def __init__(self, columns: dict[str, T.DataType], row: str | None = None, cells: dict[str, Value] | None = None):
        self.columns, self.row, self.cells = columns, row, cells or {}

    # Values

    def value(self, n: ast.expr) -> Value:
        method = getattr(self, f"_{type(n).__name__.lower()}", None)
        if method is None:
            raise NotCompilable(f"unsupported syntax: {ast.unparse(n)}")
        return method(n)

    def _constant(self, n: ast.Constant) -> Value:
        v = n.value
        kind = "none" if v is None else "truth" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "text"
        if kind == "text" and not isinstance(v, str):
            raise NotCompilable(f"unsupported constant {v!r}")
        return Value(F.lit(v), kind, v, True)

    def _name(self, n: ast.Name) -> Value:
        if n.id in self.cells:
            return self.cells[n.id]
        if n.id == "nan":
            return Value(F.lit(None), "none", None, True)
        raise NotCompilable(f"unknown name {n.id}")

    def column(self, name: str) -> Value:
        if name not in self.columns:
            raise KeyError(name)
        return Value(quoted(name), kind_of(self.columns[name]))

    def _is_row(self, n: ast.expr) -> bool:
        return isinstance(n, ast.Name) and n.id == self.row

    def _subscript(self, n: ast.Subscript) -> Value:
        if self._is_row(n.value) and isinstance(n.slice, ast.Constant) and isinstance(n.slice.value, str):
            return self.column(n.slice.value)
        v = self.value(n.value)
        if isinstance(n.slice, ast.Slice):
            return self._slice(v, n.slice)
        i = self._integer(n.slice)
        if v.kind == "list":
            at = F.lit(i) if i >= 0 else F.size(v.col) + i
            return Value(F.get(v.col, at), "text")
        if v.kind == "text":
            return Value(F.substring(v.col, i + 1 if i >= 0 else i, 1), "text")
        raise NotCompilable("subscript of neither text nor list")

    def _slice(self, v: Value, s: ast.Slice) -> Value:
        if s.step or v.kind != "text":
            raise NotCompilable("only plain slices of text")
        low = self._integer(s.lower) if s.lower else 0
        length = F.length(v.col)
        start = F.lit(low) if low >= 0 else F.greatest(length + low, F.lit(0))
        if s.upper is None:
            stop = length
        else:
            high = self._integer(s.upper)
            stop = F.lit(high) if high >= 0 else length + high
        return Value(F.substring(v.col, start + 1, F.greatest(stop - start, F.lit(0))), "text")

    def _integer(self, n: ast.expr) -> int:
        try:
            v = ast.literal_eval(n)
        except ValueError as e:
            raise NotCompilable("not a constant integer") from e
        if isinstance(v, int):
            return v
        raise NotCompilable("not a constant integer")

    def _text(self, n: ast.expr) -> str:
        if isinstance(n, ast.Constant) and isinstance(n.value, str):
            return n.value
        raise NotCompilable("not a constant text")

    def _binop(self, n: ast.BinOp) -> Value:
        a, b = self.value(n.left), self.value(n.right)
        op = type(n.op)
        if op is ast.Add and "text" in (a.kind, b.kind):
            if {a.kind, b.kind} - {"text", "any"}:
                raise NotCompilable("text plus something else")
            return Value(F.concat(a.col, b.col), "text")
        if op is ast.Mod and a.kind == "text":
            raise NotCompilable("text formatting")
        if not {a.kind, b.kind} <= {"number", "truth", "none", "any"}:
            raise NotCompilable("arithmetic on text")
        x, y = (v.col.cast("int") if v.kind == "truth" else v.col for v in (a, b))
        if op is ast.Add:
            out = F.try_add(x, y)
        elif op is ast.Sub:
            out = F.try_subtract(x, y)
        elif op is ast.Mult:
            out = F.try_multiply(x, y)
        elif op is ast.Div:
            out = F.try_divide(x.cast("double"), y.cast("double"))
        elif op is ast.FloorDiv:
            out = F.floor(F.try_divide(x.cast("double"), y.cast("double")))
        elif op is ast.Mod:
            out = F.when(y != 0, x - F.floor(F.try_divide(x.cast("double"), y.cast("double"))) * y)
        elif op is ast.Pow:
            out = F.pow(x, y)
        else:
            raise NotCompilable("unsupported operator")
        return Value(out, "number")

    def _unaryop(self, n: ast.UnaryOp) -> Value:
        if isinstance(n.op, ast.Not):
            return Value(self.settled(n), "truth")
        v = self.value(n.operand)
        if v.kind not in ("number", "any"):
            raise NotCompilable("sign of something that isn't a number")
        if isinstance(n.op, ast.USub):
            return Value(-v.col, "number", -v.literal if v.fixed else None, v.fixed)
        return v

    def _ifexp(self, n: ast.IfExp) -> Value:
        a, b = self.value(n.body), self.value(n.orelse)
        kind = b.kind if a.kind == "none" else a.kind
        if {a.kind, b.kind} - {kind, "none", "any"}:
            raise NotCompilable("branches of different kinds")
        return Value(F.when(self.settled(n.test), a.col).otherwise(b.col), kind)

    def _boolop(self, n: ast.BoolOp) -> Value:
        if all(self._truthy(v) for v in n.values):
            return Value(self.settled(n), "truth")
        if isinstance(n.op, ast.Or) and len(n.values) == 2:  # x or default
            a, b = map(self.value, n.values)
            empty = a.col.isNull() | ((a.col == "") if a.kind == "text" else (a.col == 0) if a.kind == "number" else F.lit(False))
            return Value(F.when(empty, b.col).otherwise(a.col), a.kind)
        raise NotCompilable("and/or of values")

    def _truthy(self, n: ast.expr) -> bool:
        if isinstance(n, (ast.Compare, ast.BoolOp)) or (isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not)):
            return True
        try:
            return self.value(n).kind == "truth"
        except NotCompilable:
            return isinstance(n, ast.Call)

    def _compare(self, n: ast.Compare) -> Value:
        return Value(self.settled(n), "truth")

    def _joinedstr(self, n: ast.JoinedStr) -> Value:
        parts = []
        for p in n.values:
            if isinstance(p, ast.FormattedValue):
                if p.format_spec or p.conversion not in (-1, 115):
                    raise NotCompilable("format specification")
                parts.append(as_text(self.value(p.value)))
            else:
                parts.append(self.value(p).col)
        return Value(F.concat(*parts), "text")

    def _list(self, n) -> Value:
        got = [self.value(x) for x in n.elts]
        if len({v.kind for v in got} - {"none"}) > 1:
            raise NotCompilable("list of different kinds")
        return Value(F.array(*[v.col for v in got]), "list")

    _tuple = _list

    # Calls

    def _call(self, n: ast.Call) -> Value:
        if n.keywords and not (isinstance(n.func, ast.Attribute) and n.func.attr in ("to_numeric", "sub", "search", "match", "fullmatch")):
            raise NotCompilable("keyword arguments")
        if isinstance(n.func, ast.Name):
            return self._function(n.func.id, n)
        if isinstance(n.func, ast.Attribute):
            if isinstance(n.func.value, ast.Name) and n.func.value.id in ("pd", "np", "math", "re") and n.func.value.id not in self.cells:
                return getattr(self, f"_in_{n.func.value.id}")(n.func.attr, n)
            if self._is_row(n.func.value) and n.func.attr == "get":
                return self.column(self._text(n.args[0]))
            return self._method(self.value(n.func.value), n.func.attr, n)
        raise NotCompilable("unsupported call")

    def _function(self, name: str, n: ast.Call) -> Value:
        args = n.args
        if name == "str":
            return Value(as_text(self.value(args[0])), "text")
        if name == "len":
            v = self.value(args[0])
            return Value(F.size(v.col) if v.kind == "list" else F.length(v.col), "number")
        if name in ("int", "float"):
            v = self.value(args[0])
            x = as_number(v).cast("double")
            return Value(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)) if name == "int" else x, "number")
        if name == "bool":
            return Value(self.settled(args[0]), "truth")
        if name == "abs":
            return Value(F.abs(self.value(args[0]).col), "number")
        if name == "round":
            digits = self._integer(args[1]) if len(args) > 1 else 0
            x = F.bround(self.value(args[0]).col, digits)
            return Value(x if len(args) > 1 else x.cast("bigint"), "number")
        if name in ("min", "max") and len(args) > 1:
            got = [self.value(a) for a in args]
            return Value((F.least if name == "min" else F.greatest)(*[v.col for v in got]), got[0].kind)
        raise NotCompilable(f"unknown function {name}")

    def _in_pd(self, name: str, n: ast.Call) -> Value:
        if name in ("isna", "isnull", "notna", "notnull"):
            c = self.value(n.args[0]).col
            return Value(c.isNull() if name in ("isna", "isnull") else c.isNotNull(), "truth")
        if name == "to_numeric":
            return Value(as_number(self.value(n.args[0])), "number")
        raise NotCompilable(f"unknown function pd.{name}")

    def _in_np(self, name: str, n: ast.Call) -> Value:
        return self._in_math("isnan" if name == "isnan" else name, n)

    def _in_math(self, name: str, n: ast.Call) -> Value:
        x = self.value(n.args[0]).col
        plain = {"sqrt": F.sqrt, "floor": F.floor, "ceil": F.ceil, "exp": F.exp, "log": F.log, "log10": F.log10, "log2": F.log2, "sin": F.sin, "cos": F.cos, "fabs": F.abs, "abs": F.abs}
        if name == "isnan":
            return Value(x.isNull(), "truth")
        if name not in plain or len(n.args) != 1:
            raise NotCompilable(f"unknown function {name}")
        return Value(plain[name](x), "number")

    def _in_re(self, name: str, n: ast.Call) -> Value:
        pattern = java_regex(self._text(n.args[0]))
        extra = [*n.args[3 if name == "sub" else 2 :], *(k.value for k in n.keywords)]
        if extra:
            if [ast.unparse(e) for e in extra] not in (["re.IGNORECASE"], ["re.I"]):
                raise NotCompilable("unsupported flags")
            pattern = f"(?i){pattern}"
        flags, body = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
        if name == "sub":
            to = re.sub(r"\\(?:g<)?(\d+)>?", r"$\1", self._text(n.args[1]).replace("$", r"\$"))
            return Value(F.regexp_replace(self.value(n.args[2]).col, pattern, to), "text")
        x = self.value(n.args[1]).col
        ends = {"search": body, "match": f"^(?:{body})", "fullmatch": f"^(?:{body})\\z"}
        if name not in ends:
            raise NotCompilable(f"unknown function re.{name}")
        return Value(x.rlike(flags + ends[name]), "truth")

    def _method(self, v: Value, name: str, n: ast.Call) -> Value:
        args = n.args
        c = v.col
        if v.kind not in ("text", "any"):
            raise NotCompilable(f"method {name} of something that isn't text")
        if name in ("strip", "lstrip", "rstrip"):
            chars = self._text(args[0]) if args else None
            return Value(strip_text(c, chars, name != "rstrip", name != "lstrip"), "text")
        if name in ("lower", "upper", "casefold"):
            return Value(F.upper(c) if name == "upper" else F.lower(c), "text")
        if name == "title":
            return Value(F.initcap(c), "text")
        if name == "capitalize":
            return Value(F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30))), "text")
        if name == "replace" and len(args) == 2:
            return Value(F.replace(c, F.lit(self._text(args[0])), F.lit(self._text(args[1]))), "text")
        if name == "split" and len(args) <= 2:
            if not args:
                return Value(F.split(strip_text(c), r"\s+"), "list")
            most = self._integer(args[1]) + 1 if len(args) > 1 else -1
            return Value(F.split(c, re.escape(self._text(args[0])), most), "list")
        if name in ("startswith", "endswith"):
            x = F.lit(self._text(args[0]))
            return Value(c.startswith(x) if name == "startswith" else c.endswith(x), "truth")
        if name == "removeprefix":
            p = self._text(args[0])
            return Value(F.when(c.startswith(p), F.substring(c, len(p) + 1, 1 << 30)).otherwise(c), "text")
        if name == "removesuffix":
            p = self._text(args[0])
            return Value(F.when(c.endswith(p), F.substring(c, F.lit(1), F.length(c) - len(p))).otherwise(c), "text")
        if name == "zfill":
            w = self._integer(args[0])
            return Value(F.when(F.length(c) < w, F.lpad(c, w, "0")).otherwise(c), "text")
        tests = {"isdigit": r"^[0-9]+\z", "isnumeric": r"^[0-9]+\z", "isalpha": r"^\p{L}+\z", "isspace": r"^\s+\z"}
        if name in tests and not args:
            return Value(c.rlike(tests[name]), "truth")
        if name == "find":
            return Value(F.locate(self._text(args[0]), c) - 1, "number")
        if name == "count":
            t = self._text(args[0])
            return Value(F.floor((F.length(c) - F.length(F.replace(c, F.lit(t), F.lit("")))) / len(t)), "number")
        raise NotCompilable(f"unknown method {name}")

    # Predicates

    def settled(self, n: ast.expr) -> Column:
        """The predicate as a value that is never NULL."""
        return F.coalesce(self.predicate(n, True), F.lit(False))

    def predicate(self, n: ast.expr, positive: bool = True) -> Column:
        """A condition that holds where Python's does (or, if not ``positive``, doesn't); NULL counts as no."""
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            return self.predicate(n.operand, not positive)
        if isinstance(n, ast.BoolOp):
            parts = [self.predicate(v, positive) for v in n.values]
            every = isinstance(n.op, ast.And) == positive
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if every else (out | p)
            return out
        if isinstance(n, ast.Compare):
            return self._comparison(n, positive)
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == "bool" and len(n.args) == 1:
            return self.predicate(n.args[0], positive)
        v = self.value(n)
        if v.kind == "truth":
            if positive:
                return v.col
            return ~F.coalesce(v.col, F.lit(False))
        # Truth of a value: NULL that came from NaN is true in Python, but is no value here.
        full = v.col.isNotNull()
        if v.kind == "text":
            full = full & (v.col != "")
        elif v.kind == "number":
            full = full & (v.col != 0)
        elif v.kind == "list":
            full = full & (F.size(v.col) > 0)
        return full if positive else ~full

    def _comparison(self, n: ast.Compare, positive: bool) -> Column:
        sides = [n.left, *n.comparators]
        parts = [self._pair(a, op, b, positive) for a, op, b in zip(sides, n.ops, sides[1:], strict=False)]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if positive else (out | p)
        return out

    def _pair(self, left: ast.expr, op: ast.cmpop, right: ast.expr, positive: bool) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            return self._membership(left, right, positive == isinstance(op, ast.In))
        a, b = self.value(left), self.value(right)
        if isinstance(op, (ast.Is, ast.IsNot)):
            if b.kind != "none":
                if b.kind == "truth" and b.fixed:
                    return a.col.eqNullSafe(b.col) if positive == isinstance(op, ast.Is) else ~a.col.eqNullSafe(b.col)
                raise NotCompilable("identity with a value")
            return a.col.isNull() if positive == isinstance(op, ast.Is) else a.col.isNotNull()
        kind = _COMPARE.get(type(op))
        if kind is None:
            raise NotCompilable("unsupported comparison")
        if "none" in (a.kind, b.kind):
            other = a if b.kind == "none" else b
            if kind in ("eq", "ne"):
                return other.col.isNull() if positive == (kind == "eq") else other.col.isNotNull()
            return F.lit(not positive)
        x, y = self._alike(a, b)
        if x is None:  # text and number are never equal in Python
            if kind not in ("eq", "ne"):
                raise NotCompilable("order of text and number")
            return F.lit(positive == (kind == "ne"))
        if kind in ("eq", "ne"):
            if positive == (kind == "eq"):
                return x == y
            return ~x.eqNullSafe(y) if a.fixed or b.fixed else ~F.coalesce(x == y, F.lit(False))
        plain = {"lt": x < y, "le": x <= y, "gt": x > y, "ge": x >= y}
        if positive:
            return plain[kind]
        out = plain[_OPPOSITE[kind]]
        for v in (a, b):
            if not v.fixed:
                out = out | v.col.isNull()
        return out

    @staticmethod
    def _alike(a: Value, b: Value) -> tuple[Column | None, Column | None]:
        kinds = {a.kind, b.kind} - {"any"}
        if kinds <= {"number", "truth"} and len(kinds) == 2:
            return a.col.cast("double"), b.col.cast("double")
        if kinds == {"time", "text"}:
            return a.col.cast("timestamp"), b.col.cast("timestamp")
        if len(kinds) == 2:
            return None, None
        return a.col, b.col

    def _membership(self, left: ast.expr, right: ast.expr, inside: bool) -> Column:
        a = self.value(left)
        if isinstance(right, (ast.List, ast.Tuple, ast.Set)):
            got = [self.value(x) for x in right.elts]
            if not all(v.fixed for v in got):
                raise NotCompilable("membership among values that aren't constant")
            none = any(v.kind == "none" for v in got)
            same = [v.literal for v in got if v.kind != "none" and (a.kind in ("any", v.kind) or {a.kind, v.kind} == {"number", "truth"})]
            found = a.col.isin(same) if same else F.lit(False)
            if none:
                found = F.coalesce(found, F.lit(False)) | a.col.isNull()
            return found if inside else ~F.coalesce(found, F.lit(False))
        b = self.value(right)
        if b.kind == "list":
            found = F.array_contains(b.col, a.col)
        elif b.kind == "text" and a.kind == "text":
            found = b.col.contains(a.col)
        else:
            raise NotCompilable("membership in neither text nor list")
        return found if inside else ~F.coalesce(found, F.lit(False))


def compile_row(source: str, columns: dict[str, T.DataType], predicate: bool = False) -> Column:
    """A callable of one row; as a predicate it is fit for ``filter`` and pushes down."""
    names, body = parse_callable(source)
    if len(names) != 1:
        raise NotCompilable("a callable of one row is wanted")
    c = Compiler(columns, row=names[0])
    return c.predicate(body) if predicate else c.value(body).col


def compile_cell(source: str, column: Column, dtype: T.DataType, predicate: bool = False) -> Value:
    """A callable of one cell."""
    names, body = parse_callable(source)
    if len(names) != 1:
        raise NotCompilable("a callable of one value is wanted")
    c = Compiler({}, cells={names[0]: Value(column, kind_of(dtype))})
    if predicate:
        return Value(c.settled(body), "truth")
    return c.value(body)


def compile_cells(source: str, columns: list[tuple[Column, T.DataType]]) -> Column:
    """A callable of several cells."""
    names, body = parse_callable(source)
    if len(names) != len(columns):
        raise NotCompilable("wrong number of parameters")
    return Compiler({}, cells={n: Value(c, kind_of(t)) for n, (c, t) in zip(names, columns, strict=True)}).value(body).col


#: Aggregates that a series method stands for.
_SERIES = {
    "mean": F.avg, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp,
    "var": F.var_samp, "median": F.median, "nunique": F.countDistinct,
}


class AggregateCompiler(Compiler):
    """Compiles a callable of a frame, or of a series, to one aggregate expression."""

    def __init__(self, columns: dict[str, T.DataType], frame: str | None, series: tuple[str, Column, T.DataType] | None = None):
        super().__init__(columns)
        self.frame, self.series = frame, series

    def _source(self, n: ast.expr) -> Value:
        if isinstance(n, ast.Subscript) and isinstance(n.value, ast.Name) and n.value.id == self.frame:
            return self.column(self._text(n.slice))
        if isinstance(n, ast.Name) and self.series and n.id == self.series[0]:
            return Value(self.series[1], kind_of(self.series[2]))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute):
            if n.func.attr == "to_numeric":
                return Value(as_number(self._source(n.args[0])), "number")
            inner = n.func.value
            if n.func.attr in ("notna", "isna", "dropna"):
                v = self._source(inner)
                if n.func.attr == "dropna":
                    return v
                return Value((v.col.isNotNull() if n.func.attr == "notna" else v.col.isNull()).cast("int"), "number")
        raise NotCompilable("not a column")

    def _call(self, n: ast.Call) -> Value:
        if isinstance(n.func, ast.Name) and n.func.id == "len" and isinstance(n.args[0], ast.Name):
            return Value(F.count(F.lit(1)), "number")
        if isinstance(n.func, ast.Name) and n.func.id in ("float", "int", "round", "abs", "str"):
            return super()._call(n)
        if isinstance(n.func, ast.Attribute) and n.func.attr in _SERIES and not n.args and not n.keywords:
            return Value(_SERIES[n.func.attr](self._source(n.func.value).col), "number")
        raise NotCompilable("not an aggregate")


def compile_statistic(source: str, columns: dict[str, T.DataType]) -> Column:
    """``lambda df: ...`` to one aggregate."""
    names, body = parse_callable(source)
    return AggregateCompiler(columns, names[0]).value(body).col


def compile_series(source: str, column: Column, dtype: T.DataType) -> Column:
    """``lambda s: ...`` over a group's values to one aggregate."""
    names, body = parse_callable(source)
    return AggregateCompiler({}, None, (names[0], column, dtype)).value(body).col
