"""What operators share: parameters, binding and the registry."""

from __future__ import annotations

from contextvars import ContextVar
from dataclasses import dataclass
from typing import Any, ClassVar

from millrace.errors import OperatorError, missing_column, missing_table
from millrace.model import Table, TableSet

_REQUIRED = object()


@dataclass(frozen=True)
class Param:
    """A parameter; ``many`` wraps a single value into a list; ``choices`` hold for texts."""

    name: str
    default: Any = _REQUIRED
    many: bool = False
    choices: tuple[str, ...] = ()

    @property
    def required(self) -> bool:
        return self.default is _REQUIRED


class Operator:
    """A pure function of a table set: ``apply(tables, **params)``; tables it doesn't name are carried on."""

    NAME: ClassVar[str]
    CATEGORY: ClassVar[str]
    PARAMS: ClassVar[tuple[Param, ...]] = ()
    DOC: ClassVar[str] = ""

    def apply(self, tables: TableSet, /, **params: Any) -> TableSet:
        raise NotImplementedError

    def bind(self, args: list, named: dict[str, Any]) -> dict[str, Any]:
        """Arguments by position and name as parameters with defaults."""
        if len(args) > len(self.PARAMS):
            raise OperatorError(f"{self.NAME}: unexpected parameter: {len(args)} given, {len(self.PARAMS)} at most")
        given = dict(zip((p.name for p in self.PARAMS), args, strict=False))
        known = {p.name for p in self.PARAMS}
        for k, v in named.items():
            if k not in known or k in given:
                raise OperatorError(f"{self.NAME}: unexpected parameter {k!r}; signature: {self.signature()}")
            given[k] = v
        out = {}
        for p in self.PARAMS:
            if p.name not in given and p.required:
                raise OperatorError(f"{self.NAME}: missing required parameter {p.name!r}; signature: {self.signature()}")
            v = given.get(p.name, None if p.required else p.default)
            if p.many and v is not None and not isinstance(v, (list, tuple)):
                v = [v]
            if p.many and isinstance(v, tuple):
                v = list(v)
            if p.choices and isinstance(v, str) and v not in p.choices:
                raise OperatorError(f"{self.NAME}: {p.name!r} must be one of {list(p.choices)}, not {v!r}")
            out[p.name] = v
        return out

    def signature(self) -> str:
        return f"{self.NAME}({', '.join(p.name if p.required else f'{p.name}={p.default!r}' for p in self.PARAMS)})"

    def manual(self) -> str:
        return f"{self.signature()}\n    {self.DOC}"


REGISTRY: dict[str, Operator] = {}


def register(cls: type[Operator]) -> type[Operator]:
    """Class decorator: makes an operator known by its name."""
    REGISTRY[cls.NAME] = cls()
    cls.DOC = " ".join((cls.__doc__ or "").split())
    return cls


def get_table(tables: TableSet, name: Any) -> Table:
    if not isinstance(name, str) or name not in tables:
        raise missing_table(str(name), tables.names)
    return tables[name]


def need_columns(table: Table, columns: list[str]) -> None:
    for c in columns:
        if c not in table.columns:
            raise missing_column(table.name, c, table.columns)


#: A context's own value: one thread's environment doesn't switch another's checks.
_strict: ContextVar[bool] = ContextVar("strict", default=False)


def strict(on: bool | None = None) -> bool:
    """Whether checks that need a Spark action are made; the environment switches them on while it runs."""
    if on is not None:
        _strict.set(on)
    return _strict.get()
