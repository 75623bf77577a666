"""The 31 table operators."""

from __future__ import annotations

from millrace.errors import OperatorError
from millrace.operators import aggregation, cleaning, combination, normalization, program, reshaping, row_select, schema_edit
from millrace.operators.base import REGISTRY as OPERATORS
from millrace.operators.base import Operator, register

__all__ = ["OPERATORS", "Operator", "get_operator", "operator_manual", "operators_by_category", "register"]
_MODULES = (cleaning, normalization, schema_edit, row_select, aggregation, combination, reshaping, program)


def get_operator(name: str) -> Operator:
    """By exact name, else regardless of case."""
    if name in OPERATORS:
        return OPERATORS[name]
    for k, op in OPERATORS.items():
        if k.lower() == name.lower():
            return op
    raise OperatorError(f"unknown operator {name!r}; operators: {list(OPERATORS)}")


def operators_by_category() -> dict[str, list[Operator]]:
    out: dict[str, list[Operator]] = {}
    for op in OPERATORS.values():
        out.setdefault(op.CATEGORY, []).append(op)
    return out


def operator_manual(categories: list[str] | None = None) -> str:
    """Signatures and descriptions by category."""
    parts = []
    for category, ops in operators_by_category().items():
        if categories is None or category in categories:
            parts.append("\n".join([f"## {category}", *(op.manual() for op in ops)]))
    return "\n\n".join(parts)
