"""Errors whose prefixes are part of the feedback that steers callers."""


class OperatorError(Exception):
    """An operator, its parameters or its data are not fit."""


def missing_table(name: str, have: list[str]) -> OperatorError:
    return OperatorError(f"MissingTable: no table {name!r}; available tables: {have}")


def missing_column(table: str, name: str, have: list[str]) -> OperatorError:
    return OperatorError(f"MissingColumn: table {table!r} has no column {name!r}; its columns: {have}")
