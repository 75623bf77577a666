"""Tables as markdown, for prompts and feedback."""

from __future__ import annotations

from millrace.model import Table, TableSchema, TableSet, Task

ROWS, COLUMNS, WIDTH = 5, 30, 60


def cell(value: object) -> str:
    text = "NaN" if value is None or value != value else str(value)
    text = text.replace("\r", " ").replace("\n", " ").replace("|", "\\|")
    return text if len(text) <= WIDTH else text[: WIDTH - 3] + "..."


def serialize_schema(schema: TableSchema) -> str:
    lines = [schema.description] if schema.description else []
    lines += [f"- {c.name}{f' ({c.dtype})' if c.dtype else ''}{f': {c.description}' if c.description else ''}" for c in schema.columns]
    return "\n".join(lines)


def serialize_table(table: Table, rows: int = ROWS, count: int | None = None) -> str:
    """Name, schema and the first rows; one bounded action, and a count unless given."""
    shown = table.columns[:COLUMNS]
    more = len(table.columns) > COLUMNS
    head = table.ordered().select(*[f"`{c}`" for c in shown]).limit(rows + 1).collect()
    n = len(head) if len(head) <= rows else table.df.count() if count is None else count
    lines = [f"### {table.name} ({n} rows x {len(table.columns)} columns)", serialize_schema(table.schema)]
    lines.append("| " + " | ".join(cell(c) for c in shown) + (" | ..." if more else "") + " |")
    lines.append("|" + " --- |" * (len(shown) + more))
    lines += ["| " + " | ".join(cell(v) for v in r) + (" | ..." if more else "") + " |" for r in head[:rows]]
    if len(head) > rows:
        lines.append("| " + " | ".join(["..."] * (len(shown) + more)) + " |")
    return "\n".join(x for x in lines if x)


def serialize_tables(tables: TableSet, rows: int = ROWS) -> str:
    return "\n\n".join(serialize_table(t, rows) for t in tables.values())


def serialize_task(task: Task, rows: int = ROWS) -> str:
    """What a solver is shown: sources and the target schema, never the true table."""
    return f"## Source tables\n\n{serialize_tables(task.sources, rows)}\n\n## Target schema\n\n{serialize_schema(task.target_schema)}"
