"""A small task with a scripted model: one failure, one step back, an answer. It needs no network."""

from __future__ import annotations

from pyspark.sql import SparkSession

from millrace.agent.protocol import ScriptedModel
from millrace.agent.solvers import TreeAgent
from millrace.metrics import table_match
from millrace.model import ColumnSpec, Table, TableSchema, TableSet, Task, make_table
from millrace.plans.sql import execute_pipeline

CLEAN = "Deduplicate(visits, [id], first)"
NARROW = "SelectColumn(visits, [id, clinic])"
SPLIT = ["SplitColumn(visits, reading, [value, unit], sep=' ')", "CastType(visits, value, float)", "Filter(visits, lambda r: r['unit'] == 'kg')"]
REST = ["Join(visits, clinics, on=(clinic, code), how=inner, target=seen)", "GroupBy(seen, [town], {value: mean})", "RenameColumn(seen, {value: weight})"]
GOLD = [CLEAN, *SPLIT, *REST, "Terminate([seen])"]


def demo_task(spark: SparkSession) -> Task:
    """Mean weight by town, from visits with a double row and numbers packed with their units."""
    visits = make_table(spark, "visits", (
        [(1, "A", "70.5 kg"), (2, "A", "180 cm"), (2, "A", "180 cm"), (3, "B", "64.0 kg"), (4, "B", "58.0 kg"), (5, "C", "91.0 kg")],
        "id long, clinic string, reading string",
    ))
    clinics = make_table(spark, "clinics", ([("A", "Oslo"), ("B", "Turku"), ("C", "Oslo")], "code string, town string"))
    sources = TableSet([visits, clinics])
    target = execute_pipeline(sources, GOLD)
    schema = TableSchema("Mean weight in kg by town.", (ColumnSpec("town"), ColumnSpec("weight")))
    return Task("demo", sources, schema, Table("target", target.visible), GOLD)


def _turn(plan: str, prefix: list[str] = (), expand: list[str] = (), answer: list[str] = ()) -> str:
    lines = "\n".join
    act = f"<answer>\n{lines(answer)}\n</answer>" if answer else f"<prefix>\n{lines(prefix)}\n</prefix>\n<expand>\n{lines(expand)}\n</expand>"
    return f"<plan>{plan}</plan>\n{act}"


TURNS = [
    _turn("Visit 2 is there twice; keep one and the columns that seem to matter.", [], [CLEAN, NARROW]),
    _turn("Average the values by clinic.", [CLEAN, NARROW], ["GroupBy(visits, [clinic], {value: mean})"]),
    _turn("The error says that column value is missing: it was packed in reading, which my selection dropped. Go back before it instead.", [CLEAN], SPLIT),
    _turn("Attach the towns and average.", [CLEAN, *SPLIT], REST),
    _turn("The columns are those wanted.", answer=GOLD),
]


def run_demo(spark: SparkSession) -> tuple[bool, str]:
    """Whether the scripted run gives the target, and a report."""
    task = demo_task(spark)
    r = TreeAgent(ScriptedModel(TURNS)).solve(task)
    right = r.completed and table_match(r.table, task.target_table)
    told = [f"turns={r.turns} backtracks={r.backtracks} completed={r.completed} match={right}", *r.pipeline]
    return right, "\n".join(told)
