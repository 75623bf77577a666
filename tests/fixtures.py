"""Small tables with the corner cases that operators must get right."""

from millrace.model import TableSet

PEOPLE = (
    [
        (1, " Alice ", "eng", 100.0, "2021-01-02", "a,b"), (2, "BOB", "eng", 200.0, "01/03/2021", "c"), (2, "BOB", "eng", 200.0, "01/03/2021", "c"),
        (3, "carol", "sales", None, "2021-05-06", "b,c"), (4, "dave", None, 5000.0, "2021-07-08", "a"),
    ],
    "id long, name string, dept string, salary double, joined string, tags string",
)
DEPTS = ([("eng", "Engineering"), ("sales", "Sales"), ("hr", "People")], "code string, label string")


def simple(spark) -> TableSet:
    return TableSet.of(spark, people=PEOPLE, depts=DEPTS)


def rows(table) -> list[tuple]:
    """Rows in the table's order."""
    return [tuple(r) for r in table.ordered().collect()]
