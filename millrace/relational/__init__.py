"""Joins on order and inequality, windows over whole tables, grouping sets and mergeable aggregates, as DataFrame functions.

None of them puts a table, a key or a long span in one task: rows are dealt in blocks by ranges, and what
meets in one place is a row for each block.
"""

from millrace.relational.aggregates import Aggregator, aggregate_by
from millrace.relational.asof import as_of_join
from millrace.relational.groupings import cube, grouping_sets, rollup
from millrace.relational.intervals import interval_join
from millrace.relational.inequality import inequality_join
from millrace.relational.windows import ranked, rolling, running, shifted

__all__ = ["Aggregator", "aggregate_by", "as_of_join", "cube", "grouping_sets", "inequality_join", "interval_join", "ranked", "rolling", "rollup", "running", "shifted"]
