"""Running pipelines over table sets, with limits and feedback; and the tree of states that they make."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame

from millrace.errors import OperatorError
from millrace.model import Table, TableSet
from millrace.operators.base import strict
from millrace.plans.dsl import OperatorCall, parse_call, parse_pipeline, split_calls
from millrace.sources.markdown import serialize_table


@dataclass(frozen=True)
class Limits:
    """Bounds of one expansion and of each state."""

    timeout: float = 30.0
    operators: int = 20
    rows: int = 5_000_000
    tables: int = 64


@dataclass
class ExecutionResult:
    """The calls that worked with the states behind them, and the first failure."""

    applied: list[OperatorCall] = field(default_factory=list)
    states: list[TableSet] = field(default_factory=list)
    failed: str | None = None
    error: str | None = None

    @property
    def ok(self) -> bool:
        return self.error is None


class Environment:
    """Executes pipelines one operator at a time.

    States are lazy plans; what an operator changed is counted (up to the row limit) so that errors of the
    data appear with the operator that caused them. Each operator's jobs run under a tag of their own and
    are cancelled when the time is up, from whatever thread they were started.
    """

    def __init__(self, limits: Limits | None = None, check_rows: bool = True):
        self.limits, self.check_rows = limits or Limits(), check_rows

    def execute(self, state: TableSet, pipeline: str | list[str | OperatorCall]) -> ExecutionResult:
        result = ExecutionResult()
        try:
            calls = self._parse(pipeline)
        except OperatorError as e:
            result.error = f"ParseError: {e}"
            return result
        if not calls:
            result.error = "EmptyPipeline: no operator call was found"
            return result
        if len(calls) > self.limits.operators:
            result.error = f"TooManyOperators: {len(calls)} operators, {self.limits.operators} at most"
            return result
        was = strict()
        strict(True)
        try:
            for call in calls:
                try:
                    new = self._step(state, call)
                except OperatorError as e:
                    result.failed, result.error = call.to_source(), str(e)
                    break
                result.applied.append(call)
                result.states.append(new)
                state = new
        finally:
            strict(was)
        return result

    @staticmethod
    def _parse(pipeline) -> list[OperatorCall]:
        if isinstance(pipeline, str):
            return parse_pipeline(pipeline)
        return [c if isinstance(c, OperatorCall) else parse_call(c) for c in pipeline]

    def _step(self, state: TableSet, call: OperatorCall) -> TableSet:
        spark = next((t.df.sparkSession for t in state.values()), None)
        if spark is None:
            return call.execute(state)
        tag, late = f"millrace-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            spark.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(self.limits.timeout, stop)
        timer.daemon = True
        spark.sparkContext.addJobTag(tag)
        timer.start()
        try:
            new = call.execute(state)
            self._check(state, new)
        except OperatorError:
            if late.is_set():
                raise OperatorError(f"Timeout: {call.op.NAME} took over {self.limits.timeout:g} s") from None
            raise
        except Exception as e:
            if late.is_set():
                raise OperatorError(f"Timeout: {call.op.NAME} took over {self.limits.timeout:g} s") from None
            raise OperatorError(f"{call.op.NAME}: {type(e).__name__}: {str(e).strip().splitlines()[0] if str(e) else ''}") from e
        finally:
            timer.cancel()
            spark.sparkContext.removeJobTag(tag)
        if late.is_set():
            raise OperatorError(f"Timeout: {call.op.NAME} took over {self.limits.timeout:g} s")
        return new

    def _check(self, old: TableSet, new: TableSet) -> None:
        if len(new) > self.limits.tables:
            raise OperatorError(f"StateTooLarge: {len(new)} tables, {self.limits.tables} at most")
        if not self.check_rows:
            return
        for name, t in new.items():
            if name not in old or old[name].df is not t.df:
                n = t.df.limit(self.limits.rows + 1).count()
                if n > self.limits.rows:
                    raise OperatorError(f"StateTooLarge: table {name!r} has over {self.limits.rows} rows")


def render_feedback(result: ExecutionResult, rows: int = 5) -> str:
    """What was applied, a sample of the last state's newest table, and the failure."""
    lines = [f"OK {c.to_source()}" for c in result.applied]
    if result.states:
        lines += ["", "\n\n".join(serialize_table(t, rows) for t in result.states[-1].values())]
    if result.failed:
        lines.append(f"FAILED {result.failed}")
    if result.error:
        lines.append(f"ERROR {result.error}")
    return "\n".join(lines)


def result_table(state: TableSet, calls: list[OperatorCall], before: TableSet) -> Table | None:
    """The answer if one is marked; else the newest new table; else the table that the last operator names."""
    if state.answer:
        return state[state.answer]
    new = [n for n in state if n not in before]
    if new:
        return state[new[-1]]
    for call in reversed(calls):
        name = call.params.get("table", call.params.get("left"))
        if isinstance(name, str) and name in state:
            return state[name]
    return state[state.names[-1]] if len(state) else None


@lru_cache(maxsize=8192)
def canonical(source: str) -> str:
    """A call's form by its bound parameters; the text itself where it doesn't parse."""
    try:
        return parse_call(source).canonical()
    except OperatorError:
        return " ".join(source.split())


@dataclass
class Node:
    """A state in the tree; a failed expansion has an error and no state."""

    id: str
    parent: Node | None = None
    op: str = ""
    state: TableSet | None = None
    error: str | None = None
    children: list[Node] = field(default_factory=list)
    turn: int = 0

    @property
    def path(self) -> list[Node]:
        """From the root's child to this node."""
        return [*self.parent.path, self] if self.parent else []

    @property
    def operators(self) -> list[str]:
        return [n.op for n in self.path]


class ReasoningTree:
    """States reached so far. Shared prefixes are shared plans; a state that gets a second child is kept until ``release``."""

    def __init__(self, sources: TableSet):
        self.root = Node("n0", state=sources)
        self.nodes = {"n0": self.root}
        self.kept: list[DataFrame] = []

    def release(self) -> None:
        """Give back the executors' memory. States stay valid: they are plans, made again when they are asked for."""
        while self.kept:
            self.kept.pop().unpersist()

    def __enter__(self) -> ReasoningTree:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def expand(self, parent: Node, result: ExecutionResult, turn: int = 0) -> list[Node]:
        """A chain of nodes below ``parent``; steps that are there already are reused."""
        made, at = [], parent
        for call, state in zip(result.applied, result.states, strict=True):
            same = next((c for c in at.children if c.state is not None and canonical(c.op) == canonical(call.to_source())), None)
            at = same or self._add(at, call.to_source(), state, None, turn)
            made.append(at)
        if result.error is not None:
            made.append(self._add(at, result.failed or "", None, result.error, turn))
        return made

    def _add(self, parent: Node, op: str, state: TableSet | None, error: str | None, turn: int) -> Node:
        node = Node(f"n{len(self.nodes)}", parent, op, state, error, turn=turn)
        self.nodes[node.id] = node
        parent.children.append(node)
        if len([c for c in parent.children if c.state is not None]) == 2 and parent.parent is not None and parent.state is not None:
            for name, t in parent.state.items():
                if parent.parent.state is None or parent.parent.state.get(name) is not t:
                    self.kept.append(t.df.persist())
        return node

    def resolve(self, prefix: str | list[str]) -> tuple[Node, str | None]:
        """The node that a prefix of operator calls (or a node id) names, and a warning if it isn't exact."""
        text = prefix.strip() if isinstance(prefix, str) else ""
        if text.startswith("n") and text[1:].isdigit():
            node = self.nodes.get(text)
            if node is None or node.state is None:
                return self.root, f"UnknownNode: {text} is no state of the tree; the root is used"
            return node, None
        calls = split_calls(prefix) if isinstance(prefix, str) else list(prefix)
        node, done = self.longest_prefix(calls)
        if done == len(calls):
            return node, None
        names = [c.split("(")[0].strip().lower() for c in calls]
        coarse = [n for n in self.nodes.values() if n.state is not None and [o.split("(")[0].strip().lower() for o in n.operators] == names]
        if len(coarse) == 1:
            return coarse[0], f"InexactPrefix: taken as {coarse[0].id}, whose operators are the same but not their parameters"
        return node, f"PrefixMismatch: only {done} of {len(calls)} operators are known; {node.id} is used"

    def longest_prefix(self, calls: list[str]) -> tuple[Node, int]:
        """The deepest state that exactly these calls lead to, and how many of them."""
        node = self.root
        for k, call in enumerate(calls):
            step = next((c for c in node.children if c.state is not None and canonical(c.op) == canonical(call)), None)
            if step is None:
                return node, k
            node = step
        return node, len(calls)

    def leaves(self) -> list[Node]:
        return [n for n in self.nodes.values() if n.state is not None and not any(c.state is not None for c in n.children)]

    def render(self, most: int = 60) -> str:
        lines: list[str] = []

        def walk(node: Node, indent: str) -> None:
            if len(lines) >= most:
                return
            told = "sources" if node is self.root else node.op
            mark = f"  FAILED {node.error}" if node.error else ""
            lines.append(f"{indent}{node.id} {told}{mark}")
            for c in node.children:
                walk(c, indent + "  ")

        walk(self.root, "")
        if len(self.nodes) > most:
            lines.append(f"... {len(self.nodes) - most} more")
        return "\n".join(lines)
