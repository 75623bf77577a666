"""Solvers: the tree agent, and the simpler searches that it is compared with."""

from __future__ import annotations

import math
import re
import time
from dataclasses import dataclass

from millrace.agent.protocol import Model, Reply, SolveResult, Step, Turn, parse_turn, system_prompt
from millrace.errors import OperatorError
from millrace.model import Table, TableSet, Task
from millrace.plans.dsl import parse_pipeline, split_calls
from millrace.plans.environment import Environment, Node, ReasoningTree, render_feedback
from millrace.sources.markdown import serialize_tables, serialize_task


def alignment(columns: list[str], wanted: list[str]) -> float:
    """Jaccard similarity of lower-cased names."""
    a, b = {c.lower() for c in columns}, {c.lower() for c in wanted}
    return len(a & b) / len(a | b) if a | b else 1.0


def select_answer(state: TableSet, wanted: list[str]) -> Table | None:
    """The marked table, else the one whose columns fit best; later tables win ties."""
    if state.answer:
        return state[state.answer]
    return max(enumerate(state.values()), key=lambda x: alignment(x[1].columns, wanted) + 1e-6 * x[0], default=(0, None))[1]


class Solver:
    """Counts tokens and time; subclasses give ``_solve``."""

    def __init__(self, model: Model, environment: Environment | None = None, temperature: float = 0.01):
        self.model, self.environment, self.temperature = model, environment or Environment(), temperature

    def solve(self, task: Task) -> SolveResult:
        out, began = SolveResult(task.task_id), time.monotonic()
        try:
            self._solve(task, out)
        except Exception as e:
            out.error = f"{type(e).__name__}: {e}"
        out.wall_time_s = time.monotonic() - began
        return out

    def _solve(self, task: Task, out: SolveResult) -> None:
        raise NotImplementedError

    def ask(self, messages: list[dict], out: SolveResult) -> str:
        reply: Reply = self.model.generate(messages, self.temperature)
        out.prompt_tokens += reply.prompt_tokens
        out.completion_tokens += reply.completion_tokens
        out.cached_tokens += reply.cached_tokens
        return reply.text

    def run(self, task: Task, source: str, out: SolveResult, at: Node | None = None) -> str:
        """Execute a whole pipeline as the answer; feedback where it fails."""
        result = self.environment.execute(at.state if at else task.sources, source)
        if not result.ok:
            return render_feedback(result)
        return self.finish(task, result.states[-1], [*(at.operators if at else []), *(c.to_source() for c in result.applied)], out)

    @staticmethod
    def finish(task: Task, state: TableSet, pipeline: list[str], out: SolveResult) -> str:
        table = select_answer(state, task.target_schema.column_names)
        if table is None or not table.columns:
            return "EmptyAnswer: the answer has no columns"
        if table.df.isEmpty():
            return f"EmptyResult: the answer table {table.name!r} has no rows"
        out.table, out.pipeline, out.completed = table, pipeline, True
        return ""


class TreeSolver(Solver):
    """Works on a tree of states, whose kept tables are given back in the end; subclasses give ``_search``."""

    def _solve(self, task: Task, out: SolveResult) -> None:
        with ReasoningTree(task.sources) as tree:
            self._search(task, tree, out)

    def _search(self, task: Task, tree: ReasoningTree, out: SolveResult) -> None:
        raise NotImplementedError


class TreeAgent(TreeSolver):
    """Expands states of a tree, may go back to any of them, and answers with a whole pipeline."""

    def __init__(self, model: Model, environment: Environment | None = None, temperature: float = 0.01, turns: int = 5):
        super().__init__(model, environment, temperature)
        self.turns = turns

    def _search(self, task: Task, tree: ReasoningTree, out: SolveResult) -> None:
        last = None
        messages = [{"role": "system", "content": system_prompt()}, {"role": "user", "content": serialize_task(task)}]
        for k in range(self.turns + 1):
            if k == self.turns:
                messages.append({"role": "user", "content": "No turns are left: give the <answer> now."})
            text = self.ask(messages, out)
            turn = parse_turn(text)
            step = Step(text, turn)
            out.steps.append(step)
            if turn.error:
                step.feedback = turn.error
            elif turn.answer is not None:
                step.feedback = self._answer(task, tree, turn, out)
                if out.completed:
                    return
            elif k < self.turns:
                parent, warning = tree.resolve(turn.prefix)
                if last is not None and parent is not last:
                    out.backtracks += 1
                    step.moved = True
                result = self.environment.execute(parent.state, turn.expand)
                made = tree.expand(parent, result, k)
                last = next((n for n in reversed(made) if n.state is not None), parent)
                step.node = last.id
                step.feedback = "\n".join(x for x in (warning, render_feedback(result), tree.render()) if x)
            messages += [{"role": "assistant", "content": text}, {"role": "user", "content": step.feedback}]
        best = max(tree.leaves(), key=lambda n: max((alignment(t.columns, task.target_schema.column_names) for t in n.state.values()), default=0))
        out.table, out.pipeline = select_answer(best.state, task.target_schema.column_names), best.operators
        out.error = out.error or "no answer was given"

    def _answer(self, task: Task, tree: ReasoningTree, turn: Turn, out: SolveResult) -> str:
        calls = split_calls(turn.answer)
        node, done = tree.longest_prefix(calls)
        if done == len(calls):
            return self.finish(task, node.state, calls, out) if calls else "EmptyAnswer: the answer holds no operators"
        return self.run(task, "\n".join(calls[done:]), out, node)


class CodeGen(Solver):
    """One pipeline, and one repair."""

    def _solve(self, task: Task, out: SolveResult) -> None:
        messages = [{"role": "system", "content": system_prompt()}, {"role": "user", "content": f"{serialize_task(task)}\n\nGive the whole pipeline in <answer>."}]
        for _ in range(2):
            text = self.ask(messages, out)
            turn = parse_turn(text)
            feedback = turn.error or self.run(task, turn.answer or turn.expand or "", out)
            out.steps.append(Step(text, turn, feedback))
            if out.completed:
                return
            messages += [{"role": "assistant", "content": text}, {"role": "user", "content": f"{feedback}\nRepair the pipeline."}]
        out.error = out.steps[-1].feedback


class PlanAndSolve(Solver):
    """A plan in words, then the pipeline for it."""

    def _solve(self, task: Task, out: SolveResult) -> None:
        messages = [{"role": "system", "content": system_prompt()}, {"role": "user", "content": f"{serialize_task(task)}\n\nFirst write only a <plan>."}]
        plan = self.ask(messages, out)
        out.steps.append(Step(plan, Turn(plan=plan)))
        messages += [{"role": "assistant", "content": plan}, {"role": "user", "content": "Now give the whole pipeline in <answer>."}]
        text = self.ask(messages, out)
        turn = parse_turn(text)
        feedback = turn.error or self.run(task, turn.answer or turn.expand or "", out)
        out.steps.append(Step(text, turn, feedback))
        out.error = None if out.completed else feedback


class React(Solver):
    """One line of steps without going back."""

    def __init__(self, model: Model, environment: Environment | None = None, temperature: float = 0.01, turns: int = 10):
        super().__init__(model, environment, temperature)
        self.turns = turns

    def _solve(self, task: Task, out: SolveResult) -> None:
        state, done = task.sources, []
        messages = [{"role": "system", "content": system_prompt()}, {"role": "user", "content": f"{serialize_task(task)}\n\nEach turn, <expand> the present state or <answer> with what is left to do."}]
        for _ in range(self.turns):
            text = self.ask(messages, out)
            turn = parse_turn(text)
            feedback = turn.error
            if feedback is None:
                result = self.environment.execute(state, turn.expand if turn.answer is None else turn.answer)
                if result.states:
                    state = result.states[-1]
                    done += [c.to_source() for c in result.applied]
                feedback = render_feedback(result)
                if turn.answer is not None and result.ok:
                    feedback = self.finish(task, state, done, out)
            out.steps.append(Step(text, turn, feedback))
            if out.completed:
                return
            messages += [{"role": "assistant", "content": text}, {"role": "user", "content": feedback}]
        out.error = "no turns are left"


@dataclass
class _Visit:
    node: Node
    parent: _Visit | None = None
    visits: int = 0
    value: float = 0.0
    children: list[_Visit] | None = None


def _bound(v: _Visit) -> float:
    """The upper confidence bound of a child; those never visited come first."""
    return math.inf if not v.visits else v.value / v.visits + math.sqrt(2 * math.log(max(1, v.parent.visits)) / v.visits)


def _parses(call: str) -> bool:
    try:
        return bool(parse_pipeline(call))
    except OperatorError:
        return False


class TreeSearch(TreeSolver):
    """Monte Carlo tree search over single operators that the model proposes.

    Each iteration goes down by upper confidence bounds, expands a state once, and rolls out from its best
    child: the model writes the rest of the pipeline and says how sure it is. The reward is half how well the
    columns of what results fit the target's, half that confidence; what the rollout made is scored and, if
    it has rows, is an answer to choose from, but doesn't enter the tree.
    """

    def __init__(self, model: Model, environment: Environment | None = None, temperature: float = 0.7, iterations: int = 8, width: int = 3, depth: int = 8):
        super().__init__(model, environment, temperature)
        self.iterations, self.width, self.depth = iterations, width, depth

    def _search(self, task: Task, tree: ReasoningTree, out: SolveResult) -> None:
        root = _Visit(tree.root)
        best: tuple[float, TableSet | None, list[str]] = (-1.0, None, [])
        seen = [root]
        for _ in range(self.iterations):
            v = root
            while v.children:
                v = max(v.children, key=_bound)
            if v.children is None and len(v.node.path) < self.depth:
                v.children = self._children(task, tree, v, out)
                seen += v.children
                v = max(v.children, key=_bound) if v.children else v
            score, state, operators = self._rollout(task, v, out)
            if state is not None and score > best[0]:
                best = (score, state, operators)
            w: _Visit | None = v
            while w:
                w.visits, w.value, w = w.visits + 1, w.value + score, w.parent
            if v.node.state.answer and not self.finish(task, v.node.state, v.node.operators, out):
                return
        if best[1] is None:
            # No rollout gave rows: the state of the tree whose columns fit best.
            fit = lambda x: self._fit(task, x.node.state)
            w = max(seen, key=fit)
            best = (fit(w), w.node.state, w.node.operators)
        out.error = self.finish(task, best[1], best[2], out) or None

    @staticmethod
    def _fit(task: Task, state: TableSet) -> float:
        table = select_answer(state, task.target_schema.column_names)
        return alignment(table.columns, task.target_schema.column_names) if table is not None else 0.0

    def _rollout(self, task: Task, v: _Visit, out: SolveResult) -> tuple[float, TableSet | None, list[str]]:
        """The reward from a state, and the state and operators reached if their table has rows and columns."""
        ask = f"{self._told(task, v)}\n\nWrite the rest of the pipeline in <answer>, and in <score> from 0 to 1 how sure you are that it gives the target."
        text = self.ask([{"role": "system", "content": system_prompt()}, {"role": "user", "content": ask}], out)
        turn = parse_turn(text)
        out.steps.append(Step(text, turn))
        m = re.search(r"<score>[^<]*?(\d+(?:\.\d+)?|\.\d+)", text)
        sure = min(1.0, float(m[1])) if m else 0.5
        calls = [c for c in split_calls(turn.answer or "") if _parses(c)]
        blend = lambda fit, sure: 0.5 * fit + 0.5 * sure
        if not calls:
            return blend(self._fit(task, v.node.state), sure), None, []
        result = self.environment.execute(v.node.state, calls)
        if not result.ok or not result.states:
            return blend(self._fit(task, v.node.state), 0.5 * sure), None, []
        state = result.states[-1]
        table = select_answer(state, task.target_schema.column_names)
        score = blend(self._fit(task, state), sure)
        if table is None or not table.columns or table.df.isEmpty():
            return 0.5 * score, None, []
        return score, state, [*v.node.operators, *(c.to_source() for c in result.applied)]

    @staticmethod
    def _told(task: Task, v: _Visit) -> str:
        done = "\n".join(v.node.operators) or "(nothing)"
        return f"{serialize_task(task)}\n\nDone so far:\n{done}\n\nPresent state:\n{serialize_tables(v.node.state)}"

    def _children(self, task: Task, tree: ReasoningTree, v: _Visit, out: SolveResult) -> list[_Visit]:
        ask = f"{self._told(task, v)}\n\nPropose {self.width} different next operators in <expand>, one a line."
        text = self.ask([{"role": "system", "content": system_prompt()}, {"role": "user", "content": ask}], out)
        turn = parse_turn(text)
        out.steps.append(Step(text, turn))
        made = []
        for call in split_calls(turn.expand or turn.answer or "")[: self.width]:
            if not _parses(call):
                continue
            for n in tree.expand(v.node, self.environment.execute(v.node.state, call)):
                if n.state is not None:
                    made.append(_Visit(n, v))
        return made
