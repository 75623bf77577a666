"""Training data from tasks and trajectories, and the arithmetic of rewards."""

from __future__ import annotations

import importlib
import random
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.agent.protocol import SolveResult, system_prompt
from millrace.metrics import partial_similarity, table_match
from millrace.model import Table, TableSet, Task, hidden_name, quoted
from millrace.plans.dsl import parse_call
from millrace.sources.markdown import serialize_tables


@dataclass
class Example:
    """Messages, which of them are learned, and where they come from."""

    messages: list[dict]
    trainable: list[bool]
    meta: dict

    def to_dict(self) -> dict:
        return {"messages": self.messages, "trainable": self.trainable, "meta": self.meta}


def materialize_states(task: Task) -> list[TableSet]:
    """The states before, between and behind the operators of the gold pipeline, as plans."""
    states = [task.sources]
    for call in task.gold_pipeline:
        states.append(parse_call(call).execute(states[-1]))
    return states


def operator_examples(task: Task, seed: int = 0, max_span: int = 3, most: int = 6) -> list[Example]:
    """Pairs of states along the gold pipeline with the operators between them, a seeded sample of all short spans."""
    states = materialize_states(task)
    n = len(task.gold_pipeline)
    spans = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + max_span) + 1)]
    chosen = sorted(random.Random(f"{seed}:{task.task_id}").sample(spans, min(most, len(spans))))
    out = []
    for i, j in chosen:
        ask = f"## From\n\n{serialize_tables(states[i])}\n\n## To\n\n{serialize_tables(states[j])}"
        messages = [
            {"role": "system", "content": system_prompt()}, {"role": "user", "content": ask},
            {"role": "assistant", "content": "<expand>\n" + "\n".join(task.gold_pipeline[i:j]) + "\n</expand>"},
        ]
        out.append(Example(messages, [False, False, True], {"task_id": task.task_id, "span": [i, j]}))
    return out


#: Calls whose result depends on the order of rows.
_ORDERED = re.compile(r"\b(?:ffill|bfill|first|last|list|unique)\b|^(?:TopK|Deduplicate|Transpose|ExeCode)\(")


def perturb(task: Task, seed: int = 0) -> Task:
    """The same task with columns of its sources shuffled, and rows where no operator depends on their order."""
    rng = random.Random(seed)
    ordered = any(_ORDERED.search(c) for c in task.gold_pipeline)
    tables = []
    for t in task.sources.values():
        names = list(t.columns)
        rng.shuffle(names)
        if ordered:
            tables.append(t.select(*map(quoted, names)))
            continue
        at = hidden_name()
        df = t.df.select(*map(quoted, names), F.xxhash64(*[quoted(c).cast("string") for c in t.df.columns], F.lit(rng.randrange(1 << 30))).alias(at))
        tables.append(Table(t.name, df, t.description, ((at, True),)))
    return Task(f"{task.task_id}_p{seed}", TableSet(tables), task.target_schema, task.target_table, list(task.gold_pipeline), {**task.metadata, "perturbed": seed})


def trajectory_example(task: Task, result: SolveResult, first: str) -> Example:
    """A solved trajectory as a conversation; the model's turns are learned."""
    messages, learned = [{"role": "system", "content": system_prompt()}, {"role": "user", "content": first}], [False, False]
    for s in result.steps:
        messages.append({"role": "assistant", "content": s.reply})
        learned.append(True)
        if s.feedback:
            messages.append({"role": "user", "content": s.feedback})
            learned.append(False)
    return Example(messages, learned, {"task_id": task.task_id, "turns": result.turns})


def best_trajectories(candidates: DataFrame, k: int = 1) -> DataFrame:
    """Of (task_id, correct, score, turns, ...), the k best correct candidates of each task."""
    w = W.partitionBy("task_id").orderBy(F.desc("score"), "turns")
    return candidates.where("correct").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class RewardSettings:
    """Weights of the outcome, the likeness and the process, and what turns without an action cost."""

    outcome: float = 0.7
    partial: float = 0.3
    process: float = 0.15
    format: float = 0.05
    #: Likeness counts only where the outcome is wrong.
    partial_only_when_wrong: bool = True
    #: A table that was never given as the answer earns likeness, if no outcome.
    score_unanswered: bool = True


@dataclass(frozen=True)
class Reward:
    """The parts of a reward; ``similarity`` is the likeness whether it counts or not, ``penalty`` what is taken off."""

    outcome: float = 0.0
    partial: float = 0.0
    similarity: float = 0.0
    process: float = 0.0
    penalty: float = 0.0
    total: float = 0.0


def reward_parts(result: SolveResult, task: Task, judge=None, settings: RewardSettings = RewardSettings()) -> Reward:  # noqa: B008 - immutable
    """Outcome, likeness where that is wrong, and the process score of a judge if one is given, less a share for
    turns without an action. Other failures of turns cost nothing."""
    right, alike = False, 0.0
    if result.table is not None and task.target_table is not None and (result.completed or settings.score_unanswered):
        right = bool(result.completed and table_match(result.table, task.target_table))
        alike = partial_similarity(result.table, task.target_table)
    partial = 0.0 if right and settings.partial_only_when_wrong else alike
    process = judge.score(task, result).value if judge is not None and settings.process > 0 else 0.0
    bad = sum((s.turn.error or "").startswith("MissingAction") for s in result.steps)
    penalty = settings.format * bad / max(1, result.turns)
    total = settings.outcome * right + settings.partial * partial + settings.process * process - penalty
    return Reward(float(right), partial, alike, process, penalty, total)


def reward(result: SolveResult, task: Task, judge=None, settings: RewardSettings = RewardSettings()) -> float:  # noqa: B008
    """The total of ``reward_parts``."""
    return reward_parts(result, task, judge, settings).total


def reward_column(
    outcome: Column, similarity: Column, process: Column, bad: Column, turns: Column, settings: RewardSettings = RewardSettings()  # noqa: B008
) -> Column:
    """The same over columns: outcome 0 or 1, likeness, process score, turns without an action, turns. Missing ones count as 0."""
    known = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    right = known(outcome)
    partial = F.when(right > 0, F.lit(0.0)).otherwise(known(similarity)) if settings.partial_only_when_wrong else known(similarity)
    penalty = settings.format * known(bad) / F.greatest(known(turns), F.lit(1.0))
    return settings.outcome * right + settings.partial * partial + settings.process * known(process) - penalty


def group_advantages(rewards: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(task_id, reward, ...) with the advantage within each task; groups of one or without spread get 0."""
    w = W.partitionBy("task_id")
    sd, n = F.stddev_pop("reward").over(w), F.count(F.lit(1)).over(w)
    flat = (sd < eps) | (n < 2)
    return rewards.withColumn("advantage", F.when(flat, 0.0).otherwise((F.col("reward") - F.avg("reward").over(w)) / (sd + eps))).withColumn("degenerate", flat)


def token_mask(spans: list[tuple[list[int], bool]], most: int | None = None) -> tuple[list[int], list[int]]:
    """Ids and a 0/1 mask of learned ones over messages in turn; too long ones lose their beginning."""
    ids = [i for s, _ in spans for i in s]
    mask = [int(on) for s, on in spans for _ in s]
    return (ids, mask) if most is None else (ids[-most:], mask[-most:])


#: What the submodules give, found on first use.
_LAZY = {
    "DistillSettings": "distill", "DistillStats": "distill", "distill_tasks": "distill",
    "ModelJudge": "judges", "ProcessScore": "judges", "StructuralJudge": "judges", "parse_score": "judges",
    "MaskedTokens": "masks", "mask_conversation": "masks", "only_actions": "masks",
}
__all__ = [
    *_LAZY, "Example", "Reward", "RewardSettings", "best_trajectories", "group_advantages", "materialize_states", "operator_examples", "perturb", "reward",
    "reward_column", "reward_parts", "token_mask", "trajectory_example",
]


def __getattr__(name: str) -> object:
    if name in _LAZY:
        return getattr(importlib.import_module(f"millrace.training.{_LAZY[name]}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
