"""Tasks made from questions over databases: clean instance, verified pipeline, noise, checked again."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from millrace.metrics import table_match
from millrace.model import Table, TableSchema, Task, make_table
from millrace.noise import FAMILIES, ModelInverse, inject_noise
from millrace.plans.sql import execute_pipeline, join_keys, propose_pipelines, search_pipeline, translate, verify_pipeline
from millrace.sources.sqlite import Question, connect, database_path, load_benchmark, load_sources, referenced_tables, run_sql, table_names

__all__ = [
    "FAMILIES", "ModelInverse", "Question", "SynthesisConfig", "SynthesisStats", "execute_pipeline", "inject_noise", "join_keys",
    "load_benchmark", "propose_pipelines", "search_pipeline", "synthesize", "synthesize_task", "translate", "verify_pipeline",
]


@dataclass(frozen=True)
class SynthesisConfig:
    seed: int = 0
    max_source_rows: int = 20_000
    max_target_rows: int = 2_000
    noise_steps: int = 3
    require_noise: bool = False
    #: A model that may propose pipelines where translation gives none, and inverse corruptions.
    model: object = None


@dataclass
class SynthesisStats:
    """Tasks made, and why the other questions gave none."""

    made: int = 0
    dropped: Counter = field(default_factory=Counter)
    families: Counter = field(default_factory=Counter)
    lengths: list[int] = field(default_factory=list)

    def to_dict(self) -> dict:
        return {"made": self.made, "dropped": dict(self.dropped), "families": dict(self.families), "lengths": self.lengths}


def synthesize_task(spark: SparkSession, q: Question, root: str, config: SynthesisConfig, stats: SynthesisStats | None = None) -> Task | None:
    """One task, or None (the reason is counted)."""
    stats = stats if stats is not None else SynthesisStats()

    def drop(why: str) -> None:
        stats.dropped[why] += 1

    path = database_path(root, q.db_id)
    db = connect(path)
    names = referenced_tables(q.query, table_names(db))
    db.close()
    sources = load_sources(spark, path, names)
    if not sources:
        return drop("no_tables")
    if any(t.df.limit(config.max_source_rows + 1).count() > config.max_source_rows for t in sources.values()):
        return drop("source_too_large")
    try:
        gold = run_sql(spark, sources, q.query)
        n = gold.limit(config.max_target_rows + 1).count()
    except Exception:
        return drop("sql_failed")
    if n == 0 or n > config.max_target_rows:
        return drop("empty_target" if n == 0 else "target_too_large")
    pipeline = search_pipeline(q.query, sources, gold, model=config.model)
    if pipeline is None:
        return drop("not_translated")
    target = execute_pipeline(sources, pipeline)
    families = {**FAMILIES, "model_inverse": ModelInverse(config.model)} if config.model is not None else FAMILIES
    noisy = inject_noise(sources, config.seed, config.noise_steps, join_keys(q.query), families=families)
    if config.require_noise and not noisy.cleaner:
        return drop("no_noise")
    gold_pipeline = [*noisy.cleaner, *pipeline]
    again = execute_pipeline(noisy.tables, gold_pipeline)
    if again is None or not table_match(again, target):
        return drop("not_restored")
    stats.made += 1
    stats.families.update(noisy.families)
    stats.lengths.append(len(gold_pipeline))
    answer = make_table(spark, "target", target.ordered().toPandas()) if target.order else Table("target", target.visible)
    about = {"db_id": q.db_id, "question": q.question, "sql": q.query, "noise": noisy.families}
    schema = TableSchema(q.question, TableSchema.infer(target.visible).columns)
    return Task(f"{q.db_id}_{q.question_id}", noisy.tables, schema, answer, gold_pipeline, about)


def synthesize(
    spark: SparkSession, questions: Iterable[Question], root: str, config: SynthesisConfig | None = None, shuffle: bool = False
) -> tuple[list[Task], SynthesisStats]:
    """Tasks of all questions that can be translated and verified; ``shuffle``: in an order drawn by the seed."""
    config, stats, out = config or SynthesisConfig(), SynthesisStats(), []
    questions = list(questions)
    if shuffle:
        random.Random(config.seed).shuffle(questions)
    for i, q in enumerate(questions):
        own = replace(config, seed=config.seed + i)
        if (task := synthesize_task(spark, q, root, own, stats)) is not None:
            out.append(task)
    return out, stats
