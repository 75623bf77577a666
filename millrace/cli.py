"""Command line: operators, demo, run, eval, pipeline, synthesize, build-op-syntax, distill."""

from __future__ import annotations

import argparse
import json
import os
import sys

from millrace.operators import operator_manual
from millrace.session import get_spark


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("operators", help="print the operator manual")
    sub.add_parser("demo", help="replay a scripted run with a failure and a step back")
    for name, told in (("run", "solve one task"), ("eval", "solve all tasks and report")):
        c = sub.add_parser(name, help=told)
        c.add_argument("tasks")
        c.add_argument("--model", default="")
        c.add_argument("--script", help="a JSON list of replies, in place of a model")
        c.add_argument("--solver", default="tree", choices=("tree", "codegen", "plan", "react", "search"))
        c.add_argument("--out")
    c = sub.add_parser("pipeline", help="run a pipeline file over a task's sources")
    c.add_argument("tasks")
    c.add_argument("pipeline")
    c = sub.add_parser("synthesize", help="make tasks from questions over SQLite databases")
    c.add_argument("benchmark")
    c.add_argument("root")
    c.add_argument("out")
    c.add_argument("--limit", type=int)
    c.add_argument("--seed", type=int, default=0)
    c.add_argument("--noise-steps", type=int, default=3)
    c.add_argument("--require-noise", action="store_true")
    c.add_argument("--shuffle", action="store_true", help="take the questions in an order drawn by the seed")
    c.add_argument("--model", default="", help="asked for pipelines and corruptions; none: offline")
    c.add_argument("--stats", action="store_true")
    c = sub.add_parser("build-op-syntax", help="make operator examples from tasks")
    c.add_argument("tasks")
    c.add_argument("out")
    c.add_argument("--seed", type=int, default=0)
    c = sub.add_parser("distill", help="make examples of a teacher's best trajectories")
    c.add_argument("tasks")
    c.add_argument("out")
    c.add_argument("--model", default="")
    c.add_argument("--script", help="a JSON list of replies, in place of a model")
    c.add_argument("--judge", default="", help="a model that judges; none: by structure")
    c.add_argument("--candidates", type=int, default=4)
    c.add_argument("--keep", type=int, default=1)
    c.add_argument("--temperature", type=float, default=0.7)
    c.add_argument("--turns", type=int, default=5)
    c.add_argument("--limit", type=int)
    c.add_argument("--seed", type=int, default=0)
    a = p.parse_args(argv)
    if a.command == "operators":
        print(operator_manual())
        return 0
    return globals()[f"_{a.command.replace('-', '_')}"](get_spark(), a)


def _model(name: str, script: str | None = None):
    from millrace.agent.protocol import HttpModel, ScriptedModel

    if script:
        with open(script, encoding="utf-8") as f:
            return ScriptedModel(json.load(f))
    return HttpModel(name, os.environ["OPENAI_BASE_URL"], os.environ.get("OPENAI_API_KEY", ""))


def _demo(spark, a) -> int:
    from millrace.agent.demo import run_demo

    right, told = run_demo(spark)
    print(told)
    return int(not right)


def _distill(spark, a) -> int:
    from millrace.sources.tasks import load_tasks, write_jsonl
    from millrace.training.distill import DistillSettings, distill_tasks
    from millrace.training.judges import ModelJudge

    settings = DistillSettings(a.candidates, a.keep, a.temperature, a.turns, seed=a.seed)
    judge = ModelJudge(_model(a.judge)) if a.judge else None
    examples, stats = distill_tasks(load_tasks(spark, a.tasks)[: a.limit], _model(a.model, a.script), settings, judge)
    write_jsonl(a.out, (e.to_dict() for e in examples))
    print(json.dumps(stats.to_dict()))
    return 0


def _solver(a):
    from millrace.agent import solvers as S

    return {"tree": S.TreeAgent, "codegen": S.CodeGen, "plan": S.PlanAndSolve, "react": S.React, "search": S.TreeSearch}[a.solver](_model(a.model, a.script))


def _run(spark, a) -> int:
    from millrace.sources.markdown import serialize_table
    from millrace.sources.tasks import load_tasks

    r = _solver(a).solve(load_tasks(spark, a.tasks)[0])
    print("\n".join(r.pipeline))
    print(serialize_table(r.table, 20) if r.table is not None else r.error)
    return int(not r.completed)


def _eval(spark, a) -> int:
    from millrace.agent.evaluate import evaluate, report_table
    from millrace.sources.tasks import load_tasks

    report = evaluate(_solver(a), load_tasks(spark, a.tasks))
    print(report_table({a.solver: report}))
    if a.out:
        report.save(a.out)
    return 0


def _pipeline(spark, a) -> int:
    from millrace.plans.environment import Environment, render_feedback
    from millrace.sources.tasks import load_tasks

    with open(a.pipeline, encoding="utf-8") as f:
        result = Environment().execute(load_tasks(spark, a.tasks)[0].sources, f.read())
    print(render_feedback(result))
    return int(not result.ok)


def _synthesize(spark, a) -> int:
    from millrace.sources.sqlite import load_benchmark
    from millrace.sources.tasks import task_to_dict, write_jsonl
    from millrace.synthesis import SynthesisConfig, synthesize

    config = SynthesisConfig(seed=a.seed, noise_steps=a.noise_steps, require_noise=a.require_noise, model=_model(a.model) if a.model else None)
    tasks, stats = synthesize(spark, load_benchmark(a.benchmark, a.limit), a.root, config, a.shuffle)
    write_jsonl(a.out, map(task_to_dict, tasks))
    if a.stats:
        print(json.dumps(stats.to_dict(), indent=1))
    return 0


def _build_op_syntax(spark, a) -> int:
    from millrace.sources.tasks import load_tasks, write_jsonl
    from millrace.training import operator_examples

    write_jsonl(a.out, (e.to_dict() for t in load_tasks(spark, a.tasks) for e in operator_examples(t, a.seed)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
