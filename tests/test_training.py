"""The demo, judges, distillation, masks, prices, model-made candidates and inverses."""

import json

import pytest
from fixtures import rows

import millrace
from millrace import training
from millrace.agent.demo import GOLD, TURNS, demo_task, run_demo
from millrace.agent.protocol import LocalModel, Reply, ScriptedModel, SolveResult, Step, Turn, parse_turn
from millrace.agent.solvers import TreeAgent, TreeSearch
from millrace.metrics import PRICES, Price, api_cost, table_match
from millrace.model import TableSet, make_table
from millrace.noise import ModelInverse, inject_noise, restores
from millrace.plans.sql import propose_pipelines, search_pipeline
from millrace.sources.sqlite import run_sql
from millrace.training.distill import DistillSettings, distill_tasks
from millrace.training.judges import ModelJudge, StructuralJudge, parse_score
from millrace.training.masks import MaskedTokens, mask_conversation, only_actions


@pytest.fixture(scope="module")
def task(spark):
    return demo_task(spark)


def test_demo_and_structural_judge(spark, task):
    right, told = run_demo(spark)
    assert right and "backtracks=1" in told
    r = TreeAgent(ScriptedModel(TURNS)).solve(task)
    s = StructuralJudge().score(task, r)
    assert s.feedback_responsiveness == 1.0 and s.backtracking_justification == 1.0 and 0.7 < s.value < 1.0
    assert training.reward(r, task) == pytest.approx(0.7)
    assert training.reward(r, task, StructuralJudge()) == pytest.approx(0.7 + 0.15 * s.value)
    assert StructuralJudge().score(task, SolveResult("x")).value == 0.0
    blind = SolveResult("x", steps=[Step("", Turn(plan="p"), "ERROR MissingColumn: no column 'value'"), Step("", Turn(plan="go on"), "OK A(t)", moved=True)])
    got = StructuralJudge().score(task, blind)
    assert (got.plan_action_consistency, got.feedback_responsiveness, got.backtracking_justification) == (0.5, 0.0, 0.3)


def test_model_judge(task):
    r = SolveResult("x", steps=[Step("r" * 9000, Turn(plan="p"), "OK A(t)")])
    good = 'so {"a": 1} {"plan_action_consistency": 2, "feedback_responsiveness": 0.5, "backtracking_justification": -1, "rationale": "r"}'
    assert ModelJudge(ScriptedModel([good])).score(task, r).value == 0.5
    assert ModelJudge(ScriptedModel(["no numbers"])).score(task, r).rationale == "by structure"
    assert parse_score("{") is None

    class Broken:
        def generate(self, *a):
            raise OSError

    assert ModelJudge(Broken()).score(task, r).rationale == "by structure"
    m = ScriptedModel([good])
    ModelJudge(m, width=100).score(task, r)
    assert "8900 characters" in m.calls[0][1]["content"]


def test_distillation_keeps_the_best_correct_runs(task):
    wrong = "<plan>p</plan><answer>Count(visits)</answer>"
    teacher = ScriptedModel([wrong, *TURNS, *TURNS])
    examples, stats = distill_tasks([task], teacher, DistillSettings(candidates=3, keep=1, shuffled=False))
    assert (stats.tasks, stats.candidates, stats.correct, stats.kept, stats.with_backtrack) == (1, 3, 2, 1, 1)
    assert sum(examples[0].trainable) == 5 and examples[0].meta["backtracks"] == 1
    # Shuffled sources; a score above all keeps none.
    none, stats = distill_tasks([task], ScriptedModel(TURNS), DistillSettings(candidates=1, least_score=1.1))
    assert none == [] and stats.candidates == 1


class Letters:
    """A tokenizer of single characters with a template of headers."""

    def __call__(self, text, add_special_tokens=True, return_tensors=None):
        return {"input_ids": [[ord(c) for c in text]] if return_tensors else [ord(c) for c in text]}

    def decode(self, ids, skip_special_tokens=False):
        return "".join(map(chr, ids))

    def apply_chat_template(self, messages, tokenize=False, add_generation_prompt=False):
        return "".join(f"[{m['role']}]{m['content']}|" for m in messages) + ("[assistant]" if add_generation_prompt else "")


def test_masks():
    t = Letters()
    messages = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "<plan>p</plan>x<execute>e</execute>"}, {"role": "user", "content": "r"},
                {"role": "assistant", "content": "ok"}]
    m = mask_conversation(t, messages)
    assert t.decode(m.ids) == t.apply_chat_template(messages)
    assert [t.decode(m.ids[a:b]) for a, b in m.spans] == ["<plan>p</plan>x<execute>e</execute>|", "ok|"]
    assert sum(m.mask) == sum(x != -100 for x in m.labels())
    only = only_actions(t, m)
    assert [t.decode(only.ids[a:b]) for a, b in only.spans] == ["<plan>p</plan>", "ok|"]
    short = mask_conversation(t, messages, most=5)
    assert t.decode(short.ids) == "t]ok|" and short.mask == [0, 0, 1, 1, 1]
    assert mask_conversation(t, messages, [False] * 4).spans == [] and mask_conversation(t, []).ids == []
    with pytest.raises(ValueError, match="as long"):
        mask_conversation(t, messages, [True])
    assert only_actions(t, MaskedTokens([], [], [])).ids == []


def test_local_model():
    class Network:
        def generate(self, input_ids, **options):
            assert options["max_new_tokens"] == 9
            return [[*input_ids[0], *map(ord, "yes. STOP more")]]

    r = LocalModel(Network(), Letters()).generate([{"role": "user", "content": "q"}], max_tokens=9, stop=["STOP"])
    assert r.text == "yes. STOP" and r.prompt_tokens == len("[user]q|[assistant]") and r.completion_tokens == 14


def test_prices():
    assert len(PRICES) == 9
    assert api_cost(1_000_000, 1_000_000, "gpt-5", cached=400_000) == pytest.approx(0.6 * 1.25 + 0.4 * 0.125 + 10)
    assert api_cost(1000, 1000, "unknown") == 0.0 and api_cost(1_000_000, 0, Price(2, 3), cached=5_000_000) == pytest.approx(2.0)


def test_a_turn_may_hold_its_start_in_the_expansion():
    t = parse_turn("<plan>p</plan><expand><from>\nA(t)\n</from><ops>\nB(t)\n</ops></expand>")
    assert (t.prefix, t.expand) == ("A(t)", "B(t)")


def test_tree_search_rolls_out(task):
    """A rollout finds the rest of the pipeline; its confidence and its columns make the reward."""
    expand = f"<plan>p</plan><expand>\n{GOLD[0]}\nNope(x)\n</expand>"
    rest = "<answer>\n" + "\n".join(GOLD[1:]) + "\n</answer><score>0.9</score>"
    r = TreeSearch(ScriptedModel([expand, rest]), iterations=1).solve(task)
    assert r.completed and table_match(r.table, task.target_table) and r.pipeline == GOLD
    lost = TreeSearch(ScriptedModel(["nothing"]), iterations=2).solve(task)
    assert lost.turns == 3 and lost.table is not None


def test_candidates_of_a_model(spark, task):
    gold = run_sql(spark, task.sources, "SELECT town FROM clinics WHERE code IN (SELECT clinic FROM visits WHERE id = 5)")
    sql = "SELECT town FROM clinics WHERE code IN (SELECT clinic FROM visits WHERE id = 5)"
    good = "<pipeline>\nFilter(clinics, lambda r: r['code'] == 'C')\nSelectColumn(clinics, [town])\nTerminate([clinics])\n</pipeline>"
    m = ScriptedModel([f"<pipeline>Nope(</pipeline><pipeline>Count(clinics)</pipeline>{good}"])
    assert len(propose_pipelines(sql, task.sources, gold, m)) == 2
    assert search_pipeline(sql, task.sources, gold) is None and len(search_pipeline(sql, task.sources, gold, model=m)) == 3
    total = "SELECT TOTAL(id) AS s FROM visits"
    want = run_sql(spark, task.sources, total)
    assert want.head().s == 17.0 and search_pipeline(total, task.sources, want)


def test_inverse_of_a_model(spark):
    t = make_table(spark, "t", ([(1, "ann"), (2, "bob")], "id long, name string"))
    told = json.dumps({"kind": "shout", "corrupt": "lambda x: x + '!'", "cleaning": "ValueTransform(t, 'name', lambda x: x.replace('!', ''))"})
    import random

    made = ModelInverse(ScriptedModel([told]))(t, "name", random.Random(0))
    assert made.family == "shout" and restores(t, made)
    assert ModelInverse(ScriptedModel(["no JSON"]))(t, "name", random.Random(0)) is None
    noisy = inject_noise(TableSet([t]), 1, 1, {"id"}, families={"model_inverse": ModelInverse(ScriptedModel([told]))})
    assert noisy.families == ["shout"] and rows(noisy.tables["t"]) != rows(t)


def test_exports():
    for name in millrace.__all__:
        assert getattr(millrace, name) is not None
    for name in training.__all__:
        assert getattr(training, name) is not None
    from millrace import synthesis

    assert all(hasattr(synthesis, n) for n in synthesis.__all__)
    assert Reply("x").cached_tokens == 0


def test_commands(tmp_path, task, monkeypatch, capsys):
    from millrace import cli
    from millrace.sources.tasks import read_jsonl, save_task

    monkeypatch.setattr(cli, "get_spark", lambda: next(iter(task.sources.values())).df.sparkSession)
    assert cli.main(["demo"]) == 0 and "match=True" in capsys.readouterr().out
    save_task(task, str(tmp_path / "t.json"))
    (tmp_path / "s.json").write_text(json.dumps(TURNS))
    assert cli.main(["distill", str(tmp_path / "t.json"), str(tmp_path / "o.jsonl"), "--script", str(tmp_path / "s.json"), "--candidates", "1"]) == 0
    assert len(read_jsonl(str(tmp_path / "o.jsonl"))) == 1


def test_reward_parts(spark, task):
    """Correct, half right, malformed and unanswered runs; the settings; the same over columns."""
    right = TreeAgent(ScriptedModel(TURNS)).solve(task)
    parts = training.reward_parts(right, task, StructuralJudge())
    assert (parts.outcome, parts.partial, parts.similarity, parts.penalty) == (1.0, 0.0, 1.0, 0.0) and parts.total > 0.7
    both = training.reward_parts(right, task, None, training.RewardSettings(partial_only_when_wrong=False))
    assert both.total == pytest.approx(1.0) and both.process == 0.0
    unanswered = SolveResult("x", table=right.table, steps=[Step("", Turn(plan="p"), "OK A(t)")])
    parts = training.reward_parts(unanswered, task)
    assert (parts.outcome, parts.partial) == (0.0, 1.0) and parts.total == pytest.approx(0.3)
    assert training.reward(unanswered, task, settings=training.RewardSettings(score_unanswered=False)) == 0.0
    wrong = SolveResult("x", table=next(iter(task.sources.values())), completed=True)
    assert 0.0 < training.reward_parts(wrong, task).partial < 1.0 and training.reward(wrong, task) < 0.3
    mute = SolveResult("x", steps=[Step("", Turn(error="MissingAction: none"), ""), Step("", Turn(error="EmptyAnswer: none"), "")])
    assert training.reward(mute, task) == pytest.approx(-0.05 / 2)
    df = spark.createDataFrame([(1, 1.0, 0.5, 0, 4), (0, 0.4, None, 2, 4), (0, None, 1.0, 0, 0)], "o int, s double, p double, b int, t int")
    got = [r[0] for r in df.select(training.reward_column(*[df[c] for c in "ospbt"])).collect()]
    assert got == pytest.approx([0.7 + 0.075, 0.3 * 0.4 - 0.025, 0.15])
