import json
import random
import sqlite3

import pytest
from fixtures import rows

from millrace.agent.evaluate import evaluate, report_table
from millrace.agent.protocol import ScriptedModel, parse_turn
from millrace.agent.solvers import CodeGen, PlanAndSolve, React, TreeAgent, TreeSearch
from millrace.metrics import table_match
from millrace.model import Table, TableSchema, TableSet, Task, make_table
from millrace.noise import FAMILIES, Corruption, inject_noise, restores
from millrace.operators.queries import run_pipeline
from millrace.sources.markdown import serialize_table, serialize_task
from millrace.sources.sqlite import load_benchmark
from millrace.sources.tasks import load_tasks, read_jsonl, save_task, task_to_dict, write_jsonl
from millrace.streaming import run_on_stream
from millrace.synthesis import synthesize
from millrace.training import best_trajectories, group_advantages, operator_examples, perturb, reward, token_mask, trajectory_example

TOY = (
    [(1, "ann x", 1.5, "2021-01-01"), (2, "bob y", 2.5, "2021-02-01"), (3, "bob y", 3.5, "2021-02-01"), (4, "dee z", 4.5, "2021-03-01")],
    "id long, name string, score double, day string",
)


@pytest.fixture(scope="module")
def toy(spark):
    return make_table(spark, "t", TOY)


def test_every_family_restores(toy):
    worked = set()
    for name, propose in FAMILIES.items():
        for seed, c in enumerate(toy.columns):
            made = propose(toy, c, random.Random(seed))
            if made is not None and restores(toy, made):
                worked.add(name)
                break
    assert worked == set(FAMILIES)


def test_the_gate_rejects(spark, toy):
    shorter = toy.with_df(toy.df.where("id < 4"))
    assert not restores(toy, Corruption("x", shorter, ["Filter(t, lambda r: True)"], None))
    assert not restores(toy, Corruption("x", toy, ["DropNA(t)"], None))
    upper = run_pipeline(TableSet([toy]), "ValueTransform(t, name, lambda x: ' ' + x.upper())")["t"]
    assert not restores(toy, Corruption("x", upper, ["ValueTransform(t, name, lambda x: x.lower())"], "name"))
    assert restores(toy, Corruption("x", upper, ["ValueTransform(t, name, lambda x: x.strip().lower())"], "name"))


@pytest.mark.parametrize("seed", range(4))
def test_noise_is_undone_in_reverse(toy, seed):
    noisy = inject_noise(TableSet([toy]), seed, max_steps=3, protected={"id"}, attempts=6)
    assert noisy.families
    assert rows(run_pipeline(noisy.tables, "\n".join(noisy.cleaner))["t"]) == rows(toy)
    assert inject_noise(TableSet([toy]), seed, max_steps=1, attempts=6).cleaner == inject_noise(TableSet([toy]), seed, max_steps=1, attempts=6).cleaner


@pytest.fixture(scope="module")
def shop(tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    db = sqlite3.connect(root / "shop.sqlite")
    db.executescript("""CREATE TABLE customer(id INTEGER PRIMARY KEY, name TEXT, city TEXT);
    CREATE TABLE orders(id INTEGER PRIMARY KEY, customer_id INTEGER, amount REAL, status TEXT);
    INSERT INTO customer VALUES (1,'ann','Berlin'),(2,'bob','Paris'),(3,'cid','Berlin');
    INSERT INTO orders VALUES (1,1,10.5,'paid'),(2,1,20.0,'open'),(3,2,5.25,'paid'),(4,3,7.0,'paid'),(5,3,1.0,'paid');""")
    db.close()
    queries = ["SELECT c.city, SUM(o.amount) AS total FROM customer c JOIN orders o ON c.id = o.customer_id WHERE o.status = 'paid' GROUP BY c.city",
               "SELECT name FROM customer WHERE city = 'Berlin'", "SELECT COUNT(*) FROM orders", "SELECT nope FROM orders", "SELECT name FROM customer WHERE id IN (SELECT customer_id FROM orders)"]
    (root / "spec.json").write_text(json.dumps([{"db_id": "shop", "question": f"q{i}", "query": q} for i, q in enumerate(queries)]))
    return root


@pytest.fixture(scope="module")
def tasks(spark, shop):
    return synthesize(spark, load_benchmark(str(shop / "spec.json")), str(shop))


def test_synthesis_and_round_trip(spark, tasks, tmp_path):
    made, stats = tasks
    assert stats.made == len(made) == 3 and stats.dropped == {"sql_failed": 1, "not_translated": 1}
    write_jsonl(str(tmp_path / "t.jsonl"), map(task_to_dict, made))
    save_task(made[0], str(tmp_path / "t.json"))
    for again, task in zip([*load_tasks(spark, str(tmp_path / "t.jsonl")), *load_tasks(spark, str(tmp_path / "t.json"))], [*made, made[0]], strict=True):
        assert again.gold_pipeline == task.gold_pipeline and again.metadata == task.metadata
        state = run_pipeline(again.sources, "\n".join(again.gold_pipeline))
        assert table_match(state[state.answer], again.target_table)


def turn(answer=None, expand=None, prefix=""):
    act = f"<answer>{answer}</answer>" if answer else f"<prefix>{prefix}</prefix><expand>{expand}</expand>"
    return f"<think>hm</think><plan>go on</plan>{act}"


def test_turns():
    t = parse_turn("<think>x <answer>no</answer></think><plan>p</plan><expand>DropNA(t)")
    assert (t.plan, t.expand, t.answer, t.error) == ("p", "DropNA(t)", None, None)
    assert parse_turn("nothing").error.startswith("MissingAction:") and parse_turn("<answer> </answer>").error.startswith("EmptyAnswer:")
    both = parse_turn("<expand>A(t)</expand><answer>B(t)</answer>")
    assert both.answer == "B(t)" and both.expand is None


def test_solvers(spark, tasks):
    task = next(t for t in tasks[0] if t.metadata["question"] == "q1")
    gold = "\n".join(task.gold_pipeline)
    tree = TreeAgent(ScriptedModel([turn(expand="Nope(x)"), turn(expand=task.gold_pipeline[0]), turn(expand="Count(customer)", prefix=""), turn(answer=gold)]))
    r = tree.solve(task)
    assert r.completed and table_match(r.table, task.target_table) and r.turns == 4 and r.backtracks == 1
    assert reward(r, task) == pytest.approx(0.7)  # the first turn's failure isn't a missing action
    example = trajectory_example(task, r, serialize_task(task))
    assert sum(example.trainable) == 4 and len(example.messages) == len(example.trainable)
    late = TreeAgent(ScriptedModel([turn(expand=task.gold_pipeline[0])]), turns=2).solve(task)
    assert not late.completed and late.table is not None and late.turns == 3
    assert CodeGen(ScriptedModel([turn(answer="DropNA(nope)"), turn(answer=gold)])).solve(task).completed
    assert PlanAndSolve(ScriptedModel(["<plan>p</plan>", turn(answer=gold)])).solve(task).completed
    assert React(ScriptedModel([turn(expand=task.gold_pipeline[0]), turn(answer="\n".join(task.gold_pipeline[1:]))])).solve(task).completed
    assert TreeSearch(ScriptedModel([turn(expand=x) for x in task.gold_pipeline]), iterations=len(task.gold_pipeline)).solve(task).completed
    report = evaluate(CodeGen(ScriptedModel([turn(answer=gold)])), [task, task], workers=2)
    assert report.means()["correct"] == 1.0 and "| codegen | 1.000" in report_table({"codegen": report}) and report.frame(spark).count() == 2

    class Broken:
        def solve(self, task):
            raise RuntimeError("no")

    assert evaluate(Broken(), [task]).cases[0].error == "RuntimeError: no"


def test_training_data(spark, tasks, tmp_path):
    task = tasks[0][0]
    examples = operator_examples(task, seed=1)
    assert examples and [e.to_dict() for e in examples] == [e.to_dict() for e in operator_examples(task, seed=1)]
    write_jsonl(str(tmp_path / "e.jsonl"), (e.to_dict() for e in examples))
    assert len(read_jsonl(str(tmp_path / "e.jsonl"))) == len(examples)
    other = perturb(task, 3)
    state = run_pipeline(other.sources, "\n".join(other.gold_pipeline))
    assert table_match(state[state.answer], task.target_table)
    r = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", 1.0), ("c", 1.0)], "task_id string, reward double")
    got = {(x.task_id, x.reward): (round(x.advantage, 3), x.degenerate) for x in group_advantages(r).collect()}
    assert got == {("a", 1.0): (-1.0, False), ("a", 3.0): (1.0, False), ("b", 2.0): (0.0, True), ("c", 1.0): (0.0, True)}
    c = spark.createDataFrame([("a", True, 1.0, 5), ("a", True, 1.0, 3), ("a", False, 9.0, 1)], "task_id string, correct boolean, score double, turns int")
    assert [x.turns for x in best_trajectories(c).collect()] == [3]
    assert token_mask([([1, 2], False), ([3], True)], 2) == ([2, 3], [0, 1])


def test_markdown(spark):
    t = make_table(spark, "t", ([(i, "a|b\nc" * 30, None) for i in range(7)], "i long, s string, n double"), "told")
    text = serialize_table(t)
    assert "### t (7 rows x 3 columns)" in text and "told" in text and "\\|" in text and "NaN" in text and "| ... | ... | ... |" in text
    task = Task("x", TableSet([t]), TableSchema("goal"), Table("target", t.df))
    assert "target (" not in serialize_task(task) and "goal" in serialize_task(task)


def test_stream(spark, tmp_path, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = run_on_stream(stream, "e", "Filter(e, lambda r: r['value'] > 50)\nAddNewColumn(e, k, lambda r: r['event_type'].upper())\nSelectColumn(e, [event_id, k])")
    q = out.writeStream.format("memory").queryName("got").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("got").count() == spark.read.parquet(f"{sf}/events.parquet").where("value > 50").count()
    with pytest.raises(Exception, match="whole table"):
        run_on_stream(stream, "e", "Sort(e, [value])")
