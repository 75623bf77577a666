import random
import re

import numpy as np
import pytest

from millrace.llm import top_k as T
from millrace.llm import url_filter as U


def brute(rows, is_query, k):
    """Whole-number scores of every pair of rows; rows of one id all count, different queries of one id each."""
    fine = [(i, tuple(int(np.floor(256 * np.float64(x))) for x in v)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({(i, v) for i, v in fine if is_query(i)}):
        fit = lambda w: min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(1 << 63)), (1 << 63) - 1)
        s = sorted((-fit(w), i) for i, w in fine if i != q and len(w) == len(v))
        out += [(q, r, i, -m) for r, (m, i) in enumerate(s[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block", "sample"), [(40, 600, 20), (T.SHARD, T.BLOCK, T.SAMPLE)])
def test_top_k(spark, shard, block, sample):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.5, -0.5, 0.0, 0.001, 0.25, 1.0]) for _ in range(6)]) for i in range(300)]
    rows += [(400 + i, [1.0] * 6) for i in range(30)]
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, []), (505, [2.0]), (506, [3.0]), (None, [1.0] * 6)]
    # Ids that several rows bear, and repeated rows.
    rows += [(2, [3.0] * 6), (3, [2.5] * 6), (3, [2.5] * 6), (3, [-2.0] * 6), (299, [1.5] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    got = T.top_k(df, df.where("vec_id % 3 = 0 or vec_id > 499"), 5, shard=shard, block=block, sample=sample).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 3 == 0 or i > 499, 5)
    assert T.top_k(df.limit(0), df).collect() == []
    assert T.top_k(df, df.limit(0)).collect() == []


def test_large_products_are_exact(spark):
    """Beyond 2**53 sums round in float64, beyond 2**63 they leave a long."""
    rng = random.Random(8)
    rows = [(i, [rng.choice([300001.51, 30000007.01, -5e6, 1.0, 7e7]) for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, [float(1 << 31) + 3 * i, 1.0, -1.0, 0.0]) for i in range(8)] + [(200, [1e30, 0.0, 0.0, 0.0]), (201, [-1e30, 1e30, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = T.top_k(df, df.where("vec_id % 2 = 0"), 5, shard=16).collect()
    want = brute(rows, lambda i: i % 2 == 0, 5)
    assert sorted(map(tuple, got)) == want and max(r[3] for r in want) == (1 << 63) - 1
    assert any((1 << 53) < r[3] < (1 << 62) for r in want)


def test_tree_prunes():
    rng = np.random.default_rng(2)
    rows = np.floor(rng.normal(size=(4000, 4)) * 256)
    tree = T.KDTree(np.arange(4000), rows, 16)
    leaves = [i for i, c in enumerate(tree.child) if not c]
    assert sum(b - a for a, b in (tree.span[i] for i in leaves)) == 4000
    seen = []
    spans = tree.span
    class Count(list):
        def __getitem__(self, i):
            seen.append(i)
            return super().__getitem__(i)
    tree.span = Count(spans)
    best = tree.search(rows[7], 7, tree.bounds(rows[7:8])[0], 5, -np.inf, exact=tree.exact(rows[7:8]))
    score = rows @ rows[7]
    score[7] = -np.inf
    assert sorted(b[0] for b in best) == sorted(score)[-5:]
    assert len(seen) < len(leaves) / 4


def test_globs():
    a = U.GlobAutomaton(["ab*c**", "*.x/", "é**", "**z", "*"])
    regexes = [r"ab[^/]*c.*", r"[^/]*\.x/", "é.*", ".*z", "[^/]*"]
    rng = random.Random(3)
    texts = ["", "abc", "ab/c", "abzzc/q", ".x/", "q.x/", "q/.x/", "é", "éz", "z" * 300, "b" * 200 + "/z"]
    texts += ["".join(rng.choices("abc/.xéz", k=rng.randrange(12))) for _ in range(400)]
    got = a.match([t.encode() for t in texts])
    for t, row in zip(texts, got, strict=True):
        assert row.tolist() == [re.fullmatch(r, t, re.S) is not None for r in regexes], t


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "HTTP://A.Example.COM/en/7x?q#f", "x://com/en/", "x://notcom/en/", "x://a.com/EN/", "x://example.net/de/8/z", "x://example.net/de/9", "x://b.org#/es/", "x://ORG/es/?", "x://o.org/a.net/de/", "x://é.org/es/ü" + "y" * 70000, "a://b://c.com/en/"]
    df = spark.createDataFrame([(i, u, "w", f"u{i}", i) for i, u in enumerate(urls)], "page_id long, url string, Rule string, u string, canonical int")
    assert sorted(U.filter_urls(df, U.RULES).select("page_id", "u", "canonical").collect()) == [(i, f"u{i}", i) for i in range(len(urls))]
    got = [tuple(r) for r in U.filter_urls(df, U.RULES).select("host", "path", "rule", "verdict").orderBy("page_id").collect()]
    def want(u):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [r for r in U.RULES for h, p in [r.text.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fit, key=lambda r: len(r.text), default=None)
        return host, path, best and best.text, best.verdict if best else "allow"
    assert got == [want(u) for u in urls]
    assert U.filter_urls(df.limit(0), U.RULES).collect() == []
    assert {r.verdict for r in U.filter_urls(df, []).collect()} == {"allow"}
    twice = U.filter_urls(df.union(df), U.RULES).select("host", "path", "rule", "verdict").collect()
    assert sorted(map(str, map(tuple, twice))) == sorted(map(str, got + got))


def test_many_rules_go_in_small_batches(spark, monkeypatch):
    rules = [U.Rule(f"host{i}.com/a", "block" if i % 2 else "allow") for i in range(300)]
    df = spark.createDataFrame([(i, f"http://x.host{i}.com/ab") for i in range(350)], "page_id long, url string")
    monkeypatch.setattr(U, "STATES", 4096)
    got = {r.page_id: (r.rule, r.verdict) for r in U.filter_urls(df, rules, "none").collect()}
    assert got == {i: (rules[i].text, rules[i].verdict) if i < 300 else (None, "none") for i in range(350)}


def test_top_k_sql_on_odd_vectors(spark):
    """The query's SQL and the operator on vectors that are empty, null, not finite, repeated or of another length."""
    import duckdb
    import pyarrow as pa

    from millrace.llm.top_k import OP9_SQL, top_k

    rng = random.Random(4)
    vectors = [[], [], None, [None, 1.0], [float("nan"), 0.0], [float("inf"), 1.0], [1.0], [2.0]]
    vectors += [[rng.uniform(-2, 2), rng.uniform(-2, 2)] for _ in range(60)] + [[0.5, 0.5]] * 8
    rows = [(10 * i, v) for i, v in enumerate(vectors)] + [(100, []), (100, [0.5, 0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([r[0] for r in rows]), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))}))
    got = top_k(df, df.where("vec_id % 50 = 0"), 5)
    columns = ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({OP9_SQL}) t").fetchall())
