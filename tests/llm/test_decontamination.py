import hashlib
import random
import re

import numpy as np
import pytest

from millrace.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items):
    out = {}
    grams = {}
    for i, t in items:
        w = WORD.findall(lower(t)) if i is not None else []
        for a in range(max(1, len(w) - 12) if w else 0):
            grams.setdefault(tuple(w[a : a + 13]), set()).add(str(i))
    lengths = {len(g) for g in grams}
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if (g := tuple(w[a : a + n])) in grams:
                    hit |= set(range(a, a + n))
                    found |= grams[g]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_suffix_array_and_search():
    rng = np.random.default_rng(1)
    for n, alphabet in ((1, 1), (50, 2), (400, 3), (3000, 40)):
        text = rng.integers(1, alphabet + 1, n)
        text[n // 2 :] = text[: n - n // 2]
        full = np.append(text, 0)
        want = sorted(range(n + 1), key=lambda i: full[i:].tolist())
        assert D.suffix_array(full).tolist() == want
        index = D.FMIndex(text, alphabet, 4)
        assert sorted(index.locate(np.arange(n + 1)).tolist()) == list(range(n + 1))
        phrases = rng.integers(1, alphabet + 1, (60, 4))
        length = rng.integers(1, 5, 60)
        for p, k, low, high in zip(phrases, length, *index.search(phrases, length), strict=True):
            places = [i for i in range(n - k + 1) if text[i : i + k].tolist() == p[:k].tolist()]
            assert sorted(index.locate(np.arange(low, high)).tolist()) == places


def test_words_are_those_of_the_contract():
    for t in ["Ab-c1 ÉX_y\x7fz 你好 a\u00a0b", "", None, "<>"]:
        assert [w.decode() for w in D.words(t)] == WORD.findall(lower(t))


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([0, 1, 2, 5, 12, 13, 14, 30]))) for i in range(25)]
    items += [(7, items[3][1]), (100, items[9][1]), (101, "Short ITEM"), (None, text(20)), (102, None), (103, "...")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(120)]
    for k in range(25):
        docs.append((1000 + k, f"{text(20)}, {items[k][1].upper()} foreign! {text(9)} short item {items[k][1]}"))
    docs += [(5000, None), (5001, ""), (5002, "short"), (5003, "Item"), (5004, text(40_000))]
    return docs, items


def frames(spark, planted):
    docs, items = planted
    return (
        spark.createDataFrame([(*d, "kept") for d in docs], "doc_id long, text string, n_words string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


@pytest.mark.parametrize("block", [D.BLOCK, 600])
def test_against_brute_force(spark, planted, block):
    docs, items = frames(spark, planted)
    found = D.verdicts(D.find_contamination(docs, items, block=block)).collect()
    want = brute(*planted)
    assert len(found) == len(want)
    for r in found:
        sha = hashlib.sha256(",".join(r.item_ids).encode()).hexdigest()
        assert (r.n_words, r.n_hit, len(r.item_ids), sha, r.contaminated) == want[r.doc_id], r.doc_id


def test_no_short_items_and_empty_sides(spark, planted):
    docs, items = planted
    items = [x for x in items if len(WORD.findall(x[1] or "")) > 12]
    a, b = frames(spark, (docs, items))
    want = brute(docs, items)
    assert {r.doc_id: (r.n_words, r.n_hit) for r in D.verdicts(D.find_contamination(a, b)).collect()} == {
        d: w[:2] for d, w in want.items()
    }
    none = D.verdicts(D.find_contamination(a, b.limit(0))).collect()
    assert len(none) == len(docs) and not any(r.contaminated or r.n_hit or r.spans for r in none)
    assert D.find_contamination(a.limit(0), b).collect() == []


def test_odd_rows(spark, odd_docs):
    rows = D.verdicts(D.find_contamination(odd_docs, spark.createDataFrame([(1, "one")], "item_id long, text string")))
    got = rows.collect()
    assert len(got) == odd_docs.count()
    assert all(r.contaminated == (r.text == "one") for r in got)


def test_spans_are_removed():
    assert D.remove_spans("Äb one, Two three! four", [1, 3]) == "Äb  three! four"
    assert D.remove_spans("a b c d", [1, 3]) == "a  d"
    assert D.remove_spans(None, [0, 1]) is None and D.remove_spans("x y", []) == "x y"


def test_contamination_is_cut_out(spark, planted):
    docs, items = frames(spark, planted)
    extra = docs.withColumnsRenamed({"n_words": "spans"})
    before, hit = dict(planted[0]), {d: w[1] for d, w in brute(*planted).items()}
    got = D.remove_contamination(extra, items).collect()
    assert len(got) == len(before) and all(r.spans == "kept" for r in got)
    for r in got:
        left = len(WORD.findall(lower(r.text)))
        assert r.text == before[r.doc_id] if not hit[r.doc_id] else left == len(WORD.findall(lower(before[r.doc_id]))) - hit[r.doc_id]


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute(docs, items)
    rows = D.op2_decontamination(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want and any(r.contaminated for r in rows)
