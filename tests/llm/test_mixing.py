import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm.mixing import BLOCK, Source, drawn, mix_sources, op12_mix_sources, permuted, shard_counts, shard_slots, share_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(rows):
    """By source, in floating point: (size, target)."""
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), list(names)
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s] + 1e-9]
        if not over:
            return {s: (sizes[s], target.get(s, left * weight[s] / total if s in free else 0.0)) for s in names}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
        if not free:
            return {s: (sizes[s], target[s]) for s in names}


def check(docs, out):
    rows, got = docs.collect(), out.collect()
    want = plain_targets(rows) if rows else {}
    shape = Counter((r.doc_id, len(WORD.findall(r.text or "")), want[r.source][0], round(want[r.source][1], 4)) for r in rows)
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 4)) for r in got) == shape
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by_id, taken = {r.doc_id: r.source for r in rows}, defaultdict(int)
    if len(by_id) == len(rows):
        for r in got:
            taken[by_id[r.doc_id]] += r.taken
        for s, (_, target) in want.items():
            assert abs(taken[s] - target) <= 0.5 + 1e-6
    return got


def test_query_and_rerun(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = check(docs, op12_mix_sources(spark, sf))
    again = mix_sources(docs.repartition(7)).taken().collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, mix_sources(odd_docs, block=16, per_shard=8, cell=3).taken())
    assert mix_sources(no_docs).taken().collect() == []
    assert mix_sources(no_docs).blocks().collect() == []


def test_shares_stop_at_three_times():
    assert share_out([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    assert share_out([1, 100, 0], [1, 1, 5]) == [3, 98, 0]
    assert share_out([0, 0], [1, 2]) == [0, 0] and share_out([], []) == []
    assert share_out([10, 10], [1, 1], most=0) == [0, 0]


def test_permutations():
    for n in (1, 2, 3, 7, 64, 65, 1000):
        seen = [permuted(np.arange(n), n, key).tolist() for key in (1, 2, 1 << 62)]
        assert all(sorted(s) == list(range(n)) for s in seen)
        assert n < 64 or len(set(map(tuple, seen))) == 3
        assert [int(permuted(np.array([i]), n, 2)[0]) for i in range(n)] == seen[1]


def test_draws_keep_to_what_is_owed():
    rng = np.random.default_rng(3)
    for _ in range(200):
        owed = rng.integers(0, 30, rng.integers(1, 8))
        n = int(rng.integers(0, owed.sum() + 1))
        got = drawn(rng, n, owed)
        assert got.sum() == n and (got <= owed).all() and (got >= 0).all()
    many = np.array([drawn(np.random.default_rng(i), 50, np.array([1000, 2000, 3000])) for i in range(400)])
    assert np.allclose(many.mean(0), [50 / 6, 100 / 6, 25], atol=0.6) and many.std(0).min() > 1.5


@pytest.mark.parametrize("words", [(10, 25, 0, 7, 4), (100, 3, 3, 3), (8,), (64, 64)])
def test_slots_take_every_block_evenly(words):
    """All shards together against a count of words: passes, cut blocks, and shards found one by one."""
    targets = share_out(list(words), [i % 3 + 1 for i in range(len(words))])
    sources = [Source(str(i), n, float(t), round(t), 4) for i, (n, t) in enumerate(zip(words, targets, strict=True))]
    shards = -(-sum(s.slots for s in sources) // 5)
    whole = list(shard_counts(sources, 5, 9, range(shards)))
    assert [w[0] for w in whole] == list(range(shards))
    taken = [Counter() for _ in words]
    for shard, counts, before in whole:
        assert counts.sum() == 5 or shard == shards - 1
        ((_, alone, base),) = shard_counts(sources, 5, 9, [shard])
        assert (alone == counts).all() and (base == before).all()
        for s, b, most in zip(*map(list, shard_slots(sources, shard, counts, before, 9)), strict=True):
            for w in range(4 * b, min(4 * b + most, words[s])):
                taken[s][w] += 1
    for n, s, t in zip(words, sources, taken, strict=True):
        assert sum(t.values()) == s.taken
        assert not n or {t[w] for w in range(n)} <= {s.taken // n, s.taken // n + 1}


def test_blocks_hold_the_words_that_are_counted(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(f"d{i}w{j}" for j in range(rng.choice([0, 1, 3, 50]))) if i % 9 else None, rng.choice(["a", "b", "é", None]), "x") for i in range(120)]
    docs += [(500, "copied words here", "a", "x")] * 9 + [(None, "no id", "b", "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, size string")
    mix = mix_sources(df, block=16, per_shard=10, cell=20)
    rows = mix.blocks().collect()
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
        assert r.text == " ".join(r.words) and 0 < len(r.words) <= 16
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and len(by_shard) > 3
    counted = Counter()
    for r in mix.taken().collect():
        counted[r.doc_id] += r.taken
    found = Counter(w for r in rows for w in r.words)
    for doc_id, text, _, _ in docs:
        if doc_id not in (None, 500) and text:
            assert sum(found[w] for w in text.split()) == counted[doc_id]
    assert found["copied"] + found["words"] + found["here"] == counted[500]
    assert sum(counted.values()) == sum(s.taken for s in mix.sources) == sum(len(r.words) for r in rows)


def test_limits(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="most_sources"):
        mix_sources(df, most_sources=1)
    assert BLOCK == mix_sources(df).block
