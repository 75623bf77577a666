import random
import zlib
from collections import defaultdict

from millrace.llm import sharding
from millrace.llm.sharding import BinTree, best_fit_decreasing, op1_shard_by_bytes, pack_into, shard_documents


def plain_best_fit(items, capacity):
    room, at = [], []
    for s in sorted(items, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        i = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(max(capacity, s))
        room[i] -= s
        at.append((s, i))
    return sorted(at)


def test_tree_against_a_list():
    rng, tree, held = random.Random(1), BinTree(), []
    for step in range(2000):
        if held and rng.random() < 0.4:
            key = held.pop(rng.randrange(len(held)))
            tree.remove(key)
        else:
            key = (rng.randrange(200), step)
            held.append(key)
            tree.add(key)
        size = rng.randrange(220)
        assert tree.tightest(size) == min((k for k in held if k[0] >= size), default=None)
    assert tree.root.height <= 1.45 * len(held).bit_length() + 2


def test_runs_equal_single_items():
    rng = random.Random(2)
    for _ in range(30):
        items = [rng.choice([1, 2, 3, 5, 8, 13, 40, 120]) for _ in range(rng.randrange(1, 60))]
        sizes = [(s, items.count(s)) for s in set(items)]
        runs, bins = best_fit_decreasing(sizes, 60)
        got = sorted((r.size, r.shard) for r in runs for _ in range(r.low, r.high))
        want = plain_best_fit(items, 60)
        load = lambda x: sorted(defaultdict(int, {}).items()) or [sum(s for s, b in x if b == i) for i in range(bins)]
        assert load(got) == load(want)
        assert bins == max(b for _, b in want) + 1


def test_bins_are_nearly_equal_and_large_groups_stand_alone():
    rng = random.Random(3)
    sizes = [(s, rng.randrange(1, 20)) for s in range(1, 400)] + [(10_000_000, 1)]
    runs = pack_into(sizes, 16)
    load = defaultdict(int)
    for r in runs:
        load[r.shard] += r.size * (r.high - r.low)
    assert sorted(load) == list(range(16))
    small = sorted(load.values())[:-1]
    assert max(small) - min(small) < 0.01 * max(small)
    for size, count in sizes:
        assert sorted(x for r in runs if r.size == size for x in range(r.low, r.high)) == list(range(count))


def check(docs, rows, shards):
    want = [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.size, r.text_crc32)) for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = defaultdict(set)
    for r in rows:
        where[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, shard_documents(odd_docs, 4).collect(), 4)
    assert shard_documents(no_docs, 4).collect() == []
    one = odd_docs.where("doc_id = 3")
    check(one, shard_documents(one, 16).collect(), 16)


def test_small_cells_and_fixed_capacity(odd_docs, monkeypatch):
    monkeypatch.setattr(sharding, "CELL", 2)
    check(odd_docs, shard_documents(odd_docs, 4).collect(), 4)
    rows = shard_documents(odd_docs, None, capacity=6000).collect()
    check(odd_docs, rows, 99)
    assert max(r.shard for r in rows) == 1


def test_query(spark, sf):
    rows = op1_shard_by_bytes(spark, sf).collect()
    check(spark.read.parquet(f"{sf}/documents.parquet"), rows, 16)
    load = defaultdict(int)
    for r in rows:
        load[r.shard] += r.size
        assert (r.law, r.grown_shard) == ("bytes", None)
    assert len(load) == 16
