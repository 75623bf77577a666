import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import near_duplicates as N
from millrace.llm.components import connected_components, merged_components


def shingles(text, idf_of):
    w = [x.decode() for x in N.words(text)]
    if not w:
        return {}
    pad = w + [None] * (5 - len(w))
    count = Counter(tuple(pad[i : i + 5]) for i in range(len(pad) - 4))
    return {s: n * sum(idf_of(x) for x in s if x is not None) / 5 for s, n in count.items()}


def similarity(a, b):
    keys = a.keys() | b.keys()
    low = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys)
    high = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    return low / high if high else 0


def brute(rows, least=0.8):
    """doc_id -> class id by all pairs; frequencies are those of the operator's cells."""
    import xxhash

    cell = lambda w: xxhash.xxh3_64_intdigest(w) & (N.CELLS - 1)
    df, n = Counter(), 0
    for _, t in rows:
        cells = {cell(w) for w in N.words(t)}
        df.update(cells)
        n += bool(cells)
    idf_of = lambda w: 1 + np.log((1 + n) / (1 + df[cell(w.encode())]))
    texts = sorted({t for _, t in rows if N.words(t)})
    sets = [shingles(t, idf_of) for t in texts]
    head = list(range(len(texts)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= least - 1e-6:
                head[find(i)] = find(j)
    comp = {t: find(i) for i, t in enumerate(texts)}
    low = {}
    for d, t in rows:
        if t in comp:
            low[comp[t]] = min(low.get(comp[t], 1 << 60), d)
    return {d: low[comp[t]] if t in comp else d for d, t in rows}


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: rng.choices(vocabulary, k=n)
    passage = text(60)
    rows, i = [], 0
    for g in range(12):
        base = text(rng.choice([40, 120, 300]))
        for _ in range(rng.choice([1, 2, 6, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, len(w) // 40, len(w) // 12])):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((i, " ".join(w)))
            i += 7
        rows.append((i, rng.choice(rows)[1]))
        i += 1
        rows.append((i, " ".join(text(100) + passage + text(50))))
        i += 1
    for t in ("Short one", "short ONE!", "other", None, "", "...", "...", "b " * 30_000, "b " * 30_000 + "c"):
        rows.append((i, t))
        i += 1
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, total int")


@pytest.mark.parametrize("leaders", [N.LEADERS, 1])
def test_classes_against_all_pairs(spark, planted, leaders, monkeypatch):
    monkeypatch.setattr(N, "LEADERS", leaders)
    got = N.near_duplicates(frame(spark, planted)).collect()
    want = brute(planted)
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.first == (r.class_id == r.doc_id) for r in got)


def test_one_of_each_class_stays(spark, planted):
    docs = frame(spark, planted)
    kept = N.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = brute(planted)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, c in want.items() if d == c)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = N.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[9].class_id == 3 and by[10].class_id == 4 and by[4].class_size == 3 and by[0].class_size == 1
    kept = N.drop_near_duplicates(odd_docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["None", "None", *map(str, [0, 1, 2, 3, 4, 5, 6, 7, 8, 11, 12])])
    assert N.near_duplicates(no_docs).collect() == [] and N.drop_near_duplicates(no_docs).collect() == []


def test_vectors_equal_plain_similarity():
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randrange(0, 40))) for _ in range(60)]
    idf = np.full(N.CELLS, 1.0, np.float32)
    got = N.similarities(texts, texts[::-1], idf)
    want = [similarity(shingles(a, lambda w: 1.0), shingles(b, lambda w: 1.0)) for a, b in zip(texts, texts[::-1], strict=True)]
    assert np.allclose(got, want, atol=1e-5)


def all_pairs(texts, least, idf_of):
    """Every pair of texts of that similarity, by shared shingles: those without any have none."""
    sets = [shingles(x, idf_of) for x in texts]
    sums = [sum(s.values()) for s in sets]
    at = {}
    for i, s in enumerate(sets):
        for g in s:
            at.setdefault(g, []).append(i)
    found = {}
    for i, s in enumerate(sets):
        low = Counter()
        for g, w in s.items():
            for j in at[g]:
                if j < i:
                    low[j] += min(w, sets[j][g])
        for j, both in low.items():
            if both >= (least - 1e-6) * (sums[i] + sums[j] - both):
                found[j, i] = both / (sums[i] + sums[j] - both)
    return found


@pytest.mark.parametrize("least", [0.8, 0.5])
def test_recall_against_all_pairs_of_real_documents(spark, least):
    """No class of the whole table is torn or joined wrongly, at the usual similarity and at a lower one."""
    import xxhash

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    count, n = N.word_frequencies(docs)
    idf = N.inverse_frequencies(count, n)
    cell = lambda w: idf[xxhash.xxh3_64_intdigest(w.encode()) & (N.CELLS - 1)]
    texts = sorted({t for _, t in rows if N.words(t)})
    links = all_pairs(texts, least, lru_cache(None)(cell))
    head = list(range(len(texts)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, j in links:
        head[find(i)] = find(j)
    place = {t: i for i, t in enumerate(texts)}
    low = {}
    for d, t in rows:
        if t in place:
            c = find(place[t])
            low[c] = min(low.get(c, d), d)
    want = {d: low[find(place[t])] if t in place else d for d, t in rows}
    got = {r.doc_id: r.class_id for r in N.near_duplicates(docs, least=least).collect()}
    together = [got[a] == got[b] for (i, j) in links for a, b in [(low_id(rows, texts[i]), low_id(rows, texts[j]))]]
    assert len(links) >= (60 if least < 0.8 else 5) and sum(together) >= 0.999 * len(together)
    assert got == want


def low_id(rows, text):
    return min(d for d, t in rows if t == text)


def test_bands_and_agreement():
    assert N.banding(0.8) == (16, 4) and N.banding(0.5)[0] * N.banding(0.5)[1] <= 200
    for least in (0.5, 0.8, 0.95):
        bands, rows = N.banding(least)
        assert (1 - least**rows) ** bands <= N.LOST
        from math import comb

        n, k = bands * rows, N.least_agreement(least, bands * rows)
        assert sum(comb(n, i) * least**i * (1 - least) ** (n - i) for i in range(k)) < 1e-4


def test_bins_bound_the_difference():
    rng = random.Random(4)
    idf = np.random.default_rng(4).uniform(1, 9, N.CELLS).astype(np.float32)
    texts = [" ".join(rng.choices("abcdefghijkl", k=rng.randrange(1, 300))) for _ in range(40)]
    doc, ids, weight, _ = N.weighted_shingles(texts, idf)
    mass, total = N.weight_bins(doc, ids, weight, len(texts)), np.bincount(doc, weight, len(texts))
    s = N.similarities(texts[:-1], texts[1:], idf)
    sums = mass * total[:, None] / N.STEPS
    apart = np.abs(sums[1:] - sums[:-1]).sum(1)
    assert (apart <= ((1 - s) / (1 + s) + 1e-4 + N.BINS / (2 * N.STEPS)) * (total[1:] + total[:-1])).all()
    assert N.weight_bins(*N.weighted_shingles([None], idf)[:3], 1).tolist() == [[0] * N.BINS]


def test_samples_agree_as_often_as_weights():
    rng = np.random.default_rng(3)
    n = 4000
    both = rng.integers(0, 1 << 44, 300).astype(np.uint64)
    a_ids = np.sort(np.concatenate([both, rng.integers(0, 1 << 44, 60).astype(np.uint64)]))
    w = rng.uniform(0.5, 9, len(a_ids)).astype(np.float32)
    keep = np.isin(a_ids, both)
    b_ids, b_w = a_ids[keep], w[keep] * np.float32(0.9)
    doc = np.repeat([0, 1], [len(a_ids), len(b_ids)])
    h, short = N.band_hashes(doc, np.concatenate([a_ids, b_ids]), np.concatenate([w, b_w]), 2, 400, 1)
    assert ((h[0] == h[1]) == (short[0] == short[1])).mean() > 0.99
    want = b_w.sum() / w.sum()
    assert abs((h[0] == h[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 400) and n


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 90)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(7, 7)]
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    parts = merged_components(connected_components(frame(edges[::2])), frame(edges[1::2]))
    assert {r.node: r.comp for r in parts.collect() if r.node in got} == got
    head = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            head[a] = head[b] = min(head[a], head[b])
    assert got == {x: c for x, c in head.items()}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def _plain_block_pairs(rows, least, samples):
    found = set()
    for x in rows:
        for y in rows:
            if not x["leads"] or y["leads"] or any(x[k] != y[k] for k in ("bucket", "part", "slice")) or x["comp"] == y["comp"]:
                continue
            if y["comp"] != x["top"] and y["u"] <= x["u"]:
                continue
            if min(x["total"], y["total"]) < (least - 1e-5) * max(x["total"], y["total"]):
                continue
            if next(i for i, (p, q) in enumerate(zip(x["bands"], y["bands"], strict=True)) if p == q) != x["band"]:
                continue
            if sum(p == q for p, q in zip(x["sketch"], y["sketch"], strict=True)) < N.least_agreement(least, samples):
                continue
            apart = sum(abs(p * x["total"] - q * y["total"]) for p, q in zip(x["mass"], y["mass"], strict=True)) / N.STEPS
            if apart <= N._most_apart(least) * (x["total"] + y["total"]):
                found.add((min(x["node"], y["node"]), max(x["node"], y["node"])))
    return found


def test_block_pairs_equal_a_plain_loop(monkeypatch):
    """Blocks of leaders and members, as the operator deals them, at any number of pairs at once."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 400, N.BINS)
    rows, node = [], 0
    for bucket in range(6):
        band = bucket % 3
        kind = []
        for _ in range(int(rng.integers(1, 25))):
            node += 1
            mass = base + rng.integers(0, int(rng.choice([30, 200, 900])), N.BINS)
            bands = rng.integers(0, 2, 4)
            bands[band] = 7
            kind.append({
                "bucket": bucket, "part": 0, "slice": 0, "band": band, "node": node, "comp": int(rng.integers(0, 4)), "top": 0, "u": float(rng.random()),
                "total": float(rng.choice([100, 110, 180])), "mass": (mass * N.STEPS // mass.sum()).tolist(),
                "sketch": rng.integers(0, int(rng.choice([1, 2])) + 1, 16).tolist(), "bands": bands.tolist(),
            })
        rows += [{**k, "leads": True} for k in kind if k["comp"] != 0] + [{**k, "leads": False} for k in kind]
    types = {"part": pa.int32(), "slice": pa.int32(), "band": pa.int32(), "total": pa.float32(), "mass": pa.list_(pa.int16()), "sketch": pa.list_(pa.int16())}
    batch = pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n)) for n in N._BLOCK], list(N._BLOCK))
    expected = _plain_block_pairs(rows, 0.6, 16)
    assert expected
    for at_once in (1, 7, 1 << 13):
        monkeypatch.setattr(N, "PAIRS_AT_ONCE", at_once)
        a, b = N.block_pairs(batch, 0.6, 16)
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == expected
    assert N.block_pairs(batch.slice(0, 0), 0.6, 16)[0].size == 0
