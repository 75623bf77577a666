"""Exact top-k by integer inner product: a KD-tree per shard, searched best box first.

A shard is one batch of bounded size. Its tree splits at medians of the widest side until leaves are
small, and keeps the tight box of each node. For a query q, sum(max(q*low, q*high)) over a box bounds
every product inside. Traversal takes the box with the highest bound next and stops when that is below
the query's k-th score so far; each query starts from the k-th score over a bounded sample, a value
that k real candidates reach, so every shard prunes by it from the outset. A task's shards go on with
the best found in the shards before and give at most k rows a query in all.

Queries go out in blocks of bounded size, one at a time; what a block finds is merged and written before
the next, so one block is held at once and every query is in one block only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import discard, materialize

#: Vectors in one tree at most; bytes of them; vectors in a leaf; sampled candidates for the first k-th scores; bytes of queries in one block.
SHARD, SHARD_BYTES, LEAF, SAMPLE, BLOCK = 32_768, 16 << 20, 128, 1024, 8 << 20
#: Sums of absolute products below this are exact in float64.
EXACT = float(1 << 53)
#: The ends of a long, at which scores beyond it are put.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


class KDTree:
    """Nodes in arrays; leaves are slices of ``rows``, which are sorted by id within a leaf."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order, self.low, self.high, self.child, self.span = np.arange(len(ids)), [], [], [], []
        todo = [(0, len(ids), -1)]
        while todo:
            a, b, parent = todo.pop()
            box = rows[order[a:b]]
            low, high = box.min(0), box.max(0)
            node = len(self.child)
            self.low.append(low), self.high.append(high), self.child.append([]), self.span.append((a, b))
            if parent >= 0:
                self.child[parent].append(node)
            side = int((high - low).argmax()) if rows.shape[1] else 0
            if b - a > leaf and rows.shape[1] and high[side] > low[side]:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(box[:, side], mid)]
                todo += [(a, a + mid, node), (a + mid, b, node)]
        for kids, (a, b) in zip(self.child, self.span, strict=True):
            if not kids:
                order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.ids, self.rows = ids[order], rows[order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest product that each node's box allows each query; not below it by rounding either."""
        top = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        if self.exact(queries):
            return top
        with np.errstate(over="ignore", invalid="ignore"):
            size = np.abs(queries) @ np.maximum(np.abs(self.low), np.abs(self.high)).T
            return np.nan_to_num(top + 1e-9 * size, nan=np.inf, posinf=np.inf)

    def exact(self, queries: np.ndarray) -> bool:
        """Whether products of these queries with any row are exact in float64, in whatever order they are added."""
        with np.errstate(over="ignore"):
            return bool((np.abs(queries) @ np.maximum(np.abs(self.low[0]), np.abs(self.high[0])) < EXACT).all()) if len(queries) else True

    def scores(self, a: int, b: int, q: np.ndarray, exact: bool) -> np.ndarray:
        """Products of a leaf's rows: float64 where exact, else whole numbers put at the ends of a long."""
        if exact:
            return self.rows[a:b] @ q
        whole = [int(x) for x in q]
        return np.array([min(max(sum(int(x) * y for x, y in zip(r, whole, strict=True)), LOWEST), HIGHEST) for r in self.rows[a:b]], object)

    def search(self, q: np.ndarray, own: int, bound: np.ndarray, k: int, kth, best: list | None = None, exact: bool = True) -> list[tuple]:
        """The (score, -id) of up to k best candidates that score ``kth`` or more, other than those of id ``own``.

        ``best``, a heap of what was found elsewhere, is gone on with. Rows of equal id all count.
        """
        best = [] if best is None else best
        if len(best) == k:
            kth = max(kth, best[0][0])
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= kth:
            node = heapq.heappop(heap)[1]
            if kids := self.child[node]:
                for c in kids:
                    if bound[c] >= kth:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            a, b = self.span[node]
            score, ids = self.scores(a, b, q, exact), self.ids[a:b]
            at = np.flatnonzero((score >= kth) & (ids != own))
            if len(at) > 4 * k:  # ids ascend, so a stable sort keeps the smaller id first among equals
                at = at[np.argsort(-score[at], kind="stable")[:k]]
            for i in at:
                item = (int(score[i]), -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                kth = max(kth, best[0][0])
        return best


def quantized(df: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """Ids and vectors of floor(256 x); those null or with a null or non-finite component take no part."""
    v = F.col(vector)
    fine = v.isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    return df.where(fine & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("v"),
    )


def top_k(
    candidates: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", vec_id: str = "vec_id",
    shard: int = SHARD, block: int = BLOCK, sample: int = SAMPLE,
) -> DataFrame:
    """Each query's k best candidates: query_id, rank (from 1), vec_id, score; ties to the smaller id.

    Candidates are all rows, also several of one id or repeated ones. "Every row but the query's own" is read by
    id: no row of the query's id is a candidate of it. Queries are the different pairs of id and vector: where an
    id has several vectors, each is answered; repeated query rows are one query. Between vectors without a
    component the score is 0.
    Scores are exact whole numbers; those beyond a long are put at its ends. Vectors that are null, hold a
    null or non-finite component, or have no id take no part; vectors of other lengths don't meet. An empty
    side gives no rows; other columns are ignored; memory is bounded by bytes, however long the vectors.
    """
    spark = candidates.sparkSession
    base = materialize(quantized(candidates, vector, vec_id), "vectors")
    asked = materialize(quantized(queries, vector, vec_id).distinct(), "queries")
    found = []
    for size, n in sorted(map(tuple, asked.groupBy(F.size("v")).agg(F.count(F.lit(1))).collect())):
        same, mine = base.where(F.size("v") == size), asked.where(F.size("v") == size)
        seed_ids, seed_rows = _arrays(same.limit(sample).toArrow(), size)
        blocks = max(1, -(-n * 8 * max(1, size) // block))
        for i in range(blocks):
            # A hash deals different queries evenly, so a block is of ``block`` bytes or so.
            part = mine if blocks == 1 else mine.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == i)
            ids, rows = _arrays(part.toArrow(), size)
            held = spark.sparkContext.broadcast((ids, rows, _first_kth(ids, rows, seed_ids, seed_rows, k)))
            got = same.mapInArrow(_searcher(held, size, k, shard), "q int, query_id long, vec_id long, score long")
            # At most k rows of a query from each task; of those each task passes k on, and they meet by query.
            place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
            best = got.withColumn("rank", place).where(F.col("rank") <= k)
            found.append(materialize(best.select("query_id", "rank", "vec_id", "score"), "found"))
            held.destroy()
    discard(base, asked)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out if not found else spark.read.schema(out.schema).parquet(*[t.millrace_path for t in found])


def _arrays(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and a matrix of vectors of one length."""
    n = table.num_rows
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, size))
    return table["vec_id"].to_numpy(), table["v"].combine_chunks().flatten().to_numpy().reshape(n, size)


def _first_kth(ids, rows, seed_ids, seed_rows, k: int) -> np.ndarray:
    """The k-th score over the sample without the query's own id; -inf if the sample is too small or large products round."""
    out = np.full(len(ids), -np.inf)
    with np.errstate(over="ignore"):
        rounds = len(ids) and len(seed_ids) and not (np.abs(rows) @ np.abs(seed_rows).max(0) < EXACT).all()
    if len(seed_ids) <= k or rounds:
        return out
    for a in range(0, len(ids), 1024):
        s = rows[a : a + 1024] @ seed_rows.T
        s[ids[a : a + 1024, None] == seed_ids[None]] = -np.inf
        out[a : a + 1024] = np.partition(s, -k, 1)[:, -k]
    return out


def _searcher(held, size: int, k: int, shard: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, kth = held.value
        best: list[list[tuple[int, int]]] = [[] for _ in ids]
        for part_ids, part in _shards(batches, size, min(shard, max(1, SHARD_BYTES // (8 * max(1, size))))):
            tree = KDTree(part_ids, part)
            for a in range(0, len(ids), 1024):
                some = rows[a : a + 1024]
                exact = tree.exact(some)
                for i, bound in enumerate(tree.bounds(some), a):
                    tree.search(rows[i], ids[i], bound, k, kth[i], best[i], exact)
        at = [i for i, found in enumerate(best) for _ in found]
        if at:
            rest = [x for found in best for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(ids[at]), pa.array([-m for _, m in rest], pa.int64()), pa.array([s for s, _ in rest], pa.int64())],
                ["q", "query_id", "vec_id", "score"],
            )

    return run


def _shards(batches: Iterable[pa.RecordBatch], size: int, shard: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for whole in batches:
        for a in range(0, whole.num_rows, shard):
            b = whole.slice(a, shard)
            held.append((b.column("vec_id").to_numpy(), b.column("v").flatten().to_numpy().reshape(b.num_rows, size)))
            n += b.num_rows
            if n >= shard:
                yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                held, n = [], 0
    if n:
        yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])


def op9_top_k(spark, sf_dir: str) -> DataFrame:
    """The 5 best of all other rows for each row whose id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.where("vec_id % 50 = 0"), 5)


OP9_SQL = """
WITH f AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT row_number() OVER () AS place, vec_id, list_transform(x, lambda c: CAST(floor(256 * c) AS BIGINT)) AS x FROM f
  WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
w AS (SELECT row_number() OVER () AS place, vec_id, x FROM (SELECT DISTINCT vec_id, x FROM v WHERE vec_id % 50 = 0) d),
c AS (SELECT place, vec_id, len(x) AS n, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM v),
q AS (SELECT place, vec_id, len(x) AS n, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM w),
s AS (SELECT q.place AS q_place, c.place AS place, any_value(q.vec_id) AS query_id, any_value(c.vec_id) AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM q JOIN c ON q.i = c.i AND q.n = c.n AND q.vec_id <> c.vec_id GROUP BY 1, 2
  UNION ALL SELECT w.place, v.place, w.vec_id, v.vec_id, 0 FROM w JOIN v ON len(w.x) = 0 AND len(v.x) = 0 AND w.vec_id <> v.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_place ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
