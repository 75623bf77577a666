"""Sharding by best-fit-decreasing bin packing of indivisible groups of equal texts.

Only the histogram of group sizes reaches the driver. With T bytes in all there are fewer than
sqrt(2 T) different sizes, so it stays far below the number of groups; everything about single groups
and rows is a distributed join, window or aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import small_join
from millrace.session import materialize

#: Groups of one size are ranked in cells of about this many.
CELL = 10_000


class _Node:
    __slots__ = ("height", "key", "left", "right")

    def __init__(self, key):
        self.key, self.left, self.right, self.height = key, None, None, 1


class BinTree:
    """A height-balanced search tree of (remaining capacity, bin)."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _height(n) -> int:
        return n.height if n else 0

    def _lift(self, n):
        n.height = 1 + max(self._height(n.left), self._height(n.right))
        return n

    def _turn(self, n, up: str, other: str):
        top = getattr(n, up)
        setattr(n, up, getattr(top, other))
        setattr(top, other, self._lift(n))
        return self._lift(top)

    def _balance(self, n):
        self._lift(n)
        lean = self._height(n.left) - self._height(n.right)
        if abs(lean) < 2:
            return n
        up, other = ("left", "right") if lean > 0 else ("right", "left")
        child = getattr(n, up)
        if self._height(getattr(child, other)) > self._height(getattr(child, up)):
            setattr(n, up, self._turn(child, other, up))
        return self._turn(n, up, other)

    def add(self, key) -> None:
        def down(n):
            if n is None:
                return _Node(key)
            side = "left" if key < n.key else "right"
            setattr(n, side, down(getattr(n, side)))
            return self._balance(n)

        self.root = down(self.root)

    def remove(self, key) -> None:
        def down(n, key):
            if key == n.key:
                if not (n.left and n.right):
                    return n.left or n.right
                least = n.right
                while least.left:
                    least = least.left
                n.key = least.key
                n.right = down(n.right, least.key)
            else:
                side = "left" if key < n.key else "right"
                setattr(n, side, down(getattr(n, side), key))
            return self._balance(n)

        self.root = down(self.root, key)

    def tightest(self, size: int):
        """The least key with at least ``size`` remaining, or None."""
        n, found = self.root, None
        while n:
            if n.key[0] >= size:
                n, found = n.left, n.key
            else:
                n = n.right
        return found


@dataclass(frozen=True)
class Run:
    """Groups ``low`` to ``high`` - 1 (by rank) of one size go to ``shard``."""

    size: int
    low: int
    high: int
    shard: int


def best_fit_decreasing(
    sizes: list[tuple[int, int]], capacity: int, most_bins: int | None = None
) -> tuple[list[Run], int] | None:
    """Pack (size, count) pairs, largest first, each into the tightest bin that holds it.

    Equal sizes are placed a run at a time: the tightest bin stays the tightest until it is full. A group
    above ``capacity`` gets a bin of its own. Gives the runs and the number of bins, or None if more than
    ``most_bins`` would be needed.
    """
    tree, runs, bins = BinTree(), [], 0
    for size, count in sorted(sizes, reverse=True):
        low = 0
        while low < count:
            if (key := tree.tightest(size)) is None:
                if bins == most_bins:
                    return None
                key, bins = (max(capacity, size), bins), bins + 1
            else:
                tree.remove(key)
            room, shard = key
            n = min(count - low, room // size)
            runs.append(Run(size, low, low + n, shard))
            low += n
            if room > n * size:
                tree.add((room - n * size, shard))
    return runs, bins


def pack_into(sizes: list[tuple[int, int]], bins: int) -> list[Run]:
    """Best-fit-decreasing into exactly ``bins`` bins of the least capacity found.

    A group larger than an even share of what is left gets a bin of its own, so that it doesn't raise the
    capacity of the others. The slack over an even share is then doubled from one byte until all fits.
    """
    left = {s: c for s, c in sizes}
    alone: list[Run] = []
    total = sum(s * c for s, c in sizes)
    ranks: dict[int, int] = {}
    for size in sorted(left, reverse=True):
        while left[size] and bins - len(alone) > 1 and size * (bins - len(alone)) > total:
            at = ranks.get(size, 0)
            alone.append(Run(size, at, at + 1, len(alone)))
            ranks[size], total = at + 1, total - size
            left[size] -= 1
        if left[size]:
            break
    rest = [(s, c) for s, c in left.items() if c]
    if not rest:
        return alone
    free, slack = bins - len(alone), 0
    while (made := best_fit_decreasing(rest, -(-total // free) + slack, free)) is None:
        slack = max(1, 2 * slack)
    return alone + [
        Run(r.size, r.low + ranks.get(r.size, 0), r.high + ranks.get(r.size, 0), r.shard + len(alone)) for r in made[0]
    ]


def shard_documents(
    docs: DataFrame, shards: int | None = 16, capacity: int | None = None, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Every row's shard and slot: doc_id, size, text_crc32, shard, slot.

    Give ``shards`` (that many shards of nearly equal bytes) or ``capacity`` (as few shards of that many
    bytes as best-fit-decreasing needs). Size: UTF-8 bytes plus 1. Rows of equal text form a group and
    share a shard; null counts as empty (size 1, checksum 0). Repeated rows and ids get slots of their
    own; null ids stay. Slots run from 0 without gaps in each shard, in order of doc_id within hashed cells.
    Groups of equal size are taken in order of a hash of their text. A text, however long, is one row; a group
    above ``capacity`` has a shard of its own. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    base = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(body.cast("binary"))).alias("key"),
        ),
        "shard-rows",
    )
    groups = base.groupBy("key").agg(F.sum("size").alias("group_size"))
    hist = [(r[0], r[1]) for r in groups.groupBy("group_size").agg(F.count(F.lit(1))).collect()]
    n_groups = sum(c for _, c in hist)
    if shards is not None:
        runs = pack_into(hist, shards)
    else:
        runs = best_fit_decreasing(hist, capacity)[0]
    plan = spark.createDataFrame(
        [(r.size, r.low, r.high, r.shard) for r in runs] or [], "group_size long, low long, high long, shard int"
    )
    cells = max(1, -(-n_groups // CELL))
    groups = groups.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)).cast("int"))
    starts = (
        groups.groupBy("group_size", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("start", F.sum("n").over(W.partitionBy("group_size").orderBy("cell")) - F.col("n"))
        .drop("n")
    )
    ranked = (
        groups.withColumn("at", F.row_number().over(W.partitionBy("group_size", "cell").orderBy("key")) - 1)
        .join(starts, ["group_size", "cell"])
        .withColumn("rank", F.col("start") + F.col("at"))
    )
    placed = small_join(ranked, plan, len(runs), "group_size").where("rank >= low and rank < high")
    rows = materialize(
        base.join(placed.select("key", "shard"), "key")
        .select("doc_id", "size", "text_crc32", "shard")
        .withColumn("row", F.monotonically_increasing_id()),
        "shard-placed",
    )
    parts = max(64, -(-rows.count() // CELL))  # numbers go by cells of a shard's rows, however many it has
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    firsts = counts.withColumn(
        "first", F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")
    ).drop("n")
    numbered = rows.withColumn("at", F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "row")) - 1)
    return numbered.join(firsts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).alias("slot")
    )


def op1_shard_by_bytes(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 of nearly equal bytes."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
