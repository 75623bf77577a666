"""Mixing sources to target weights in blocks of a fixed number of words.

Each source is one stream of words, in an order that its rows' hashes deal, cut into blocks of fixed length;
only a source's last block may be short. Targets are shared out by weight, none above ``most_passes`` times its
source. A target is whole passes over the source's blocks, and a part of one more whose last block is cut, so
it is met to the word. How many blocks of each source an output shard takes is drawn from a multinomial
distribution over what the sources still owe: a range of shards is halved again and again, each half
drawing from its parent's share, so any task finds the counts of its own shards from the seed alone. A
shard's n-th block of a source goes through a keyed permutation of that source's blocks, another for each
pass, and blocks are joined by their index. Only the sources' sizes reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import small_join
from millrace.session import materialize

#: A word: no space, tab, line or page end.
WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block; blocks in an output shard; rows in a cell of a source's stream; passes over a source at most; sources at most.
BLOCK, SHARD, CELL, PASSES, SOURCES = 1024, 4096, 10_000, 3, 100_000
#: Pieces of one document that are listed at once.
LISTED = 10_000


def share_out(sizes: list[int], weights: list[int], most: int = PASSES) -> list[Fraction]:
    """The total of ``sizes`` shared by weight, no share above ``most`` times its size; the excess goes to the others."""
    left, open_, out = Fraction(sum(sizes)), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        whole = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] > most * sizes[i] * whole}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = Fraction(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def permuted(at: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of range(n) at the given places: four Feistel rounds, walked until below ``n``."""
    half = np.uint64(max(1, -(-max(1, int(n - 1).bit_length()) // 2)))
    low = (np.uint64(1) << half) - np.uint64(1)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> half, x & low
        for r in range(4):
            a, b = b, a ^ (_mixed(b ^ _mixed(np.uint64((key + r * 0x9E3779B97F4A7C15) % (1 << 64)))) & low)
        return (a << half) | b

    out = once(at.astype(np.uint64))
    while len(over := np.flatnonzero(out >= np.uint64(n))):
        out[over] = once(out[over])
    return out.astype(np.int64)


def _mixed(x):
    """Bits of 64-bit numbers mixed by multiplication and shifts."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(rng: np.random.Generator, n: int, owed: np.ndarray) -> np.ndarray:
    """``n`` draws from sources in proportion to what they owe; what a source can't give is drawn again from the rest."""
    got = np.zeros_like(owed)
    while n:
        room = owed - got
        if room.sum() == n:
            return owed.copy()
        part = np.minimum(rng.multinomial(n, room / room.sum()), room)
        got += part
        n -= int(part.sum())
    return got


@dataclass(frozen=True)
class Source:
    """A source's stream: words, the words that the mix takes, in blocks of ``block`` words."""

    name: str | None
    size: int
    target: float
    taken: int
    block: int

    @property
    def full(self) -> int:
        """Blocks of full length."""
        return self.size // self.block

    @property
    def blocks(self) -> int:
        return -(-self.size // self.block)

    @property
    def cut(self) -> int:
        """Words that the last slot takes of its block; 0: all of them."""
        return self.taken % self.size % self.block if self.size else 0

    @property
    def slots(self) -> int:
        passes, rest = divmod(self.taken, self.size) if self.size else (0, 0)
        return passes * self.blocks + -(-rest // self.block)


def shard_counts(sources: list[Source], per_shard: int, seed: int, wanted: Iterable[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, blocks that it takes of each source, those that earlier shards took) of the wanted shards."""
    owed = np.array([s.slots for s in sources], np.int64)
    total = int(owed.sum())
    todo = [(0, -(-total // per_shard), owed, np.zeros_like(owed), sorted(wanted))]
    while todo:
        low, high, counts, before, mine = todo.pop()
        if not mine:
            continue
        if high - low == 1:
            yield low, counts, before
            continue
        mid = (low + high) // 2
        left = drawn(np.random.default_rng([seed, low, high]), (mid - low) * per_shard, counts)
        todo.append((mid, high, counts - left, before + left, [x for x in mine if x >= mid]))
        todo.append((low, mid, left, before, [x for x in mine if x < mid]))


def shard_slots(sources: list[Source], shard: int, counts: np.ndarray, before: np.ndarray, seed: int) -> list[np.ndarray]:
    """Of one shard's slots in turn: source, block, words taken of it at most."""
    source = np.repeat(np.arange(len(sources)), counts)
    block, limit = np.zeros(len(source), np.int64), np.zeros(len(source), np.int64)
    at = 0
    for i in np.flatnonzero(counts):
        s, n = sources[i], int(counts[i])
        draw = np.arange(before[i], before[i] + n)
        turn, place = draw // s.blocks, draw % s.blocks
        mine = place.copy()  # the short block is a pass's last
        for p in np.unique(turn) if s.full else ():
            some = (turn == p) & (place < s.full)
            key = np.random.default_rng([seed, int(i), int(p)]).integers(1 << 63)
            mine[some] = permuted(place[some], s.full, int(key))
        block[at : at + n] = mine
        limit[at : at + n] = np.where((draw == s.slots - 1) & (s.cut > 0), s.cut, s.block)
        at += n
    order = np.random.default_rng([seed, shard]).permutation(len(source))
    return [source[order], block[order], limit[order]]


@dataclass
class Mix:
    """A mix: its sources by code point, its documents with their places in their source's stream, its seed."""

    sources: list[Source]
    documents: DataFrame
    texts: DataFrame
    block: int
    per_shard: int
    seed: int

    def slots(self) -> DataFrame:
        """shard, slot, source_at (index in ``sources``), block, words taken of it at most."""
        spark, sources, per_shard, seed = self.documents.sparkSession, self.sources, self.per_shard, self.seed

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, counts, before in shard_counts(sources, per_shard, seed, batch.column(0).to_pylist()):
                    made = shard_slots(sources, shard, counts, before, seed)
                    n = len(made[0])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, shard)), pa.array(np.arange(n)), *map(pa.array, made)],
                        ["shard", "slot", "source_at", "block", "most"],
                    )

        shards = -(-sum(s.slots for s in sources) // per_shard)
        return spark.range(shards).mapInArrow(run, "shard long, slot long, source_at long, block long, most long")

    def _cut(self, rows: DataFrame, carried: list[str], words: Column | None = None) -> DataFrame:
        """Rows of the stream (source_at, start, length) in pieces by block: at (place in the block), n words."""
        b = F.lit(self.block)
        rows = rows.where("length > 0").withColumns({
            "first": F.expr(f"start div {self.block}"), "last": F.expr(f"(start + length - 1) div {self.block}")
        })
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(last - first) div {LISTED}")))
        rows = rows.withColumn("part", part)
        low = F.col("first") + F.col("part") * LISTED
        places = F.sequence(low, F.least(F.col("last"), low + LISTED - 1))

        def piece(block: Column) -> Column:
            a, z = F.greatest("start", block * b), F.least(F.col("start") + F.col("length"), (block + 1) * b)
            fields = [block.alias("block"), (a - block * b).alias("at"), (z - a).alias("n")]
            if words is not None:
                # A repeated row's copies follow each other: each piece takes its words copy by copy.
                skip = F.pmod(a - F.col("start"), F.col("size"))
                again = F.array_repeat(words, F.ceil((skip + z - a) / F.col("size")).cast("int"))
                fields.append(F.slice(F.flatten(again), (skip + 1).cast("int"), (z - a).cast("int")).alias("words"))
            return F.struct(*fields)

        return rows.select("source_at", "start", *carried, F.inline(F.transform(places, piece)))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: of every row the words that the mix takes, repeats counted.

        What repeated rows give together is split evenly among them.
        """
        own = ["doc_id", "size", "copies"]
        pieces = self._cut(self.documents, own)
        most = F.coalesce("most", F.lit(0).cast("long"))  # of a block that isn't drawn nothing
        gone = F.greatest(F.least(F.col("at") + F.col("n"), most) - F.col("at"), F.lit(0).cast("long"))
        some = (
            pieces.join(self.slots().select("source_at", "block", "most"), ["source_at", "block"], "left")
            .groupBy("source_at", "start")
            .agg(*[F.first(c).alias(c) for c in own], F.sum(gone).alias("all"))
        )
        none = self.documents.where("length = 0").select(
            "source_at", "start", *own, F.lit(0).cast("long").alias("all")
        )
        copies = some.unionByName(none).withColumn("tens", F.explode(F.expr(f"sequence(0L, (copies - 1) div {LISTED})")))
        copies = copies.withColumn("copy", F.explode(F.expr(f"sequence(tens * {LISTED}, least(copies - 1, tens * {LISTED} + {LISTED - 1}))")))
        return small_join(copies, self.plan(), len(self.sources), "source_at").select(
            "doc_id", "size", F.col("source_size"), "target", F.expr("(all + copy) div copies").alias("taken")
        )

    def plan(self) -> DataFrame:
        """The sources: source_at, source, source_size, target (words), planned (the whole words that the mix takes)."""
        return self.documents.sparkSession.createDataFrame(
            [(i, s.name, s.size, s.target, s.taken) for i, s in enumerate(self.sources)],
            "source_at long, source string, source_size long, target double, planned long",
        )

    def blocks(self) -> DataFrame:
        """The mix itself: shard, slot, source, words; one row for each slot, words joined by spaces as ``text`` besides."""
        key = ["source_at", "doc_id", "key"]
        same = [F.col(f"t.{c}").eqNullSafe(F.col(f"d.{c}")) for c in key]
        rows = self.documents.alias("d").join(self.texts.dropDuplicates(key).alias("t"), same).select("d.*", "t.text")
        rows = rows.withColumn("all", F.regexp_extract_all("text", F.lit(WORD), 0))
        cut = self._cut(rows, [], F.col("all")).groupBy("source_at", "block")
        whole = cut.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda p: p["words"])).alias("words"))
        out = self.slots().join(whole, ["source_at", "block"])
        out = small_join(out, self.plan().select("source_at", "source"), len(self.sources), "source_at")
        words = F.slice("words", F.lit(1), F.col("most").cast("int"))
        return out.select("shard", "slot", "source", words.alias("words"), F.array_join(words, " ").alias("text"))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK, per_shard: int = SHARD, passes: int = PASSES, seed: int = 1,
    text: str = "text", doc_id: str = "doc_id", source: str = "source", cell: int = CELL, most_sources: int = SOURCES,
) -> Mix:
    """Plan a mix of all documents: sources by code point, null last, weigh ``weights``, repeated in turn.

    A document's size is its number of words; null and empty texts have none, and give none. Null ids stay.
    Rows repeated in full are laid out behind each other, so each may be taken. An empty table gives a mix
    without sources. Other columns are ignored, whatever their names. Where all sources are at ``passes``
    times their size (only for fewer than that many passes) targets are what they can give. The plan
    depends on the rows and the seed alone, not on how the table is partitioned.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = docs.select(
        F.col(f"`{source}`").alias("source"), F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"),
        F.unhex(F.md5(body.cast("binary"))).alias("key"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
    )
    rows = materialize(
        texts.groupBy("source", "doc_id", "key").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("copies")), "mix-rows"
    ).withColumn("length", F.col("size") * F.col("copies"))
    found = rows.groupBy("source").agg(F.sum("length").alias("words"), F.count(F.lit(1)).alias("rows")).limit(most_sources + 1).collect()
    if len(found) > most_sources:
        raise ValueError(f"there are more than {most_sources} sources (parameter most_sources)")
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r.words for r in found]
    targets = share_out(sizes, [weights[i % len(weights)] for i in range(len(sizes))], passes)
    sources = [Source(r.source, r.words, float(t), round(t), block) for r, t in zip(found, targets, strict=True)]

    def indexed(df: DataFrame) -> DataFrame:
        names = df.sparkSession.createDataFrame([(i, s.name) for i, s in enumerate(sources)], "source_at long, name string")
        return small_join(df, names, len(sources), F.col("source").eqNullSafe(F.col("name"))).drop("source", "name")

    cells = max(1, -(-sum(r.rows for r in found) // cell))
    rows = indexed(rows).withColumn("cell", F.pmod(F.xxhash64("doc_id", "key"), F.lit(cells)).cast("int"))
    starts = rows.groupBy("source_at", "cell").agg(F.sum("length").alias("words"))
    starts = starts.withColumn("base", F.sum("words").over(W.partitionBy("source_at").orderBy("cell")) - F.col("words")).drop("words")
    within = W.partitionBy("source_at", "cell").orderBy("doc_id", "key").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("length").over(within)).join(starts, ["source_at", "cell"])
    placed = placed.withColumn("start", F.col("base") + F.col("upto") - F.col("length"))
    documents = materialize(placed.select("source_at", "doc_id", "key", "size", "copies", "length", "start"), "mix-documents")
    return Mix(sources, documents, indexed(texts), block, per_shard, seed)


def op12_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All documents: of each the words that a mix of weights 1, 2 and 3 takes."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).taken()
