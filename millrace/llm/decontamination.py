"""Benchmark decontamination by an FM-index per training shard.

A shard is a batch of whole documents. Its words become numbers over the alphabet of the test phrases;
stretches without a word of it, or too short for the shortest phrase, can't hold an occurrence and aren't
indexed. The rest gets a suffix array (prefix doubling), its Burrows-Wheeler transform in a wavelet
matrix, and the suffix positions at every STEP-th place. All phrases are searched backwards at once by
rank queries; occurrences are located by walking to a sampled position, and their word spans are merged.

Documents don't move: only the phrases go to the tasks, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import per_text, slices, with_outputs, words

#: Words in a window; distance of sampled suffix positions; text bytes in a shard; phrase bytes in a block.
WINDOW, STEP, SHARD, BLOCK = 13, 8, 4 << 20, 4 << 20
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class WaveletMatrix:
    """Rank of any symbol before any place, by one bit vector with running counts a level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.levels = len(symbols), []
        s = symbols.astype(np.uint32)
        for level in range(bits - 1, -1, -1):
            bit = ((s >> np.uint32(level)) & 1).astype(bool)
            packed = np.zeros(self.n // 64 * 8 + 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            block = packed.view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(block), dtype=np.int64)])[:-1].astype(np.int32)
            zeros = self.n - int(bit.sum())
            self.levels.append((level, block, before, zeros))
            s = np.concatenate([s[~bit], s[bit]])
        self.start: dict[int, int] = {}

    @staticmethod
    def _ones(block, before, at):
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(block[word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` occurs before each place ``at``."""
        first = np.zeros_like(at)
        for level, block, before, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            a, f = self._ones(block, before, at), self._ones(block, before, first)
            at, first = np.where(one, zeros + a, at - a), np.where(one, zeros + f, first - f)
        return at - first

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank before it."""
        symbol = np.zeros_like(place)
        first = np.zeros_like(place)
        for level, block, before, zeros in self.levels:
            one = ((block[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            symbol |= one.astype(symbol.dtype) << level
            a, f = self._ones(block, before, place), self._ones(block, before, first)
            place, first = np.where(one, zeros + a, place - a), np.where(one, zeros + f, first - f)
        return symbol, place - first


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """All suffixes in order; only those still tied are sorted again as the compared length doubles."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    key = symbols[order].astype(np.int64)
    step = 1
    new = np.concatenate([[True], key[1:] != key[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a suffix's rank is its group's first place
    rank[order] = head
    while True:
        alone = new & np.concatenate([new[1:], [True]])
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return order
        at = order[tied] + step
        after = np.where(at < n, rank[np.minimum(at, n - 1)] + 1, 0)
        by = np.lexsort((after, head[tied]))
        order[tied] = order[tied][by]
        group, after = head[tied], after[by]  # groups keep their places, so ``group`` is sorted already
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        new[tied] = fresh
        head[tied] = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[order[tied]] = head[tied]
        step *= 2


class FMIndex:
    """Backward search and location over ``symbols`` (1 and up; the end is 0)."""

    def __init__(self, symbols: np.ndarray, alphabet: int, step: int = STEP):
        text = np.append(symbols, 0)
        order = suffix_array(text)
        self.bwt = WaveletMatrix(text[order - 1], max(1, int(alphabet).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 1))])
        self.sampled = order % step == 0
        self.position = order[self.sampled]
        self.index = np.cumsum(self.sampled) - 1

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that start with each phrase; rows of ``phrases`` are padded behind."""
        phrases, length = phrases.astype(np.int64), length.astype(np.int64)
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.bwt.n, np.int64)
        live = np.arange(len(phrases))
        for back in range(1, int(length.max(initial=0)) + 1):
            live = live[(length[live] >= back) & (low[live] < high[live])]
            if not len(live):
                break
            c = phrases[live, length[live] - back]
            base = self.first[c]
            low[live] = base + self.bwt.rank(c, low[live])
            high[live] = base + self.bwt.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one."""
        rows, walked = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.sampled[rows])
        while len(todo):
            c, k = self.bwt.at(rows[todo])
            rows[todo] = self.first[c] + k
            walked[todo] += 1
            todo = todo[~self.sampled[rows[todo]]]
        return self.position[self.index[rows]] + walked


@dataclass
class Phrases:
    """Distinct windows as rows of word numbers, with the items (by place in ``items``) that hold each.

    The owners of row k are owner[first[k] : first[k + 1]]. All is of 32 bits, so a block of BLOCK bytes of
    phrases takes some 10 times that, and 26 times in the worst case (words of one letter).
    """

    numbers: dict[bytes, int]
    rows: np.ndarray
    length: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    items: list[str]


def phrases_of(benchmark: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
    """Windows of ``window`` consecutive words of each item; an item of fewer, but not none, is one window."""
    numbers: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], list[int]] = {}
    names: dict[str, int] = {}
    for item, text in benchmark:
        n = [numbers.setdefault(w, len(numbers) + 2) for w in words(text)]
        k = names.setdefault(str(item), len(names)) if n else None
        for i in range(max(1, len(n) - window + 1) if n else 0):
            held = owners.setdefault(tuple(n[i : i + window]), [])
            if not held or held[-1] != k:
                held.append(k)
    length = np.array([len(w) for w in owners], np.int32)
    rows = np.zeros((len(owners), window), np.int32)
    for i, w in enumerate(owners):
        rows[i, : len(w)] = w
    held = [sorted(set(v)) for v in owners.values()]
    first = np.concatenate([[0], np.cumsum([len(v) for v in held], dtype=np.int64)]).astype(np.int32)
    return Phrases(numbers, rows, length, first, np.array([k for v in held for k in v], np.int32), list(names))


def scan_shard(phrases: Phrases, texts: list[str | None]) -> tuple[list[int], list[list[int]], list[list[str]]]:
    """Of each text: its number of words, its removal spans (word from, word to, ...) and the items found."""
    counts, parts = [], []
    get = phrases.numbers.get
    for t in texts:
        w = words(t)
        counts.append(len(w))
        parts.append(np.fromiter(map(get, w, repeat(1)), np.int64, len(w)))
        parts.append(np.ones(1, np.int64))  # a foreign word between documents
    spans: list[list[int]] = [[] for _ in texts]
    found: list[list[str]] = [[] for _ in texts]
    if not len(phrases.rows) or not texts:
        return counts, spans, found
    text = np.concatenate(parts)
    foreign = np.concatenate([[-1], np.flatnonzero(text == 1)])
    run = np.diff(foreign) - 1
    kept = np.flatnonzero(run >= phrases.length.min())
    if not len(kept):
        return counts, spans, found
    # The kept stretches with one foreign word behind each, and where they came from.
    size = run[kept] + 1
    shift = np.concatenate([[0], np.cumsum(size)[:-1]])
    source = np.arange(size.sum()) + np.repeat(foreign[kept] + 1 - shift, size)
    index = FMIndex(text[source], len(phrases.numbers) + 1)
    low, high = index.search(phrases.rows, phrases.length)
    hits = high - low
    which = np.repeat(np.arange(len(hits)), hits)
    rows = np.arange(hits.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(hits)[:-1]]), hits)
    begin = source[index.locate(rows)]
    first = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
    doc = np.searchsorted(first, begin, "right") - 1
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + phrases.length[which], -1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8)]))
    for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True):
        d = int(np.searchsorted(first, a, "right") - 1)
        spans[d] += [int(a - first[d]), int(b - first[d])]
    pairs = np.unique(doc * len(hits) + which)
    for d, w in zip(pairs // len(hits), pairs % len(hits), strict=True):
        found[d] += [phrases.items[k] for k in phrases.owner[phrases.first[w] : phrases.first[w + 1]]]
    return counts, spans, [sorted(set(f)) for f in found]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block: int = BLOCK,
) -> DataFrame:
    """Append to every row: n_words long, spans array<long>, item_ids array<string>.

    Spans are merged word ranges, flattened (from, to, from, to ...), of the words inside any occurrence of
    a window. Null and empty texts have no words. Null item ids or texts match nothing; items of equal id
    count as one. Benchmarks above ``block`` bytes are handled block by block in one pass over the documents,
    and the finds of all blocks are merged. Whole texts are searched, however long: one of more than SHARD
    bytes is a shard by itself. Repeated rows each get their result; an empty table gives no rows. Input
    columns named like an output are replaced by it, all others stay.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).head()[0]
    blocks = max(1, -(-total // block))
    held = []
    for k in range(blocks):
        # At most ``block`` bytes on average are collected at once, whatever the benchmark's size.
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        held.append(docs.sparkSession.sparkContext.broadcast(phrases_of(sorted(map(tuple, part.collect())), window)))

    def scan(texts: list[str | None]) -> list[list]:
        counts, spans, found = scan_shard(held[0].value, texts)
        for p in held[1:]:
            _, more, items_of = scan_shard(p.value, texts)
            spans = [merged(a + b) if b else a for a, b in zip(spans, more, strict=True)]
            found = [sorted({*a, *b}) if b else a for a, b in zip(found, items_of, strict=True)]
        return [counts, spans, found]

    return per_text(docs, text, "n_words long, spans array<long>, item_ids array<string>", scan, SHARD)


def merged(flat: list[int]) -> list[int]:
    """Ranges (from, to, from, to ...) in order, those that meet made one."""
    out: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def verdicts(found: DataFrame) -> DataFrame:
    """Append n_hit and contaminated: at least one word in twenty inside a window."""
    n_hit = F.aggregate(
        F.expr("sequence(0, cast(size(spans) div 2 as int) - 1)"), F.lit(0).cast("long"),
        lambda s, i: s + F.get("spans", 2 * i + 1) - F.get("spans", 2 * i),
    )
    return found.withColumn("n_hit", F.when(F.size("spans") > 0, n_hit).otherwise(F.lit(0).cast("long"))).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def remove_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """``docs`` with every merged span cut out of the texts: all columns, all rows; other texts stay as they are."""

    def cut(df: DataFrame) -> DataFrame:
        found = find_contamination(df, benchmark, text, item_id, item_text, window)
        return _cut(found, text)

    made, own = with_outputs(docs, [text], cut)
    return made.select(*own)


def _cut(df: DataFrame, text: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            both = zip(b.column(text).to_pylist(), b.column("spans").to_pylist(), strict=True)
            new = pa.array([remove_spans(t, s) for t, s in both], pa.string())
            yield b.set_column(b.schema.get_field_index(text), text, new)

    return df.mapInArrow(run, df.schema)


def remove_spans(text: str | None, spans: list[int]) -> str | None:
    """The text without the words of ``spans`` and what stands between them."""
    if not text or not spans:
        return text
    at = [m.span() for m in _WORD.finditer(text.lower() if text.isascii() else _lower_ascii(text))]
    out, start = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[start : at[a][0]])
        start = at[b - 1][1]
    return "".join([*out, text[start:]])


def _lower_ascii(text: str) -> str:
    return text.translate({c: c + 32 for c in range(0x41, 0x5B)})


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """The words and benchmark items that every document shares with the benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return verdicts(found).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


_A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_A_Z}', '{_A_Z.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, '{_A_Z}', '{_A_Z.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), bi AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) t WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM di),
hit AS (SELECT doc_id, dw.n AS n, i, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
place AS (SELECT DISTINCT doc_id, i, n FROM hit),
word AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM place) p GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hit) h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
FROM d LEFT JOIN word ON d.doc_id = word.doc_id LEFT JOIN item ON d.doc_id = item.doc_id
"""
