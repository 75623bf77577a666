"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive words; a shingle's weight is its count times the mean inverse document
frequency of its words. (Frequencies of shingles themselves would be the sizes of the very groups looked
for and would lower the similarity inside large ones.) Word frequencies are counted over all documents in
a table of fixed size, by hash. Samples are grouped in bands; documents that share a band are candidates,
verified by their exact weighted Jaccard similarity, and the links' components are the classes.

Equal texts are one node from the start. Within a bucket no all-pairs list is made: its first member is
compared with all, components are formed, and only members of different components are compared further,
a slice of leaders at a time and in blocks of bounded size, each pair in the first band that it shares, until
every pair of different components has been compared. Before texts are
fetched a pair is held against two bounds: sums of weights by a hash of the shingle, which are exact and
sharp for short texts, and the samples themselves, sharp for long ones: a pair similar enough agrees in
fewer of them than the least number asked for in less than one case in 10,000.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import per_text, slices, small_join, unused, words
from millrace.llm.components import connected_components, merged_components
from millrace.session import BROADCAST_BYTES, discard, materialize

#: Words in a shingle; least similarity; leaders of a bucket in the first further round.
SHINGLE, LEAST, LEADERS = 5, 0.8, 8
#: Share of pairs just similar enough that may share no band; samples a band at most.
LOST, MOST_ROWS = 2.5e-4, 4
#: Sums of weights, by a hash of the shingle, that bound a pair's similarity from above; steps that a total is parted in.
BINS, STEPS = 256, 32767
#: Standard deviations below the mean from which on a pair's agreeing samples are too few.
SLACK = 5.0
#: Cells of the table of word frequencies (a fixed 2 MB); rows of the table of random variates.
CELLS, VARIATES = 1 << 18, 1 << 15


def banding(least: float) -> tuple[int, int]:
    """Bands and samples in each: the longest bands that lose at most LOST of the pairs of this similarity."""
    need = lambda rows: math.ceil(math.log(LOST) / math.log1p(-(least**rows)))
    rows = max((r for r in range(1, MOST_ROWS + 1) if need(r) * r <= 200), default=1)
    return need(rows), rows


def least_agreement(least: float, samples: int) -> int:
    """Samples in which a pair of this similarity agrees, but for less than one case in 10,000."""
    return max(0, math.floor(samples * least - SLACK * math.sqrt(samples * least * (1 - least))))


#: Pairs of id and key (64 bytes each in a hash table) that may be broadcast; more are joined by shuffle.
PAIRS = BROADCAST_BYTES // 64
#: Bytes of text handled at once in a task.
BATCH = 1 << 20
_LOW44 = np.uint64((1 << 44) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in turn, and each text's number of words."""
    split = [words(t) for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(split)), np.uint64, int(n.sum())), n


def word_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold a word of each hash cell, over all rows, and the number of documents with words.

    Tasks add up before the shuffle; the table that reaches the driver has CELLS + 1 rows at most.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(CELLS + 1, np.int64)
        for part in slices(batches, "text", BATCH):
            h, n = _hashed(part.column("text").to_pylist())
            cell = (h & np.uint64(CELLS - 1)).astype(np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            pairs = np.sort(doc * CELLS + cell)
            once = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
            count[:CELLS] += np.bincount(once % CELLS, minlength=CELLS)
            count[CELLS] += int((n > 0).sum())
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at])], ["cell", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "cell int, n long")
    table = np.zeros(CELLS + 1, np.int64)
    got = rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table[got["cell"].to_numpy()] = got["n"].to_numpy()
    return table[:CELLS], int(table[CELLS])


def inverse_frequencies(count: np.ndarray, n_docs: int) -> np.ndarray:
    return (1 + np.log((1 + n_docs) / (1 + count))).astype(np.float32)


def weighted_shingles(
    texts: list[str | None], idf: np.ndarray, shingle: int = SHINGLE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in turn: the text of each distinct shingle, its 44-bit id and weight; and words by text.

    A text of fewer words, but not none, has one shingle of all of them.
    """
    h, n = _hashed(texts)
    padded = np.where(n > 0, np.maximum(n, shingle), 0)
    begin = np.concatenate([[0], np.cumsum(padded)])
    doc = np.repeat(np.arange(len(n)), padded)
    place = np.arange(begin[-1]) - begin[doc]
    at = np.flatnonzero(place < n[doc])
    full, weight = np.zeros(begin[-1], np.uint64), np.zeros(begin[-1], np.float32)
    full[at], weight[at] = h, idf[h & np.uint64(len(idf) - 1)]
    start = np.flatnonzero(place <= padded[doc] - shingle)
    mixed, mean = np.zeros(len(start), np.uint64), np.zeros(len(start), np.float32)
    for j in range(shingle):
        mixed = (mixed + full[start + j]) * np.uint64(0x9E3779B97F4A7C15 + 2 * j)
        mean += weight[start + j]
    key = (doc[start].astype(np.uint64) << np.uint64(44)) | (_mix(mixed) & _LOW44)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    return (key[first] >> np.uint64(44)).astype(np.int64), key[first] & _LOW44, mean[order[first]] / shingle * times, n


@lru_cache(maxsize=2)
def _variates(samples: int, seed: int = 7) -> np.ndarray:
    """For each sample and row: 1/r, beta, r, and ln c + r (beta - 1), with r and c of Gamma(2, 1)."""
    rng = np.random.default_rng(seed)
    out = np.empty((samples, VARIATES, 4), np.float32)
    for s in range(samples):
        r, c = rng.gamma(2.0, 1.0, VARIATES), rng.gamma(2.0, 1.0, VARIATES)
        beta = rng.random(VARIATES)
        out[s] = np.stack([1 / r, beta, r, np.log(c) + r * (beta - 1)], 1)
    return out


def band_hashes(doc: np.ndarray, ids: np.ndarray, weight: np.ndarray, texts: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """``bands`` hashes of each text that has shingles (zeros for the rest), and 16 bits of each sample.

    A sample is the shingle with the least ln a = ln c - r (floor(ln w / r + beta) - beta) - r, with that
    floor; variates come from a table by the shingle's hash, so equal shingles of equal weight agree in all
    documents. Of shingles that share a row of the table the one of greatest id is taken.
    """
    out = np.zeros((texts, bands), np.uint64)
    short = np.zeros((texts, bands * rows), np.uint16)
    if not len(doc):
        return out.view(np.int64), short.view(np.int16)
    start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    which = doc[start]
    size = np.diff(np.append(start, len(doc)))
    group = np.repeat(np.arange(len(start)), size)
    row = (_mix(ids) & np.uint64(VARIATES - 1)).astype(np.int32)
    log_w = np.log(weight)
    table = _variates(bands * rows)
    for s in range(bands * rows):
        v = table[s].take(row, axis=0)
        t = np.floor(log_w * v[:, 0] + v[:, 1])
        a = v[:, 3] - v[:, 2] * t
        best = np.flatnonzero(a == np.minimum.reduceat(a, start)[group])
        sample = np.zeros(len(start), np.uint64)
        sample[group[best]] = _mix((ids[best] << np.uint64(20)) ^ (t[best].astype(np.int64) & 0xFFFFF).astype(np.uint64))
        short[which, s] = (sample >> np.uint64(40)).astype(np.uint16)
        b = s // rows
        out[which, b] = _mix(out[which, b] + sample + np.uint64(s + 1))
    return out.view(np.int64), short.view(np.int16)


def weight_bins(doc: np.ndarray, ids: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """A row of BINS sums of weights for each text, as shares of its total in steps of 1/STEPS.

    Sums of two texts differ by no more, in all, than the weights themselves do, so their differences bound
    the weighted symmetric difference from below, but for half a step a bin.
    """
    at = doc * BINS + (ids % np.uint64(BINS)).astype(np.int64)
    sums = np.bincount(at, weight.astype(np.float64), texts * BINS).astype(np.float64).reshape(texts, BINS)
    total = sums.sum(1, keepdims=True)
    return np.rint(np.divide(sums, total, out=np.zeros_like(sums), where=total > 0) * STEPS).astype(np.int16)


def similarities(left: list[str | None], right: list[str | None], idf: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The weighted Jaccard similarity of each pair of texts: sum of least by sum of greatest weights."""
    n = len(left)
    a_doc, a_id, a_w, _ = weighted_shingles(left, idf, shingle)
    b_doc, b_id, b_w, _ = weighted_shingles(right, idf, shingle)
    a, b = (a_doc.astype(np.uint64) << np.uint64(44)) | a_id, (b_doc.astype(np.uint64) << np.uint64(44)) | b_id
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = np.bincount(a_doc[i], np.minimum(a_w[i], b_w[j]).astype(np.float64), n)
    every = np.bincount(a_doc, a_w.astype(np.float64), n) + np.bincount(b_doc, b_w.astype(np.float64), n) - both
    return np.divide(both, every, out=np.zeros(n), where=every > 0)


def _members(nodes: DataFrame) -> DataFrame:
    """bucket, band, node, total and lead (the bucket's node of most copies, then of least hash), of shared buckets."""
    spread = nodes.select("node", "total", "n", F.posexplode("bands").alias("band", "h")).select(
        F.xxhash64("band", "h").alias("bucket"), "band", "node", "total", "n"
    )
    first = F.struct((-F.col("n")).alias("copies"), F.xxhash64("node").alias("h"), "node", "total")
    leads = (
        spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("all"), F.min(first).alias("lead")).where("all > 1")
        .select("bucket", F.struct("lead.node", "lead.total").alias("lead"))
    )
    # Large at any scale worth it, so it is dealt by bucket whatever the size.
    return materialize(spread.drop("n").join(leads.hint("merge"), "bucket"), "members")


def _near_totals(a: str, b: str, least: float):
    """Whether total weights allow enough similarity."""
    return F.least(a, b) >= (least - 1e-5) * F.greatest(a, b)


def _may_be_similar(a: str, b: str, least: float, samples: int):
    """Whether sums of weights and samples of both sides (structs of total, mass, sketch) allow enough similarity."""
    of = lambda side, field: F.col(f"{side}.{field}")
    steps = F.zip_with(of(a, "mass"), of(b, "mass"), lambda x, y: F.abs(x * of(a, "total").cast("double") - y * of(b, "total").cast("double")))
    apart = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / STEPS
    same = F.aggregate(F.zip_with(of(a, "sketch"), of(b, "sketch"), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (same >= least_agreement(least, samples)) & (apart <= _most_apart(least) * (of(a, "total") + of(b, "total")))


def _most_apart(least: float) -> float:
    """Share of |A| + |B| that |A - B| may be: (1 - J) / (1 + J), and what rounding of the sums may add."""
    return (1 - least) / (1 + least) + 1e-4 + BINS / (2 * STEPS)


#: Fields of a row of a block; members and leaders of a block, about; pairs that are compared at once.
_BLOCK = ("bucket", "part", "slice", "leads", "band", "node", "comp", "top", "u", "total", "mass", "sketch", "bands")
MEMBERS_A_BLOCK, LEADERS_A_BLOCK, PAIRS_AT_ONCE = 1024, 256, 1 << 13


def block_pairs(rows: pa.RecordBatch, least: float, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of whole blocks, each block's leaders first, that the bounds allow.

    A leader meets the members of its bucket's top component and of other components behind it. A pair is
    taken in the first band that both share, where it meets as well, so it isn't compared once a band.
    No rows give no pairs.
    """
    if not rows.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    col = {n: rows.column(n).to_numpy(zero_copy_only=False) for n in ("bucket", "part", "slice", "leads", "band", "node", "comp", "top", "u", "total")}
    table = lambda n: rows.column(n).flatten().to_numpy().reshape(rows.num_rows, -1)
    mass, sketch, bands = table("mass"), table("sketch"), table("bands")
    new = np.ones(rows.num_rows, bool)
    new[1:] = np.any([col[n][1:] != col[n][:-1] for n in ("bucket", "part", "slice")], axis=0)
    block = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    led = np.bincount(block, col["leads"], len(start)).astype(np.int64)
    size = np.diff(np.append(start, rows.num_rows)) - led
    leader = np.flatnonzero(col["leads"])
    upto = np.cumsum(size[block[leader]])
    fewest, most = least_agreement(least, samples), _most_apart(least)
    out, i = [], 0
    while i < len(leader):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS_AT_ONCE, "right")))
        some = leader[i:j]
        i = j
        times = size[block[some]]
        a = np.repeat(some, times)
        b = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times) + (start + led)[block[a]]

        def keep(ok, a, b):
            return a[ok], b[ok]

        a, b = keep((col["comp"][a] != col["comp"][b]) & ((col["comp"][b] == col["top"][a]) | (col["u"][b] > col["u"][a])), a, b)
        x, y = col["total"][a], col["total"][b]
        a, b = keep(np.minimum(x, y) >= (least - 1e-5) * np.maximum(x, y), a, b)
        a, b = keep((bands[a] == bands[b]).argmax(1) == col["band"][a], a, b)
        a, b = keep((sketch[a] == sketch[b]).sum(1) >= fewest, a, b)
        x, y = col["total"][a], col["total"][b]
        a, b = keep(np.abs(mass[a] * x[:, None] - mass[b] * y[:, None]).sum(1) / STEPS <= most * (x + y), a, b)
        out.append(np.stack([col["node"][a], col["node"][b]]))
    both = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return both.min(0), both.max(0)


def _compare_blocks(blocks: DataFrame, least: float, samples: int) -> DataFrame:
    """``block_pairs`` of all blocks: each lies whole in a task, which holds a batch and a block's rows at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows):
            return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in block_pairs(rows, least, samples)], ["a", "b"])

        rest = None
        for batch in batches:
            rows = batch if rest is None else pa.concat_batches([rest, batch])
            if not rows.num_rows:
                continue
            keys = np.stack([rows.column(n).to_numpy() for n in ("bucket", "part", "slice")])
            last = int(np.flatnonzero((keys != keys[:, -1:]).any(0))[-1]) + 1 if (keys != keys[:, -1:]).any() else 0
            if last:
                yield found(rows.slice(0, last))
            rest = pa.concat_batches([rows.slice(last)])
        if rest is not None and rest.num_rows:
            yield found(rest)

    dealt = blocks.repartition("bucket", "part", "slice").sortWithinPartitions("bucket", "part", "slice", F.desc("leads"))
    return dealt.mapInArrow(run, "a long, b long")


def _first_pairs(members: DataFrame, nodes: DataFrame, least: float, samples: int) -> DataFrame:
    """Each bucket's lead against all others, where the bounds allow it."""
    pairs = (
        members.where((F.col("node") != F.col("lead.node")) & _near_totals("total", "lead.total", least))
        .select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"))
        .distinct()
    )
    end = lambda e: nodes.select(F.col("node").alias(e), F.struct("total", "mass", "sketch").alias(f"of_{e}")).hint("merge")
    return pairs.join(end("a"), "a").join(end("b"), "b").where(_may_be_similar("of_a", "of_b", least, samples)).select("a", "b")


def _more_pairs(
    members: DataFrame, comps: DataFrame, progress: DataFrame | None, leaders: int, nodes: DataFrame, least: float, samples: int
) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """Pairs still to compare in buckets of several components, those buckets' members and their progress.

    A bucket's anchor is the component with most members when its turn first comes. Only members outside
    it lead, ``leaders`` or so at a time in order of their hash (so that the same lead in all buckets),
    against the anchor's members and those of other components behind them. As components only merge,
    every pair of different components has been compared once the last slice has led. Last come the tables
    that aren't needed once the pairs are there.
    """
    m = members.select("bucket", "band", "node").join(comps.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    m = materialize(m, "labelled")
    sizes = m.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    if progress is None:
        anchors = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("t")).select(
            "bucket", F.lit(0.0).alias("from"), F.col("t.comp").alias("anchor"), F.col("t.comp").alias("top")
        )
    else:
        now = comps.select(F.col("node").alias("anchor"), F.col("comp").alias("top"))
        anchors = progress.where("`from` < 1").join(now, "anchor", "left").withColumn("top", F.coalesce("top", "anchor"))
    rest = (
        sizes.join(anchors, "bucket")
        .groupBy("bucket", "from", "anchor", "top")
        .agg(F.sum(F.when(F.col("comp") != F.col("top"), F.col("n"))).alias("rest"), F.sum("n").alias("all"))
        .where("rest > 0")
        .withColumn("to", F.col("from") + leaders / F.col("rest"))
    )
    rest = materialize(rest, "progress")
    m = m.withColumn("u", F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / (1 << 30))
    active = materialize(m.join(rest.hint("merge"), "bucket"), "active")
    kept = active.select("bucket", "band", "node")
    signed = active.join(nodes.select("node", "total", "mass", "sketch", "bands").hint("merge"), "node")
    parts = F.ceil(F.col("all") / MEMBERS_A_BLOCK).cast("int")
    parts_of_lead = F.ceil(F.least(F.col("rest"), F.lit(leaders)) / LEADERS_A_BLOCK).cast("int")
    dealt = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    lead = signed.where("comp <> top and u >= `from` and u < `to`").withColumns({"leads": F.lit(True), "slice": dealt(parts_of_lead, 1)})
    other = signed.withColumns({"leads": F.lit(False), "part": dealt(parts, 2)})
    blocks = lead.withColumn("part", every(parts)).select(*_BLOCK).union(other.withColumn("slice", every(parts_of_lead)).select(*_BLOCK))
    pairs = _compare_blocks(blocks, least, samples)
    return pairs, kept, rest.select("bucket", F.col("to").alias("from"), "anchor"), [m, rest, active]


def _verify(pairs: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """The pairs whose texts are similar enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text_a", BATCH // 2):
            s = similarities(part.column("text_a").to_pylist(), part.column("text_b").to_pylist(), idf.value)
            yield part.select(["a", "b"]).filter(pa.array(s >= least - 1e-6))

    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _texts_of(pairs: DataFrame, nodes: DataFrame, base: DataFrame) -> DataFrame:
    """(node, text) of the pairs' nodes, read from one row of each."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    who = nodes.join(asked, "node", "left_semi").select("node", F.col("key").alias("k"), F.col("least.doc_id").alias("who"))
    who = materialize(who, "asked")
    found = small_join(base, who, who.count(), F.col("doc_id").eqNullSafe(F.col("who"))).where("k = key")
    texts = materialize(found.select("node", "text").dropDuplicates(["node"]), "texts")
    discard(who)
    return texts


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = LEAST
) -> DataFrame:
    """A row for every document: doc_id, key (of its text), class_id, class_size, first.

    Two texts of a similarity of ``least`` or more are linked, but for one pair in 4,000 of just that
    similarity, and linked texts share a class. class_id is the least doc_id of the class. ``first`` marks the
    rows that stay when one of each class is kept: those of least (doc_id, key); rows that repeat both are
    marked alike. Texts without words (null, empty, punctuation) are nobody's duplicates: each is a class of
    its own id, of size 1. Whole texts count, however long. Null ids sort last. An empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    bands, per_band = banding(least)
    samples = bands * per_band
    body = F.col(f"`{text}`")
    base = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.unhex(F.md5(F.coalesce(body, F.lit("")).cast("binary"))).alias("key"),
        body.alias("text"),
    )
    count, n_docs = word_frequencies(base)
    idf = spark.sparkContext.broadcast(inverse_frequencies(count, n_docs))

    def sign(texts):
        doc, ids, weight, n = weighted_shingles(texts, idf.value)
        hashes, short = band_hashes(doc, ids, weight, len(texts), bands, per_band)
        return [n.tolist(), np.bincount(doc, weight.astype(np.float64), len(texts)).tolist(), list(hashes), list(short), list(weight_bins(doc, ids, weight, len(texts)))]

    signed = per_text(base, "text", "n_words long, total float, bands array<long>, sketch array<short>, mass array<short>", sign, BATCH)
    signed = materialize(signed.drop("text"), "signed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    of_key = [F.first(c).alias(c) for c in ("total", "bands", "sketch", "mass")]
    nodes = signed.where("n_words > 0").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("least"), *of_key)
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = materialize(signed.select("doc_id", "key", "n_words"), "rows")
    discard(signed)
    members = _members(nodes)
    pairs, progress, tried, comps, leaders, spent = _first_pairs(members, nodes, least, samples), None, None, None, LEADERS, [members]
    while True:
        pairs = materialize(pairs, "pairs")
        if comps is not None:
            discard(*spent[:1])  # the labelled members; what is active leads to the next round
        if comps is None or not pairs.isEmpty():
            texts = _texts_of(pairs, nodes, base)
            links = materialize(_verify(pairs, texts, idf, least), "links")
            discard(texts)
            old = comps
            if comps is None:
                comps = connected_components(links)
            elif not links.isEmpty():
                comps = merged_components(comps, links)
            discard(links, old if old is not comps else None)
        tried = pairs if tried is None else tried.union(pairs)
        before = spent
        pairs, members, progress, spent = _more_pairs(members, comps, progress, leaders, nodes, least, samples)
        discard(*before)
        if progress.isEmpty():
            break
        pairs, leaders = pairs.join(tried, ["a", "b"], "left_anti"), 8 * leaders
    discard(*spent)
    classes = nodes.select("node", "key", "n", "least").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    whole = classes.groupBy("comp").agg(F.sum("n").alias("class_size"), F.min("least").alias("head"))
    by_key = materialize(classes.select("key", "comp").join(whole, "comp").select("key", "class_size", "head"), "classes")
    discard(nodes, comps)
    joined = rows.join(by_key, "key", "left")
    alone = F.col("n_words") == 0
    return joined.select(
        "doc_id",
        "key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("class_size")).alias("class_size"),
        (alone | (F.col("head.key").eqNullSafe(F.col("key")) & F.col("head.doc_id").eqNullSafe(F.col("doc_id")))).alias("first"),
    )


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = LEAST) -> DataFrame:
    """The documents with one of each class kept (all columns as they were, whatever their names).

    Of rows that repeat both id and text one stays; texts without words all stay.
    """
    classes = materialize(near_duplicates(docs, text, doc_id, least), "classed")
    left_id, left_key = unused(docs, "left_id"), unused(docs, "left_key")
    key = unused(docs, "key")
    pair = lambda df: df.select(F.col("doc_id").alias(left_id), F.col("key").alias(left_key))
    gone = materialize(pair(classes.where("not first")).distinct(), "gone")
    often = classes.where("first and class_size > 1").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    often = materialize(pair(often.where("n > 1")), "often")
    discard(classes)
    own_id = F.col(f"`{doc_id}`").cast("long")
    same = own_id.eqNullSafe(F.col(left_id)) & (F.col(key) == F.col(left_key))

    def met(df: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
        return df.join(F.broadcast(pairs) if pairs.count() <= PAIRS else pairs, same, how)

    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))))
    out = met(keyed, gone, "left_anti")
    if not often.isEmpty():
        once = met(out, often, "left_semi").dropDuplicates([doc_id, key])
        out = met(out, often, "left_anti").unionByName(once)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "class_size")
