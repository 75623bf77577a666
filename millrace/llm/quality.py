"""Quality classifier by co-training.

Two views of a document that share no source: its text (hashed words, and how the text is laid out, in
quantile bins) and the metadata of its page (language, source and length as they are recorded, and pairs of
them). A logistic regression of each view starts from the labelled rows; over some rounds each labels
unlabelled documents that it is confident about for the other. Both are then calibrated on held-out
labelled rows, and the combined log-odds are calibrated again, together with the strongest words' weights: a
few insults say the same in a long text as in a short one.

Fitting uses samples of fixed size, drawn by a hash of doc_id: LABELLED rows and POOL unlabelled ones, of
which only features reach the driver. Every document is scored whole, by a broadcast of fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import slices, small_join, words

#: Rows of the labelled sample and of the unlabelled pool; co-training rounds; pseudo-labels a round and class.
LABELLED, POOL, ROUNDS, PICKS = 6000, 4000, 4, 150
#: Hashed words; bins of a number; hash cells of each kind of name; least confidence to pass on.
WORDS, BINS, NAMES, SURE = 1 << 16, 12, 256, 0.95
#: Share of the labelled sample that calibrates.
HELD = 0.3
#: Strongest words that count undivided by the text's length.
STRONGEST = 3
_SIGNS = re.compile(r"[^\w\s]{2,}")
_UPPER, _DIGIT, _SPACE, _MARK = (
    bytes(b for b in range(256) if chr(b).isupper() and b < 128), b"0123456789", b" \t\r\n",
    bytes(b for b in range(33, 127) if not chr(b).isalnum()),
)


def text_features(text: str | None) -> np.ndarray:
    """Cells of the text's distinct words and runs of signs.

    Pairs of words were tried: on held-out rows they kept fewer clean and more toxic documents.
    """
    grams = set(words(text))
    grams.update(f"\x00{s[:4]}".encode() for s in set(_SIGNS.findall(text or "")))
    return np.fromiter(map(zlib.crc32, grams), np.uint32, len(grams)).astype(np.int64) % WORDS


#: Names of the numbers that ``layout`` gives.
LAYOUT = ("bytes", "words", "line", "word", "upper", "digits", "space", "marks", "wide", "distinct", "top", "again", "ends")


def layout(text: str | None) -> list[float]:
    """Sizes and shares that say how a page looks, not what it says."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    w = words(text)
    share = lambda drop: 1 - len(raw.translate(None, drop)) / n
    lines = (text or "").split("\n")
    k = max(1, len(w))
    count = Counter(w)
    return [
        np.log1p(len(raw)), np.log1p(len(w)), np.log1p(n / len(lines)), sum(map(len, w)) / k, share(_UPPER),
        share(_DIGIT), share(_SPACE), share(_MARK), share(bytes(range(128, 256))),
        len(count) / np.sqrt(k), max(count.values(), default=0) / k, 1 - len(set(lines)) / len(lines),
        sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / len(lines),
    ]


def _name(kind: str, value: object) -> int:
    return zlib.crc32(f"{kind}={value}".encode()) % NAMES


@dataclass
class Linear:
    """Sparse logistic regression: weights by cell, and a bias.

    The cells below ``words`` and those from it on count as two groups, each divided by the root of its size.
    """

    weight: np.ndarray
    bias: float = 0.0
    words: int = 0

    def log_odds(self, rows: list[np.ndarray]) -> np.ndarray:
        flat, at, scale = _flat(rows, self.words)
        return self.bias + np.bincount(at, self.weight[flat] * scale, len(rows))

    def strongest(self, rows: list[np.ndarray]) -> np.ndarray:
        """The sum of each row's STRONGEST greatest word weights, which other cells don't divide away."""
        return np.array([np.sort(np.maximum(self.weight[r[r < self.words]], 0))[-STRONGEST:].sum() for r in rows], float)


def _flat(rows: list[np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All cells in turn, the row of each and its scale."""
    n = np.array([len(r) for r in rows], np.int64)
    if not n.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    flat, at = np.concatenate(rows), np.repeat(np.arange(len(rows)), n)
    word = flat < words
    size = np.bincount(at, word, len(rows))
    return flat, at, 1 / np.sqrt(np.maximum(np.where(word, size[at], n[at] - size[at]), 1))


def fit_linear(rows: list[np.ndarray], y: np.ndarray, cells: int, words: int = 0, steps: int = 120, l2: float = 1e-3, rate: float = 1.0) -> Linear:
    """Full-batch gradient descent with steps scaled by each cell's past gradients."""
    model = Linear(np.zeros(cells), words=words)
    flat, at, scale = _flat(rows, words)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model.bias = float(np.log(share / (1 - share)))
    past, past_bias = np.full(cells, 1e-8), 1e-8
    balance = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    for _ in range(steps):
        z = model.bias + np.bincount(at, model.weight[flat] * scale, len(rows))
        off = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(rows)
        grad = np.bincount(flat, off[at] * scale, cells) + l2 * model.weight
        past += grad**2
        model.weight -= rate * grad / np.sqrt(past)
        past_bias += off.sum() ** 2
        model.bias -= rate * off.sum() / np.sqrt(past_bias)
    return model


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Weights (bias last) of a small dense logistic regression, by Newton steps, on smoothed targets.

    The weights are shrunk, the bias is not, so a view that tells nothing of few rows gets little weight.
    """
    x = np.column_stack([x, np.ones(len(x))])
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w, l2 = np.zeros(x.shape[1]), l2 * np.eye(x.shape[1])
    l2[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + l2
        step = np.linalg.solve(h, x.T @ (p - t) + l2 @ w)
        w -= np.clip(step, -5, 5)
    return w


@dataclass
class Edges:
    """Bounds of the bins: of each layout number, and of the recorded length."""

    layout: np.ndarray
    length: np.ndarray


@dataclass
class CoTrained:
    """Both views of one label, and what calibrates them."""

    text: Linear
    meta: Linear
    edges: Edges
    text_scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    meta_scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    both: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 0.0, 0.0]))
    #: What the calibrated metadata give a row of no particular page, from which they count.
    usual: float = 0.0
    #: From this probability on a document is said to bear the label, see ``cut_off``; None without held-out rows.
    cut: float | None = None
    #: Given where the labels are of one class only, or missing.
    constant: float | None = None

    def score(self, text: list[np.ndarray], meta: list[np.ndarray]) -> np.ndarray:
        """The calibrated probability of each row."""
        if self.constant is not None:
            return np.full(len(text), self.constant)
        a = self.text.log_odds(text) * self.text_scale[0] + self.text_scale[1]
        b = self.meta.log_odds(meta) * self.meta_scale[0] + self.meta_scale[1]
        z = np.column_stack([np.clip(a, -12, 12), np.clip(b - self.usual, -12, 12), self.text.strongest(text), np.ones(len(a))]) @ self.both
        return 1 / (1 + np.exp(-z))


#: Cells of the text view, and of the metadata view: a bin of the length (or none), and names.
TEXT, META = WORDS + len(LAYOUT) * BINS, (BINS + 1) * (1 + NAMES) + 3 * NAMES


def text_view(words: list[np.ndarray], numbers: np.ndarray, edges: Edges) -> list[np.ndarray]:
    """Cells of one row each: its words, and the quantile bin of each layout number."""
    k = len(LAYOUT)
    bins = np.column_stack([np.searchsorted(edges.layout[j], numbers[:, j], "right") for j in range(k)]) if len(numbers) else np.zeros((0, k), int)
    return [np.concatenate([w, WORDS + np.arange(k) * BINS + b]) for w, b in zip(words, bins, strict=True)]


def meta_view(lang: list, source: list, length: list, edges: Edges) -> list[np.ndarray]:
    """Cells of one row each: language, source and recorded length, and what language has which source and length."""
    out = []
    for a, b, n in zip(lang, source, length, strict=True):
        size = BINS if n is None else int(np.searchsorted(edges.length, n, "right"))
        first = BINS + 1
        names = [_name("lang", a), NAMES + _name("source", b), 2 * NAMES + _name("both", (a, b))]
        out.append(np.array([size, *(first + c for c in names), first + 3 * NAMES + size * NAMES + _name("lang", a)], np.int64))
    return out


def frequent(rows: list[np.ndarray], least: int = 3) -> list[np.ndarray]:
    """The rows without cells that fewer than ``least`` of them have: nothing general is learned from those."""
    count = np.bincount(np.concatenate(rows), minlength=TEXT) if rows else np.zeros(TEXT, int)
    return [r[count[r] >= least] for r in rows]


def cut_off(p: np.ndarray, y: np.ndarray, lost: float) -> float:
    """The least probability that at most a share of ``lost`` of the rows without the label (y = 0) reaches."""
    without = np.sort(p[y == 0])[::-1]
    return float(np.nextafter(without[int(lost * len(without))], 2))


def co_train(text: list[np.ndarray], meta: list[np.ndarray], y: np.ndarray, n_labelled: int, edges: Edges) -> CoTrained:
    """Fit both views: rows before ``n_labelled`` have labels ``y``, the rest are the pool."""
    y = y.astype(float)
    if n_labelled == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (n_labelled + 2)
        return CoTrained(Linear(np.zeros(TEXT), words=WORDS), Linear(np.zeros(META)), edges, constant=float(share))
    held = np.arange(n_labelled) % 10 < 10 * HELD
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    known = np.flatnonzero(~held)
    text = frequent(text)
    pool = list(range(n_labelled, len(text)))
    views = {0: (text, TEXT, WORDS), 1: (meta, META, 0)}
    got: dict[int, dict[int, float]] = {0: {}, 1: {}}

    def fit(v: int) -> Linear:
        rows, cells, words = views[v]
        at = [*known, *got[v]]
        return fit_linear([rows[i] for i in at], np.concatenate([y[known], list(got[v].values())]), cells, words)

    models = {v: fit(v) for v in views}
    for _ in range(ROUNDS if pool else 0):
        for v in views:
            other = 1 - v
            free = [i for i in pool if i not in got[other]]
            if not free:
                continue
            z = models[v].log_odds([views[v][0][i] for i in free])
            order = np.argsort(z, kind="stable")
            sure = np.log(SURE / (1 - SURE))
            for i in order[:PICKS]:
                if z[i] <= -sure:
                    got[other][free[i]] = 0.0
            for i in order[::-1][:PICKS]:
                if z[i] >= sure:
                    got[other][free[i]] = 1.0
        models = {v: fit(v) for v in views}
    made = CoTrained(models[0], models[1], edges)
    cal = np.flatnonzero(held) if held.any() else known
    a, b = (models[v].log_odds([views[v][0][i] for i in cal]) for v in views)
    made.text_scale, made.meta_scale = fit_logistic(a[:, None], y[cal]), fit_logistic(b[:, None], y[cal])
    a, b = a * made.text_scale[0] + made.text_scale[1], b * made.meta_scale[0] + made.meta_scale[1]
    strong = models[0].strongest([text[i] for i in cal])
    made.usual = float(b.mean())
    made.both = fit_logistic(np.column_stack([np.clip(a, -12, 12), np.clip(b - made.usual, -12, 12), strong]), y[cal])
    if held.any():
        made.cut = cut_off(made.score([text[i] for i in cal], [meta[i] for i in cal]), y[cal], LOST)
    return made


@dataclass
class Sample:
    """Of a bounded sample, by id: words' cells, layout numbers and metadata."""

    ids: list
    cells: list[np.ndarray]
    numbers: np.ndarray
    lang: list
    source: list
    length: list


def _gather(rows: DataFrame) -> Sample:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([text_features(t).astype(np.int32) for t in texts], pa.list_(pa.int32())),
                 pa.array([layout(t) for t in texts], pa.list_(pa.float64())), *(b.column(c) for c in PAGE)],
                ["doc_id", "cells", "numbers", *PAGE],
            )

    got = rows.mapInArrow(run, "doc_id long, cells array<int>, numbers array<double>, lang string, source string, n_chars long")
    t = got.toArrow().combine_chunks()
    ids = t["doc_id"].to_pylist()
    if not ids:
        return Sample([], [], np.zeros((0, len(LAYOUT))), [], [], [])
    cells, numbers = t["cells"].combine_chunks(), t["numbers"].combine_chunks()
    flat, ends = cells.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(cells).to_numpy())])
    numbers = numbers.flatten().to_numpy().reshape(len(ids), len(LAYOUT))
    # One row for each id: of several, that of most cells (and then of the greatest numbers).
    best: dict[int, int] = {}
    for i, d in enumerate(ids):
        j = best.get(d)
        if j is None or (ends[i + 1] - ends[i], *numbers[i]) > (ends[j + 1] - ends[j], *numbers[j]):
            best[d] = i
    at = [best[d] for d in sorted(best)]
    lang, source, length = (t[c].to_pylist() for c in PAGE)
    return Sample(
        [ids[i] for i in at], [flat[ends[i] : ends[i + 1]].astype(np.int64) for i in at], numbers[at],
        [lang[i] for i in at], [source[i] for i in at], [length[i] for i in at],
    )


#: Recorded metadata of a page.
PAGE = ("lang", "source", "n_chars")


def _page(docs: DataFrame, *more: str) -> DataFrame:
    """The columns that are looked at, of the types they are looked at in."""
    return docs.select(*more, "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, names: list[str], labelled: int = LABELLED, pool: int = POOL) -> dict[str, CoTrained]:
    """A co-trained model of each label column.

    Of ``docs``, ``labelled`` rows with labels and ``pool`` without are used at most; null ids and labels,
    and ids that bear several labels, aren't.
    """
    by_hash = F.xxhash64("doc_id", F.lit(11))
    ids = docs.select("doc_id").where("doc_id is not null")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        *[F.min(n).alias(n) for n in names], *[F.max(n).alias(f"_{n}") for n in names]
    )
    same = " and ".join(f"{n} = _{n}" for n in names)
    some = marks.where(same).join(ids, "doc_id", "left_semi").select("doc_id", *names).orderBy(by_hash).limit(labelled).collect()
    label = {r[0]: tuple(r[1:]) for r in some}
    rest = ids.join(labels.select("doc_id"), "doc_id", "left_anti").distinct().orderBy(by_hash).limit(pool).collect()
    spark = docs.sparkSession
    asked = spark.createDataFrame([(i,) for i in [*label, *(r[0] for r in rest)]], "doc_id long")
    got = _gather(small_join(_page(docs, "doc_id"), asked, labelled + pool, "doc_id"))
    at = np.arange(1, BINS) / BINS
    known = [n for n in got.length if n is not None]
    edges = Edges(
        np.quantile(got.numbers, at, axis=0).T if got.ids else np.zeros((len(LAYOUT), BINS - 1)),
        np.quantile(known, at) if known else np.zeros(BINS - 1),
    )
    text, meta = text_view(got.cells, got.numbers, edges), meta_view(got.lang, got.source, got.length, edges)
    order = sorted(range(len(got.ids)), key=lambda i: (got.ids[i] not in label, zlib.crc32(str(got.ids[i]).encode())))
    n = sum(i in label for i in got.ids)
    y = np.array([label[got.ids[i]] for i in order[:n]], float).reshape(n, len(names))
    text, meta = [text[i] for i in order], [meta[i] for i in order]
    return {name: co_train(text, meta, y[:, k], n, edges) for k, name in enumerate(names)}


def score_documents(docs: DataFrame, models: dict[str, CoTrained]) -> DataFrame:
    """Append a probability column ``p_<name>`` for each model.

    Whole texts are scored, however long; null and empty ones have no words and the layout of an empty page,
    and missing metadata are names of their own. Every row gets its score, repeated ones the same; an empty
    table gives no rows. Input columns named like an output are replaced by it, all others stay.
    """
    held = docs.sparkSession.sparkContext.broadcast(models)
    names = [f"p_{m}" for m in models]
    taken = {n.lower() for n in names}
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts, (lang, source, length) = b.column("text").to_pylist(), (b.column(c).to_pylist() for c in PAGE)
            cells = [text_features(t) for t in texts]
            numbers = np.array([layout(t) for t in texts]).reshape(len(texts), len(LAYOUT))
            for name, m in zip(names, held.value.values(), strict=True):
                p = m.score(text_view(cells, numbers, m.edges), meta_view(lang, source, length, m.edges))
                b = b.append_column(name, pa.array(p))
            yield b

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]]))


#: The labels' columns that are learned.
LABELS = ["quality", "toxic"]
#: Documents of a lower quality are rejected.
LEAST_QUALITY = 0.35
#: Share of the held-out documents that aren't toxic that may be rejected as such; the cut-off where none are held out.
LOST, MOST_TOXIC = 0.005, 0.5


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Append p_quality, p_toxic and keep: not of too low a quality, nor too toxic.

    Ties with a cut-off are kept for quality and rejected for toxicity. Columns named like these are replaced.
    """
    models = train(docs, labels, LABELS)
    cut = models["toxic"].cut
    scored = score_documents(docs, models)
    return scored.withColumn("keep", (F.col("p_quality") >= LEAST_QUALITY) & (F.col("p_toxic") < (MOST_TOXIC if cut is None else cut)))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """The calibrated scores of all documents, and whether each is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *PAGE)
    judged = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "p_quality", "p_toxic", "keep")
