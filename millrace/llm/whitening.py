"""Whitening of embeddings: TSQR of the centred rows block by block, then one-sided Jacobi on R.

Each task folds its rows into one triangle R, a block at a time (the R of the R so far upon the next block);
triangles are folded in groups until one is left, so no task holds more than a block and a few triangles.
Plane rotations make the columns of R orthogonal: their product holds the components, the lengths of the
rotated columns are the singular values. No covariance matrix is formed, so small deviations keep their
digits. What reaches the driver is bounded by the vectors' length: their sums and one triangle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices
from millrace.session import discard, materialize

#: Entries are floor(SCALE * c) + SHIFT, with SCALE * c put at plus or minus LIMIT beyond it.
SCALE, SHIFT, LIMIT = 1024, 100_000, float(1 << 50)
#: Entries in a batch; triangles folded by one task at most, and bytes of them; different lengths of vectors at most.
BATCH, FOLD, FOLD_BYTES, LENGTHS = 1 << 18, 32, 64 << 20, 1000
LONGEST = (1 << 63) - 1


def usable(df: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """vec_id and c (doubles) of the rows whose vector isn't null and holds no null or non-finite entry."""
    v = F.col(f"`{vector}`")
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return df.where(fine).select(F.col(f"`{vec_id}`").alias("vec_id"), v.cast("array<double>").alias("c"))


def matrices(batches: Iterable[pa.RecordBatch], most: int = BATCH) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and whole numbers (rows of one length) of batches of about ``most`` entries."""
    for part in slices(batches, "c", most):
        ids, c = part.column("vec_id"), part.column("c")
        size = np.diff(c.offsets.to_numpy())
        flat = np.floor(np.clip(c.flatten().to_numpy(zero_copy_only=False) * SCALE, -LIMIT, LIMIT)).astype(np.int64) + SHIFT
        if not len(size):
            continue
        if (size == size[0]).all():
            yield ids, flat.reshape(len(size), size[0])
            continue
        start = np.concatenate([[0], np.cumsum(size)])
        for d in np.unique(size):
            some = np.flatnonzero(size == d)
            yield ids.take(pa.array(some)), flat[start[some][:, None] + np.arange(d)]


@dataclass(frozen=True)
class Centre:
    """The mean of ``n`` rows of whole numbers, as its floor and what is left of the sum: exact at any size."""

    n: int
    floor: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        return cls(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Of each row the sum of (n x - S)^2, exact; put at the largest long beyond it."""
        y = x - self.floor
        about = ((self.centred(x) * self.n) ** 2).sum(1)
        out = np.full(len(x), LONGEST, np.int64)
        some = about < 0.999 * 2.0**63  # then every term, and so every product, fits
        out[some] = ((y[some] * self.n - self.rest) ** 2).sum(1)
        for i in np.flatnonzero(~some & (about < 1.001 * 2.0**63)):
            whole = sum((int(a) * self.n - int(r)) ** 2 for a, r in zip(y[i], self.rest, strict=True))
            out[i] = min(whole, LONGEST)
        return out


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a QR factorisation, with as many rows as columns."""
    d = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == d else np.vstack([r, np.zeros((d - len(r), d))])


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and right singular vectors (columns) by one-sided Jacobi.

    A sweep meets every pair of columns once, in rounds of disjoint pairs that are turned together. The sign
    of a component makes its largest entry positive.
    """
    d = r.shape[1]
    a, v = r.T.copy(), np.eye(d)  # rows here are the columns
    close = 4e-16 * np.sqrt(d)
    ring = np.arange(d + d % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]
            ok = (p < d) & (q < d)
            p, q = p[ok], q[ok]
            ap, aq = a[p], a[q]
            alpha, beta, gamma = (ap * ap).sum(1), (aq * aq).sum(1), (ap * aq).sum(1)
            some = np.flatnonzero(np.abs(gamma) > close * np.sqrt(alpha) * np.sqrt(beta))
            if len(some):
                turned = True
                p, q, ap, aq, g = p[some], q[some], ap[some], aq[some], gamma[some]
                with np.errstate(over="ignore"):
                    zeta = (beta[some] - alpha[some]) / (2 * g)
                    t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                c, s = c[:, None], (c * t)[:, None]
                a[p], a[q] = c * ap - s * aq, s * ap + c * aq
                vp, vq = v[p], v[q]
                v[p], v[q] = c * vp - s * vq, s * vp + c * vq
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    sigma = np.sqrt((a * a).sum(1))
    order = np.argsort(-sigma, kind="stable")
    v = v[order]
    v *= np.where(v[np.arange(d), np.abs(v).argmax(1)] < 0, -1.0, 1.0)[:, None] if d else 1.0
    return sigma[order], v.T


@dataclass(frozen=True)
class Fit:
    """A fit to vectors of one length: their centre, all singular values, the first components (columns)."""

    centre: Centre
    sigma: np.ndarray
    components: np.ndarray

    @property
    def deviations(self) -> np.ndarray:
        """Standard deviations along the components; NaN where they are none to double precision."""
        s = self.sigma[: self.components.shape[1]]
        return np.where(s > len(self.sigma) * np.finfo(float).eps * self.sigma[:1], s, np.nan) / np.sqrt(self.centre.n)

    @property
    def explained(self) -> list[float | None]:
        """Shares of the trace; None where nothing varies."""
        # Scaled by the largest, squares neither overflow nor vanish together.
        top = self.sigma[0] if len(self.sigma) else 0.0
        if not top:
            return [None] * self.components.shape[1]
        share = (self.sigma / top) ** 2
        return (share / share.sum())[: self.components.shape[1]].tolist()

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.components / self.deviations


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for _, x in matrices(batches):
        held = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
        held[0] += len(x)
        for a in range(0, len(x), 1024):  # 1,024 entries of 51 bits fit into a long
            held[1] = held[1] + x[a : a + 1024].sum(0)
    for d, (n, total) in found.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([d] * (d + 1), pa.int32()), pa.array(range(-1, d), pa.int32()),
                pa.array([n, *map(int, total)], pa.decimal128(38, 0)),
            ],
            ["size", "dim", "total"],
        )


def centres(rows: DataFrame, lengths: int = LENGTHS) -> dict[int, Centre]:
    """By length of the vectors: their number and mean."""
    table = rows.mapInArrow(_sums, "size int, dim int, total decimal(38,0)")
    sizes: dict[int, dict[int, int]] = {}
    for r in table.groupBy("size", "dim").agg(F.sum("total").cast("decimal(38,0)").alias("total")).toLocalIterator():
        sizes.setdefault(r["size"], {})[r["dim"]] = int(r["total"])
        if len(sizes) > lengths:
            raise ValueError(f"there are vectors of more than {lengths} different lengths (parameter lengths)")
    return {d: Centre.of(t[-1], [t[i] for i in range(d)]) for d, t in sizes.items()}


def triangles(rows: DataFrame, found: dict[int, Centre]) -> dict[int, np.ndarray]:
    """By length: R of all centred rows."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        waiting: dict[int, list[np.ndarray]] = {}

        def fold(d: int) -> None:
            held[d] = triangle(np.vstack([held.get(d, np.zeros((0, d))), *waiting.pop(d)]))

        for _, x in matrices(batches):
            d = x.shape[1]
            if d not in found:
                continue
            waiting.setdefault(d, []).append(found[d].centred(x))
            if sum(map(len, waiting[d])) >= 4 * d:
                fold(d)
        for d in list(waiting):
            fold(d)
        for d, r in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([r.tobytes()], pa.binary())], ["size", "r"])

    def group(parts: pd.DataFrame) -> pd.DataFrame:
        d = int(parts["size"].iloc[0])
        r = triangle(np.vstack([np.frombuffer(b).reshape(d, d) for b in parts.sort_values("part").r]))
        return pd.DataFrame({"size": [d], "part": [int(parts.part.iloc[0]) // fold], "r": [r.tobytes()]})

    fold = max(2, min(FOLD, FOLD_BYTES // (8 * max(found) ** 2)))
    made = rows.mapInArrow(task, "size int, r binary").withColumn("part", F.spark_partition_id())
    held = materialize(made.select("size", "part", "r"), "triangles")
    most = held.agg(F.max("part")).first()[0]
    while most:
        folded = materialize(held.groupBy("size", F.expr(f"part div {fold}")).applyInPandas(group, "size int, part int, r binary"), "triangles")
        discard(held)
        held, most = folded, most // fold
    out = {r["size"]: np.frombuffer(bytes(r["r"])).reshape(r["size"], r["size"]) for r in held.toLocalIterator()}
    discard(held)
    return out


def fit(rows: DataFrame, components: int) -> dict[int, Fit]:
    """By length of the vectors their centre and first components, of rows as ``usable`` gives them."""
    found = {d: c for d, c in centres(rows).items() if d}
    out = {}
    for d, r in (triangles(rows, found) if found else {}).items():
        sigma, v = jacobi(r)
        out[d] = Fit(found[d], sigma, v[:, :components])
    return out


def project(rows: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """vec_id, size, deviation and w (whitened coordinates; null along components that don't vary) of each row."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in matrices(batches):
            f = fits.get(x.shape[1])
            if f is None:
                continue
            w = f.whitened(x)
            flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(f.centre.deviations(x)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]), flat),
                ],
                ["vec_id", "size", "deviation", "w"],
            )

    return rows.mapInArrow(task, f"vec_id {kind}, size int, deviation long, w array<double>")


def identity_errors(whitened: DataFrame, fits: dict[int, Fit], components: int) -> dict[int, float | None]:
    """By length the largest difference of the coordinates' covariance from the identity, over components that vary."""
    at = [F.get("w", F.lit(i)) for i in range(components)]
    means = {r[0]: r[1:] for r in whitened.groupBy("size").agg(*map(F.avg, at)).collect()}
    table = whitened.sparkSession.createDataFrame(
        [(d, list(m)) for d, m in means.items()], "size int, mean array<double>"
    )
    off = [c - F.get("mean", F.lit(i)) for i, c in enumerate(at)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    # A row for each length of vectors: at most LENGTHS.
    cov = whitened.join(F.broadcast(table), "size").groupBy("size").agg(*[F.avg(off[i] * off[j]) for i, j in pairs])
    out: dict[int, float | None] = dict.fromkeys(fits)
    for d, *values in cov.collect():
        out[d] = max((abs(c - (i == j)) for (i, j), c in zip(pairs, values, strict=True) if c is not None), default=None)
    return out


def whiten(df: DataFrame, components: int = 8, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """A row for each usable vector and each of the first ``components``: vec_id, component (from 1, by falling
    variance), n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold a null or non-finite entry take no part. All others are fitted and whitened,
    rows of equal id, repeated rows and null ids too. Vectors of other lengths are a fit of their own (n is
    the number of those of a row's length); an empty vector has no components and gives no row, shorter
    vectors than ``components`` give as many rows as they have entries. Along a component that doesn't vary to
    double precision ``whitened`` is null; where nothing varies (one row, equal rows) so are ``explained`` and
    ``identity_error``. An entry beyond 2^50 / 1024 counts as that; a deviation beyond a long is put at its
    end. An empty table gives no rows; other columns are ignored, whatever their names. The input is read
    three times, so write it first if it is dear to make.
    """
    rows = usable(df, vector, vec_id)
    fits = fit(rows, components)
    whitened = materialize(project(rows, fits), "whitened")
    errors = identity_errors(whitened, fits, components) if fits else {}
    table = df.sparkSession.createDataFrame(
        [(d, i + 1, f.centre.n, e, errors[d]) for d, f in fits.items() for i, e in enumerate(f.explained)],
        "size int, component int, n long, explained double, identity_error double",
    )
    long = whitened.select("vec_id", "size", "deviation", F.posexplode("w").alias("at", "whitened"))
    long = long.withColumn("component", F.col("at") + 1)
    # At most ``components`` rows for each length of vectors.
    return long.join(F.broadcast(table), ["size", "component"]).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    )


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings along their first eight components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
