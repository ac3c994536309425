"""Embedding whitening by a one-sided Jacobi SVD.

Distinct vectors are counted and summed exactly as whole numbers, then centred. Each task folds blocks of centred rows into the
triangular factor R of their QR decomposition, and the factors of all tasks are folded into one by levels with a bounded number in
each group, so that no product of rows with themselves, which would square the condition, is ever made. Plane rotations make
R's columns orthogonal: their lengths give the standard deviations, small ones as accurately as large ones, and the accumulated
rotations the components. Only R, of the vectors' dimension squared, reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, dropped, free, materialise, release, struct_type

#: Steps of a unit that entries are cut to, and what is added so that they are positive.
STEPS, SHIFT = 64, 1_000_000
#: Components that are kept at most.
MOST = 16
#: Bytes of triangular factors that are folded in one task.
FACTOR_BYTES = 32 << 20
#: Components with a standard deviation under this part of the first one's are none: their direction is rounding.
LEAST = 1e-12


def whole(vector: Column) -> Column:
    """The entries as whole numbers; null if the vector is null or has an entry that is null or not finite."""
    entry = lambda x: x.cast("double")
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(entry(x)) != math.inf))
    return F.when(good, F.transform(vector, lambda x: F.floor(entry(x) * STEPS) + SHIFT))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of dim numbers as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@dataclass(frozen=True)
class Fitted:
    """n distinct vectors and the sums of their dimensions; components as rows, with the variance along each; the sum of all variances."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, each entry rounded once."""
        return (x * self.n - self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.variances)[:, None]).T

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """The exact sums of squares of n * x - sums; an error where they are beyond 64 bits."""
        off = x * self.n - self.sums
        if len(off) and float(np.abs(off).max()) ** 2 * off.shape[1] >= 2.0**63:
            values = [sum(int(v) ** 2 for v in row) for row in off]
            if max(values) >= 1 << 63:
                raise OverflowError("a deviation is beyond 64 bits")
            return np.array(values, np.int64)
        return (off * off).sum(1)


def plane_rotations(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, directions): the columns of r made orthogonal by rotations in planes of two, all pairs in each sweep, in rounds of
    disjoint pairs; singular values falling, and the right singular vectors as rows."""
    a, d = r.copy(), r.shape[1]
    order = np.argsort(-np.square(a).sum(0), kind="stable")  # long columns first: fewer sweeps
    v, a = np.eye(d)[:, order], a[:, order]
    ring = list(range(d + d % 2))
    for _ in range(sweeps):
        largest = 0.0
        for _ in range(len(ring) - 1):
            pairs = [(min(x), max(x)) for x in zip(ring[: len(ring) // 2], ring[::-1], strict=False) if max(x) < d]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            p, q = map(list, zip(*pairs, strict=True))
            ap, aq = a[:, p], a[:, q]
            alpha, beta, gamma = (ap * ap).sum(0), (aq * aq).sum(0), (ap * aq).sum(0)
            size = np.sqrt(alpha) * np.sqrt(beta)
            off = np.divide(np.abs(gamma), size, out=np.zeros_like(size), where=size > 0)
            largest = max(largest, float(off.max()))
            turn = off > 1e-16
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            a[:, p], a[:, q] = c * ap - s * aq, s * ap + c * aq
            vp, vq = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * vp - s * vq, s * vp + c * vq
        if largest < 1e-15:
            break
    lengths = np.sqrt(np.square(a).sum(0))
    falling = np.argsort(-lengths, kind="stable")
    v = v[:, falling] / np.sqrt(np.square(v).sum(0))[falling]
    signs = np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1.0, 1.0) if d else np.ones(0)  # the largest entry is positive
    return lengths[falling], (v * signs).T


def _folded(blocks: Iterator[np.ndarray], dim: int) -> np.ndarray | None:
    """The triangular factor of all blocks, one under another."""
    r = None
    for block in blocks:
        if len(block):
            r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
    return r


def _factor_batch(part: int, r: np.ndarray | None) -> pa.RecordBatch:
    rows = [] if r is None else [r.ravel()]
    return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), pa.array(rows, pa.list_(pa.float64()))], ["part", "r"])


def factor(vectors: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows of vectors (x array<long>): by task first, then by groups of tasks until one is left."""
    dim = len(sums)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centred = (((_matrix(b.column(0), dim) * n) - sums) / n for b in batches)
        yield _factor_batch(TaskContext.get().partitionId(), _folded(centred, dim))
        release()

    def of_group(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (x.reshape(-1, dim) for b in rows for x in b.column("r").to_numpy(zero_copy_only=False))
        yield _factor_batch(key[0].as_py(), _folded(parts, dim))

    width = max(2, min(64, FACTOR_BYTES // (8 * dim * dim)))
    now = materialise(vectors.mapInArrow(of_task, "part long, r array<double>"), "factors")
    while now.count() > 1:
        after = materialise(now.groupBy(F.floor(F.col("part") / width).alias("group")).applyInArrow(of_group, "part long, r array<double>"), "factors")
        dropped(now)
        now = after
    row = now.first()
    dropped(now)
    return np.array(row["r"]).reshape(-1, dim)


def _totals(rows: DataFrame, per_block, kind: str) -> list:
    """The sums, entry by entry, of the vectors that per_block makes of blocks of rows: a vector for each task, then one aggregation."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = per_block(b.column(0))
                total = part if total is None else total + part
        yield pa.RecordBatch.from_arrays([pa.array([] if total is None else [total], pa.list_(pa.int64() if kind == "long" else pa.float64()))], ["v"])
        release()

    parts = rows.mapInArrow(of_task, f"v array<{kind}>").select(F.posexplode("v").alias("at", "v"))
    return [r["v"] for r in parts.groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()]  # as many as entries


def fitted(distinct: DataFrame, dim: int, most: int = MOST) -> Fitted | None:
    """The fit to distinct vectors (x array<long>), read twice; None without any."""
    totals = _totals(distinct, lambda x: np.concatenate([[len(x)], _matrix(x, dim).sum(0)]), "long")
    if not totals:
        return None
    n, sums = int(totals[0]), np.array(totals[1:], np.int64)
    lengths, directions = plane_rotations(factor(distinct, n, sums))
    some = min(most, int((lengths > LEAST * lengths.max(initial=0.0)).sum()))
    variances = np.square(lengths) / n
    return Fitted(n, sums, directions[:some], variances[:some], float(variances.sum()))


def identity_error(distinct: DataFrame, dim: int, fit: Fitted) -> float:
    """The largest absolute entry of the covariance of the whitened vectors less the identity."""
    k = len(fit.variances)
    if not k:
        return 0.0

    def products(x: pa.Array) -> np.ndarray:
        w = fit.whitened(_matrix(x, dim))
        return (w.T @ w).ravel()

    return float(np.abs(np.array(_totals(distinct, products, "double")).reshape(k, k) / fit.n - np.eye(k)).max())


def whitened(vectors: DataFrame, vector_col: str = "embedding", most: int = MOST, mark: str = "__white") -> tuple[DataFrame, Fitted | None, float]:
    """The rows of vectors that have a vector, all columns, with a struct ``mark``: deviation and whitened, an entry for each component;
    the fit; and the identity error.

    The fit takes each distinct vector, as whole numbers, once: copies, however many, don't change it. Rows whose vector is null or
    holds null or non-finite entries go; so do vectors without entries and those whose length isn't the commonest (of equally
    common ones the greatest). Components without variance are left out: a single distinct vector gives none. Repeated rows are whitened each. Without
    any vector left the result is empty and there is no fit. A column of vectors named like the mark raises an error.
    """
    bounded_batches(vectors.sparkSession)
    x = free(vectors, f"{mark}_x")
    rows = vectors.withColumn(x, whole(F.col(vector_col))).filter(F.col(x).isNotNull())
    commonest = rows.groupBy(F.size(x).alias("d")).count().filter("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    empty = struct_type("deviation long, whitened array<double>")
    if commonest is None:
        return vectors.limit(0).withColumn(free(vectors, mark), F.lit(None).cast(empty)), None, 0.0
    dim = int(commonest["d"])
    rows = rows.filter(F.size(x) == dim)
    distinct = materialise(rows.select(F.col(x).alias("x")).distinct(), "vectors")
    fit = fitted(distinct, dim, most)
    error = identity_error(distinct, dim, fit)
    dropped(distinct)

    @F.arrow_udf(empty)
    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            m = _matrix(batch, dim)
            w = fit.whitened(m)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel(), pa.float64()))
            yield pa.StructArray.from_arrays([pa.array(fit.deviations(m), pa.int64()), lists], ["deviation", "whitened"])
        release()

    return rows.withColumn(free(vectors, mark), project(F.col(x))).select(*vectors.columns, mark), fit, error


def components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error), a row for each row that ``whitened`` keeps and each
    component, numbered from 1 by falling variance."""
    rows, fit, error = whitened(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), "vector", most)
    each = rows.select("id", "__white.deviation", F.posexplode("__white.whitened").alias("k", "value"))
    shares = F.array(*[F.lit(float(v / fit.trace)) for v in fit.variances]).cast("array<double>") if fit else F.array().cast("array<double>")
    out = {"component": (F.col("k") + 1).cast("int"), "n": F.lit(fit.n if fit else 0).cast("long"), "deviation": F.col("deviation"), "whitened": F.col("value"), "explained": F.get(shares, F.col("k")), "identity_error": F.lit(error)}
    return each.select(F.col("id").alias(id_col), *[c.alias(n) for n, c in out.items()])
