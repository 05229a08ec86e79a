"""Whitening of vectors: uncorrelated components of variance one, largest variance first.

Vectors are put on a grid of integers, so counts, sums and deviations are exact.  Tasks add up outer products of centred rows, Spark adds those of all tasks, and the
driver gets one matrix as wide as a vector.  It is factored by Cholesky with pivots; one-sided Jacobi rotates the columns of the factor until they are orthogonal, whose
squared lengths are the eigenvalues and whose directions the eigenvectors.  Rotating the factor itself keeps the small ones accurate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grid steps a unit; what every entry is moved by.
STEPS, SHIFT = 64, 1_000_000
COMPONENTS = 32
EPS = float(np.finfo(np.float64).eps)


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def on_grid(vector: Column) -> Column:
    """Entries as grid steps; those beyond 9e18 steps stand there, so that a sum with SHIFT still fits a long."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-9e18), F.least(F.lit(9e18), F.lit(float(STEPS)) * x.cast("double")))) + F.lit(SHIFT).cast("long"))


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(l, order): a[order][:, order] = l @ l.T, l lower triangular with falling diagonal, as many columns as the numeric rank of a."""
    a, d = a.copy(), len(a)
    order, left = np.arange(d), np.diag(a).copy()
    l, least = np.zeros((d, d)), d * EPS * max(left.max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(left[k:]))
        if left[p] <= least:
            return l[:, :k], order
        for x in (order, left, l):
            x[[k, p]] = x[[p, k]]
        a[[k, p]] = a[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        l[k, k] = np.sqrt(left[k])
        l[k + 1 :, k] = (a[k + 1 :, k] - l[k + 1 :, :k] @ l[k, :k]) / l[k, k]
        left[k + 1 :] -= l[k + 1 :, k] ** 2
    return l, order


def jacobi(l: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Columns of l rotated in pairs until all are orthogonal to working precision.  Each step of a sweep rotates disjoint pairs at once; a sweep meets every pair."""
    rows, r = np.ascontiguousarray(l.T), l.shape[1]
    ring = list(range(r + r % 2))
    half, steps = len(ring) // 2, []
    for _ in range(len(ring) - 1):
        pairs = [(p, q) for p, q in zip(ring[:half], ring[: half - 1 : -1]) if max(p, q) < r]
        steps.append(tuple(np.array(x) for x in zip(*pairs)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    for _ in range(sweeps):
        still = True
        for p, q in steps:
            x, y = rows[p], rows[q]
            xx, yy, xy = (np.einsum("ij,ij->i", *z) for z in ((x, x), (y, y), (x, y)))
            turn = np.abs(xy) > EPS * np.sqrt(xx) * np.sqrt(yy) * max(len(l), 8) / 8
            if not turn.any():
                continue
            still = False
            p, q, x, y = p[turn], q[turn], x[turn], y[turn]
            zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            c = (1 / np.sqrt(1 + t * t))[:, None]
            t = t[:, None]
            rows[p], rows[q] = c * (x - t * y), c * (t * x + y)
        if still:
            break
    return rows.T


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the positive eigenvalues of a symmetric matrix without negative ones, falling, and unit eigenvectors as columns, largest entry positive."""
    if not len(a):
        return np.empty(0), np.empty((0, 0))
    l, order = pivoted_cholesky(a)
    if not l.shape[1]:
        return np.empty(0), np.empty((len(a), 0))
    turned = jacobi(l) if l.shape[1] > 1 else l
    norms = np.sqrt((turned * turned).sum(axis=0))
    by = np.argsort(-norms, kind="stable")
    vectors = np.empty_like(turned)
    vectors[order] = turned[:, by] / norms[by]
    return norms[by] ** 2, vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(by))] < 0, -1.0, 1.0)


@dataclass
class Whitening:
    """n rows of one width, their exact sums, the trace of their covariance, its first eigenvalues and eigenvectors (columns)."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """x - sums / n, rounded once; the exact sum of (n x - sums)^2 of each row, None where it does not fit a long."""
    if float(np.abs(x).max(initial=0)) * n < 2.0**62:
        k = n * x - np.array(sums, dtype=np.int64)
        if float(np.abs(k).max(initial=0)) ** 2 * max(x.shape[1], 1) < 2.0**62:
            return k / n, (k * k).sum(axis=1).tolist()
    k = n * x.astype(object) - np.array(sums, dtype=object)
    exact = [sum(v * v for v in row) for row in k.tolist()]
    return (k / n).astype(np.float64), [v if v < 2**63 else None for v in exact]


def _summed(grid: DataFrame, add, width: int) -> np.ndarray:
    """The sum over all rows of a matrix: add(batch matrix) gives that of some rows; tasks add up their own, Spark those of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = add(_matrix(batch.column(0), width))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.nonzero(np.ones_like(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64)), pa.array(total.ravel())], names=["i", "j", "v"])

    rows = grid.select("x").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # as many as the matrix has entries
    out = np.zeros((max((r.i for r in rows), default=-1) + 1, max((r.j for r in rows), default=-1) + 1))
    for r in rows:
        out[r.i, r.j] = r.v
    return out


def _grid(vectors: DataFrame, vector: str, width: int | None = None) -> DataFrame:
    rows = vectors.where(finite(F.col(vector)))
    return (rows if width is None else rows.where(F.size(vector) == width)).select(on_grid(F.col(vector)).alias("x"))


def fit(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> Whitening:
    """The whitening of all rows.  Rows whose vector is null or has null or infinite entries or NaN take no part; of several widths the commonest one does, the larger on a tie.

    Components of no variance, to double precision, are none: a table of one row, or of equal rows, has no components, as has an empty one.
    """
    widths = _grid(vectors, vector).groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    top = widths.orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return Whitening(0, [], 0.0, np.empty(0), np.empty((0, 0)))
    n, d = top.n, top.d
    grid = _grid(vectors, vector, d)
    per_dim = grid.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"))
    sums = [0] * d
    for r in per_dim.collect():  # as many as a vector has entries
        sums[r.i] = int(r.s)

    def outer(x: np.ndarray) -> np.ndarray:
        c = _centred(x, n, sums)[0]
        return c.T @ c

    cov = _summed(grid, outer, d) / n if d else np.empty((0, 0))
    cov = (cov + cov.T) / 2
    values, axes = eigen(cov)
    return Whitening(n, sums, float(np.trace(cov)), values[:components], axes[:, :components])


def transform(vectors: DataFrame, w: Whitening, vector: str = "embedding") -> DataFrame:
    """The rows that take part, with whitened (array of doubles, by component) and deviation (exact sum of (n x - S)^2, null where that does not fit a long)."""
    n, sums, scaled, d = w.n, w.sums, w.vectors / np.sqrt(w.values), len(w.sums)

    @F.arrow_udf("struct<deviation long, whitened array<double>>")
    def whiten(x: pa.Array) -> pa.Array:
        c, deviation = _centred(_matrix(x, d), n, sums)
        y = c @ scaled
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
        return pa.StructArray.from_arrays([pa.array(deviation, pa.int64()), lists], names=["deviation", "whitened"])

    rows = vectors.where(finite(F.col(vector))).where(F.size(vector) == d)
    return rows.withColumn("_white", whiten(on_grid(F.col(vector)))).select(*[c for c in vectors.columns if c not in ("deviation", "whitened")], "_white.deviation", "_white.whitened")


def identity_error(vectors: DataFrame, w: Whitening, vector: str = "embedding") -> float:
    """The largest entry, in absolute value, of the covariance of the whitened rows minus the identity; 0 without components.

    Rows are centred, so the mean of what they are projected to is zero but for rounding; it is subtracted all the same.
    """
    k, n, sums, scaled = len(w.values), w.n, w.sums, w.vectors / np.sqrt(w.values)
    if not k:
        return 0.0

    def outer(x: np.ndarray) -> np.ndarray:
        y = _centred(x, n, sums)[0] @ scaled
        return np.vstack([y.T @ y, y.sum(axis=0)])

    total = _summed(_grid(vectors, vector, len(sums)), outer, len(sums)) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
