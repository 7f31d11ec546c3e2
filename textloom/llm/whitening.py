"""Embedding whitening: Welford's updates in the tasks, merged by the parallel formula, then a symmetric QR eigen-solve.

A task goes through its vectors once.  Each vector x makes a rank-one update of the centred products,
M += (x - mean before)(x - mean after)', which is ((i - 1) / i) d d' with d = x - mean before; the updates of a block
are added as one matrix product of their d.  Moments of tasks are merged pairwise in a tree of Spark stages, so the
driver gets a few matrices whatever the number of tasks.  Sums and counts are exact integers throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize

COMPONENTS, SCALE, OFFSET = 32, 64, 1_000_000
#: Integers beyond this are an error: what is made of them would leave 64 bits.
LARGEST = 1 << 40
#: Moments that are merged in one task, and that the driver takes at most.
FAN = 32
#: Components of a variance under this share of the largest are no directions of the data.
RANK = 1e-12
BLOCK = 4096


@dataclass
class Moments:
    """Number, exact sums (of integers; else zeros), mean and centred products of some vectors."""

    n: int
    sums: list
    mean: np.ndarray
    products: np.ndarray

    @staticmethod
    def none(d: int) -> Moments:
        return Moments(0, [0] * d, np.zeros(d), np.zeros((d, d)))

    def add(self, x: np.ndarray) -> None:
        """Welford's rank-one updates by the rows of ``x``, in order."""
        m = len(x)
        if not m:
            return
        i = self.n + np.arange(1, m + 1, dtype=np.float64)
        through = np.cumsum(x - self.mean, axis=0) / i[:, None]  # of the means after each row, the distance from the mean before the block
        before = np.concatenate([np.zeros((1, x.shape[1])), through[:-1]])
        d = (x - self.mean) - before
        self.products += (d * ((i - 1) / i)[:, None]).T @ d
        self.mean = self.mean + through[-1]
        if x.dtype.kind == "i":
            self.sums = [a + b for a, b in zip(self.sums, x.sum(0).tolist())]
        self.n += m

    def merge(self, other: Moments) -> Moments:
        """The moments of both parts together, by the parallel update formula."""
        if not self.n or not other.n:
            return self if self.n else other
        n, apart = self.n + other.n, other.mean - self.mean
        products = self.products + other.products + np.outer(apart, apart) * (self.n * (other.n / n))
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums)], self.mean + apart * (other.n / n), products)


_MOMENTS = "n long, sums array<decimal(38,0)>, mean array<double>, products array<double>"
_KIND = pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("mean", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))])


def _row(m: Moments) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m.n], pa.int64()), pa.array([[int(s) for s in m.sums]], _KIND.field(1).type), pa.array([m.mean]), pa.array([m.products.ravel()])], schema=_KIND)


def _of_rows(rows: Iterable) -> Iterator[Moments]:
    for r in rows:
        mean = np.array(r["mean"], np.float64)
        yield Moments(int(r["n"]), [int(s) for s in r["sums"]], mean, np.array(r["products"], np.float64).reshape(len(mean), -1))


def _blocks(batches, column: int):
    for whole in batches:
        for batch in (whole.slice(i, BLOCK) for i in range(0, whole.num_rows, BLOCK)):
            if batch.num_rows:
                yield batch, batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _gather(batches, project: Projection | None = None):
    total = None
    for _, x in _blocks(batches, 0):
        values = x if project is None else project(x)
        total = total or Moments.none(values.shape[1])
        total.add(values)
    if total:
        yield _row(total)


def _merge_batches(batches):
    total = None
    for batch in batches:
        for m in _of_rows(batch.to_pylist()):
            total = m if total is None else total.merge(m)
    if total:
        yield _row(total)


def moments(vectors: DataFrame, project: Projection | None = None) -> Moments | None:
    """The moments of ``vectors(x)`` or of their projections; None without rows.

    Tasks give a row each; while there are more than ``FAN``, stages of a ``FAN``-th of as many tasks merge them.
    """
    parts = materialize(vectors.select("x").mapInArrow(partial(_gather, project=project), _MOMENTS), "moments")
    n = parts.count()
    while n > FAN:
        n = -(-n // FAN)
        merged = materialize(parts.repartition(n).mapInArrow(_merge_batches, _MOMENTS), "moments")
        discard(parts)
        parts = merged
    total = None
    for m in _of_rows(parts.orderBy("n", "mean").collect()):  # at most FAN rows
        total = m if total is None else total.merge(m)
    discard(parts)
    return total


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, beside it, Q) with Q' A Q tridiagonal, by Householder reflections of a symmetric matrix."""
    a, d = a.copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0:
            continue
        v[0] += math.copysign(norm, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, vectors as columns) of a symmetric matrix, falling, by implicit QR steps with Wilkinson's shift."""
    diagonal, beside, q = tridiagonal(np.asarray(a, np.float64))
    d, rows = len(diagonal), q.T.copy()  # a rotation of two columns of Q is one of two rows here
    high = d - 1
    while high > 0:
        small = np.abs(beside[:high]) <= np.finfo(float).eps * (np.abs(diagonal[:high]) + np.abs(diagonal[1 : high + 1]))
        beside[:high][small] = 0
        if beside[high - 1] == 0:
            high -= 1
            continue
        zero = np.flatnonzero(beside[:high] == 0)
        low = int(zero[-1]) + 1 if len(zero) else 0
        half = (diagonal[high - 1] - diagonal[high]) / 2
        last = beside[high - 1]
        shift = diagonal[high] - last * last / (half + math.copysign(math.hypot(half, last), half))
        x, z = diagonal[low] - shift, beside[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                beside[k - 1] = r
            p, o, w = diagonal[k], beside[k], diagonal[k + 1]
            diagonal[k], diagonal[k + 1] = c * c * p + 2 * c * s * o + s * s * w, s * s * p - 2 * c * s * o + c * c * w
            beside[k] = c * s * (w - p) + (c * c - s * s) * o
            if k < high - 1:
                x, z = beside[k], s * beside[k + 1]
                beside[k + 1] *= c
            rows[k : k + 2] = np.array([[c, s], [-s, c]]) @ rows[k : k + 2]
    order = np.argsort(-diagonal, kind="stable")
    return diagonal[order], rows[order].T


@dataclass(frozen=True)
class Projection:
    """What whitening needs in a task: a call gives whitened rows of integer vectors."""

    n: int
    sums: tuple[int, ...]
    matrix: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums])
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return ((x - whole) - rest) @ self.matrix

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """The exact sum over dimensions of (n x - S)^2; an error if it does not fit 64 bits."""
        origin = [s // self.n for s in self.sums]
        near, rest = x - np.array(origin), [s % self.n for s in self.sums]
        widest = (int(np.abs(near).max(initial=0)) + 1) * self.n
        if widest * widest * len(origin) < 1 << 62:
            apart = near * self.n - np.array(rest)
            return (apart * apart).sum(1)
        return np.array([sum((int(v) * self.n - r) ** 2 for v, r in zip(row, rest)) for row in near], dtype=np.int64)


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): x = floor(64 c) + 1000000 of each entry c; rows with a null vector, or a null or non-finite entry, are left out.

    So are empty vectors, and those of another length than most have (of equally frequent lengths the longer counts).
    An entry of 2^34 and more is an error.
    """
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))) & (F.size(v) > 0)
    value = lambda c: F.when(F.abs(c * SCALE) < LARGEST, F.floor(c * SCALE) + OFFSET).otherwise(F.raise_error(F.lit("a vector's entry is too large to be whitened")))
    rows = vectors.where(F.coalesce(whole, F.lit(False)))
    length = rows.groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    own = rows.where(F.size(vector_col) == (length["d"] if length else 0))
    return own.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, value).alias("x"))


def fit(points: DataFrame, most: int = COMPONENTS) -> tuple[Projection, list[float]] | None:
    """(projection, share of the variance of each component) of ``points(x)``; None without rows.

    At most ``most`` components, and none of a variance that is rounding.
    """
    total = moments(points)
    if total is None:
        return None
    covariance = total.products / total.n
    values, vectors = symmetric_qr((covariance + covariance.T) / 2)
    trace = float(np.trace(covariance))
    r = min(most, int((values > RANK * values[0]).sum())) if len(values) and values[0] > 0 else 0
    return Projection(total.n, tuple(total.sums), vectors[:, :r] / np.sqrt(values[:r])), [float(v) / trace for v in values[:r]]


def identity_error(points: DataFrame, project: Projection) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, in a further pass."""
    total = moments(points, project)
    r = project.matrix.shape[1]
    return float(np.abs(total.products / total.n - np.eye(r)).max(initial=0.0))


def _report_batches(batches, project: Projection):
    for batch, x in _blocks(batches, 1):
        white = project(x)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1]), pa.array(white.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(project.deviations(x)), lists], ["vec_id", "deviation", "white"])


def whitening_report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each kept vector and component.

    Rows with a null vector or a null or non-finite entry are left out; repeated rows and null ids are rows of their
    own.  Components of no variance have no rows, so vectors that are all equal, or a single one, give none; an empty
    table stays empty.  Other columns are ignored.
    """
    points = integer_vectors(vectors, id_col, vector_col)
    fitted = fit(points, most)
    if fitted is None or not fitted[1]:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    project, shares = fitted
    error = identity_error(points, project)
    rows = points.mapInArrow(partial(_report_batches, project=project), "vec_id long, deviation long, white array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(project.n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*map(F.lit, shares))[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
