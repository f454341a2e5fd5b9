"""Embedding whitening: streaming moments, a symmetric QR eigen-solve, projections of unit variance.

Entries are put on a grid of 1/64 and moved by a million, as whole numbers x; a covariance of such numbers that is not
centred first loses all its digits.  Each partition streams Welford's rank-one updates of count, mean and scatter matrix,
partitions merge by the parallel update formula in a tree of tasks, and the driver gets one d x d matrix, whatever the number
of rows.  The eigenvectors are found there: Householder's tridiagonal form, then QR steps with implicit shifts.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID, MOVED = 64, 1_000_000
COMPONENTS = 32
#: Entries from this size on can't be told apart on the grid as doubles; their vectors are dropped like non-finite ones.
LARGEST = 2.0**40
#: Eigenvalues below this share of the largest are rounding: such directions have no variance to be scaled.
LEAST_SHARE = 1e-11
#: States that one task merges.
FAN_IN = 16
_STATE = "state binary"


@dataclass
class Moments:
    """Count, sums and scatter (the sum of outer products of deviations from the mean) of vectors.

    Sums are of differences from an origin, the first vector met: of whole numbers they are whole and exact, and means
    lose no digits to a large common part.
    """

    d: int
    n: int = 0
    origin: np.ndarray | None = None
    rest: np.ndarray | None = None
    scatter: np.ndarray | None = None

    def add(self, x: np.ndarray) -> None:
        """Welford's update for each row in turn.

        A row that differs by delta from the mean of the k rows before adds k / (k + 1) delta delta^T to the scatter.  The
        running sums of a batch are cumulated, so its deltas are at hand together, and their rank-one updates are added
        by one product of matrices.
        """
        if not len(x):
            return
        if self.origin is None:
            self.origin, self.rest, self.scatter = x[0].copy(), x[0].astype(object if x.dtype.kind == "i" else np.float64) * 0, np.zeros((self.d, self.d))
        y = x - self.origin
        before = np.arange(self.n, self.n + len(x), dtype=np.float64)[:, None]
        sums = np.cumsum(np.vstack([self.rest.astype(np.float64), y[:-1]]), axis=0)
        delta = y - sums / np.maximum(before, 1)
        self.scatter += delta.T @ (delta * (before / (before + 1)))
        self.rest = self.rest + y.sum(axis=0)
        self.n += len(x)

    def merge(self, other: Moments) -> None:
        """The parallel update: scatters add up, with the outer product of the means' difference."""
        if not other.n:
            return
        if not self.n:
            self.n, self.origin, self.rest, self.scatter = other.n, other.origin, other.rest, other.scatter
            return
        n, moved = self.n + other.n, other.origin - self.origin
        delta = moved + (other.rest / other.n).astype(np.float64) - (self.rest / self.n).astype(np.float64)
        self.scatter = self.scatter + other.scatter + np.outer(delta, delta) * (self.n * (other.n / n))
        self.rest, self.n = self.rest + other.rest + moved.astype(self.rest.dtype) * other.n, n

    def sums(self) -> np.ndarray:
        return self.rest + self.origin.astype(self.rest.dtype) * self.n


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    a, d = np.array(matrix, dtype=np.float64), len(matrix)
    a = (a + a.T) / 2
    q = np.eye(d)
    for k in range(d - 2):  # Householder reflections leave a tridiagonal matrix
        v = a[k + 1 :, k].copy()
        size = math.sqrt(v @ v)
        if not size or not np.any(v[1:]):
            continue
        v[0] += math.copysign(size, v[0])
        v /= math.sqrt(v @ v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    diagonal, off = np.diag(a).copy(), np.append(np.diag(a, 1), 0.0)
    rows = np.ascontiguousarray(q.T)  # row i is the i-th basis vector: rotations then touch contiguous memory
    high = d - 1
    while high > 0:
        small = np.abs(off[:high]) <= np.finfo(float).eps * (np.abs(diagonal[:high]) + np.abs(diagonal[1 : high + 1]))
        off[:high][small] = 0.0
        if not off[high - 1]:
            high -= 1
            continue
        low = high - 1
        while low > 0 and off[low - 1]:
            low -= 1
        # Wilkinson's shift: the eigenvalue of the last two rows that is nearer to the last entry.
        half = (diagonal[high - 1] - diagonal[high]) / 2
        e = off[high - 1]
        shift = diagonal[high] - e * e / (half + math.copysign(math.hypot(half, e), half))
        x, z = diagonal[low] - shift, off[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                off[k - 1] = r
            p, t, b = diagonal[k], diagonal[k + 1], off[k]
            diagonal[k] = c * c * p + 2 * c * s * b + s * s * t
            diagonal[k + 1] = s * s * p - 2 * c * s * b + c * c * t
            off[k] = (c * c - s * s) * b + c * s * (t - p)
            x = off[k]
            if k + 1 < high:
                z = s * off[k + 1]
                off[k + 1] *= c
            rows[k], rows[k + 1] = c * rows[k] + s * rows[k + 1], c * rows[k + 1] - s * rows[k]
    order = np.argsort(-diagonal, kind="stable")
    return diagonal[order], rows[order].T


@dataclass
class Whitening:
    """What turns vectors into components of unit variance: fitted on n vectors with these sums (exact)."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @classmethod
    def of(cls, moments: Moments, components: int) -> Whitening:
        covariance = moments.scatter / moments.n
        values, vectors = symmetric_qr(covariance)
        some = min(components, int((values > LEAST_SHARE * values[0]).sum())) if values[0] > 0 else 0
        return cls(moments.n, moments.sums(), values[:some], vectors[:, :some], float(np.trace(covariance)))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: longs, or Python's numbers where these might not hold it."""
        most = max(int(np.abs(x).max()) * self.n, *map(abs, self.sums.tolist())) if len(x) else 0
        return self.n * x - self.sums.astype(np.int64) if most < 1 << 62 else x.astype(object) * self.n - self.sums

    def squares(self, far: np.ndarray) -> list[Decimal]:
        if far.dtype == np.int64 and (not len(far) or far.shape[1] * int(np.abs(far).max()) ** 2 < 1 << 63):
            return [Decimal(v) for v in (far * far).sum(axis=1).tolist()]
        return [Decimal(sum(v * v for v in row)) for row in far.tolist()]

    def project(self, far: np.ndarray) -> np.ndarray:
        return (far / self.n).astype(np.float64) @ (self.vectors / np.sqrt(self.values))


def _whole(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The batch's vectors on the grid, as whole numbers."""
    c = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(GRID * c).astype(np.int64) + MOVED


def usable(column: str = "embedding") -> Column:
    """A vector without nulls and with finite entries (under LARGEST) only."""
    entries = F.col(column).cast("array<double>")
    return entries.isNotNull() & (F.size(entries) > 0) & F.coalesce(F.forall(entries, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LARGEST)), F.lit(False))


def merged(states: DataFrame, d: int) -> Moments:
    """All partitions' moments as one: tasks merge FAN_IN states at a time, until one is left for the driver."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Moments(d)
        for batch in batches:
            for state in batch.column("state").to_pylist():
                total.merge(pickle.loads(state))
        yield _state(total)

    left = states.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN_IN)
        states = states.repartition(left).mapInArrow(merge, _STATE)
    state = states.first()
    return pickle.loads(bytes(state["state"])) if state else Moments(d)


def _state(moments: Moments) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(moments)], pa.binary())], names=["state"])


def _vectors(rows: DataFrame, d: int) -> DataFrame:
    return rows.filter(usable() & (F.size("embedding") == d)).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors; None if there are none.

    The dimension is the most frequent length of usable vectors (of equally frequent ones the longest); vectors of other
    lengths are dropped.
    """
    longest = rows.filter(usable()).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if longest is None:
        return None
    d = longest["d"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments(d)
        for batch in batches:
            own.add(_whole(batch, d))
        yield _state(own)

    return Whitening.of(merged(_vectors(rows, d).mapInArrow(stream, _STATE), d), components)


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation (decimal, exact) and the array of whitened components of each usable vector."""
    d = len(model.sums)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = dict(rows.select("vec_id").dtypes)["vec_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            x = _whole(batch, d)
            far = of.deviations(x)
            white = of.project(far)
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1], white.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(of.squares(far), pa.decimal128(38, 0)), lists], names=["vec_id", "deviation", "whitened"])

    return _vectors(rows, d).mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, components: int) -> float:
    """The largest absolute entry of the whitened components' covariance less the identity, by the same streaming moments."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments(components)
        for batch in batches:
            own.add(batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, components))
        yield _state(own)

    total = merged(whitened.select("whitened").mapInArrow(stream, _STATE), components)
    return float(np.abs(total.scatter / total.n - np.eye(components)).max())


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Left out: vectors that are null or empty, hold nulls, non-finite entries or ones from LARGEST on, or have another
    length than most; directions without variance (with one vector, or equal vectors only, there is none, so no row).
    Repeated rows and null vec_ids count like others.  Of n vectors with deviations beyond a long the query fails rather
    than give a wrong one (``transform`` has them as decimals).  No usable vector, or an empty table: an empty result.
    Other columns are not read.
    """
    kind = dict(rows.select("vec_id").dtypes)["vec_id"]
    model = fit(rows, components)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    out = transform(rows, model)
    explained = F.array(*[F.lit(float(e) / model.trace) for e in model.values])
    error = identity_error(out, len(model.values))
    each = out.select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("_at", "whitened"))
    return each.select("vec_id", (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("_at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
