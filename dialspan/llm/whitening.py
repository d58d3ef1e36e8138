"""Whitening of embeddings by an incremental eigendecomposition.

Every entry c becomes the whole number floor(1024 * c) + 100000. Each task carries the
spectrum of what it has read: how many vectors, their mean, and the eigenvalues and vectors of
their scatter. A vector is a centred rank-one update: the new scatter is diagonal in the carried
basis but for one outer product, so its eigenvalues are the roots of a secular equation
between the old ones. Components of the update that are nearly zero, and equal
eigenvalues (turned against each other), are deflated: they stay as they are. Equal vectors of
a batch are one update with their number. The spectra of tasks are combined by successive
rank-one updates, too: the difference of the means and each eigenvector of the other one,
in levels of ``FAN`` spectra, so that neither a task nor the driver ever holds all of them.

The basis found is as good as many roundings leave it. The last step is one of Rayleigh and Ritz:
the covariance is summed once more over all rows, in the basis and centred by exact means (sums of
whole numbers), and its small matrix diagonalised; the components are then right to
double precision. What is gathered on the driver is a matrix of the vectors' length.

Dropped: null vectors, and vectors that hold null or non-finite entries. Vectors of another length than
most have (of lengths equally frequent the greater) can't be in one covariance and are dropped,
too, and so are empty ones and those with an entry of 2^40 or more, whose whole number isn't exact. Rows with one vec_id, or none, and equal vectors stay rows of their
own. Components without variance (a hundred thousand millionths of the first one's) can't
be scaled to one and are left out; a single row or equal rows have none. An empty table gives an empty
one. ``deviation`` is null where it is beyond 64 bits. Further columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

COMPONENTS = 8
#: Entries below it are exact as whole numbers.
MOST = float(1 << 40)
#: Spectra that one task combines.
FAN = 16
EPS = np.finfo(float).eps
#: The least share of the first eigenvalue that a component needs.
LEAST = 1e-10


def secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors of diag(d) + z z'; d ascends strictly and no z is zero.

    Each root lies between two neighbouring d, the last one within the length of z beyond the last d.
    It is found as its distance from the nearer of the two, by steps of a model with both poles
    inside a bracket, all roots at once. z is then made anew from the roots, so that the
    vectors are orthogonal however near two roots are.
    """
    n, zz = len(d), z * z
    own = np.eye(n, dtype=bool)
    gap = np.append(np.diff(d), zz.sum())
    next_is_nearer = 1 + (zz / (d - (d + gap / 2)[:, None])).sum(axis=1) < 0
    next_is_nearer[-1] = False
    origin = np.where(next_is_nearer, np.append(d[1:], d[-1]), d)
    pole = d - origin[:, None]  # [root, pole]
    low = np.where(next_is_nearer, -gap / 2, 0.0)
    high = np.where(next_is_nearer, 0.0, np.append(gap[:-1] / 2, gap[-1]))
    x, below = (low + high) / 2, np.tri(n, dtype=bool)
    done = np.zeros(n, bool)
    for _ in range(100):
        away = pole - x[:, None]
        term = zz / away
        slope = term / away
        psi, phi = np.where(below, term, 0).sum(axis=1), np.where(below, 0, term).sum(axis=1)
        f = 1 + psi + phi
        done |= np.abs(f) <= 8 * n * EPS * (1 - psi + phi)
        done |= high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))
        if done.all():
            break
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        left, right = np.where(below, slope, 0).sum(axis=1), np.where(below, 0, slope).sum(axis=1)
        p = np.diagonal(away)
        step = np.empty(n)
        with np.errstate(all="ignore"):  # what isn't a number is outside of the bracket
            q = np.diagonal(away, 1)
            f0, p0, l0, r0 = f[:-1], p[:-1], left[:-1], right[:-1]
            c, b, e = f0 - p0 * l0 - q * r0, (p0 + q) * f0 - p0 * q * (l0 + r0), p0 * q * f0
            root = np.sqrt(np.maximum(b * b - 4 * c * e, 0))
            step[:-1] = np.where(b > 0, 2 * e / (b + root), (b - root) / (2 * c))
            step[-1] = p[-1] * f[-1] / (f[-1] - p[-1] * left[-1])
            new = x + step
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
        x = np.where(done, x, new)
    away = pole - x[:, None]
    made = np.where(own, -away, -away / np.where(own, 1, d[:, None] - d))
    z = np.copysign(np.sqrt(np.abs(made.prod(axis=0))), z)
    vectors = z / away
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    return origin + x, vectors.T


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of basis diag(values) basis' + v v'; values ascend before and after."""
    z, d = basis.T @ v, values.copy()
    length = np.linalg.norm(z)
    tiny = 8 * EPS * max(float(d[-1]), float(length) ** 2)
    kept = np.flatnonzero(np.abs(z) * length > tiny)
    if not len(kept):
        return values, basis
    basis = basis.copy()
    for k in np.flatnonzero(np.diff(d[kept]) <= tiny).tolist():  # equal: turned, so that the update is in the second alone
        a, b = kept[k], kept[k + 1]
        r = np.hypot(z[a], z[b])
        s, c = z[a] / r, z[b] / r
        basis[:, [a, b]] = basis[:, [a, b]] @ np.array([[c, s], [-s, c]])
        z[a], z[b] = 0.0, r
    kept = kept[z[kept] != 0]
    found, turn = secular(d[kept], z[kept])
    d[kept] = found
    basis[:, kept] = basis[:, kept] @ turn
    order = np.argsort(d, kind="stable")
    return d[order], basis[:, order]


class Spectrum:
    """How many vectors, their mean, and the scatter about it as eigenvalues and vectors."""

    def __init__(self, n: int, mean: np.ndarray, values: np.ndarray, basis: np.ndarray):
        self.n, self.mean, self.values, self.basis = n, mean, values, basis

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def add(self, x: np.ndarray, times: int) -> None:
        """``times`` equal vectors: a centred rank-one update."""
        off, n = x - self.mean, self.n + times
        if self.n and off.any():
            self.values, self.basis = rank_one(self.values, self.basis, off * np.sqrt(self.n * times / n))
        self.mean, self.n = self.mean + off * (times / n), n

    def combine(self, other: Spectrum) -> None:
        """The other spectrum as rank-one updates: its centre, then each of its vectors."""
        if other.n:
            self.add(other.mean, other.n)
            for value, vector in zip(other.values, other.basis.T, strict=True):
                if value > 0:
                    self.values, self.basis = rank_one(self.values, self.basis, vector * np.sqrt(value))

    def row(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.values, self.basis.ravel()]).astype("<f8").tobytes()

    @classmethod
    def read(cls, raw: bytes, dims: int) -> Spectrum:
        x = np.frombuffer(raw, "<f8")
        return cls(int(x[0]), x[1 : 1 + dims].copy(), x[1 + dims : 1 + 2 * dims].copy(), x[1 + 2 * dims :].reshape(dims, dims).copy())


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and x (whole numbers) of the rows that count, all of one length."""
    vectors = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & ((F.abs(c) < MOST)))
    vectors = vectors.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
    x = vectors.select("vec_id", F.transform("v", lambda c: F.floor(c * 1024) + 100000).cast("array<long>").alias("x"))
    lengths = x.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1)
    usual = lengths.first()
    return x.where(F.size("x") == (usual.dims if usual else 0))


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def incremental(x: DataFrame, dims: int) -> Spectrum:
    """The spectrum of all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(dims)
        for batch in batches:
            vectors, times = np.unique(matrix(batch, dims), axis=0, return_counts=True)
            for v, n in zip(vectors, times.tolist(), strict=True):
                own.add(v.astype(float), n)
        if own.n:
            yield pa.RecordBatch.from_arrays([pa.array([own.row()], pa.binary())], names=["spectrum"])

    def together(table: pa.Table) -> pa.Table:
        rows = sorted(table["spectrum"].to_pylist())
        own = Spectrum.read(rows[0], dims)
        for raw in rows[1:]:
            own.combine(Spectrum.read(raw, dims))
        return pa.table({"spectrum": pa.array([own.row()], pa.binary())})

    found = cut(x.select("x").mapInArrow(run, "spectrum binary"))
    while (many := found.count()) > 1:
        found = cut(found.groupBy(F.pmod(F.xxhash64("spectrum"), F.lit(-(-many // FAN))).alias("bucket")).applyInArrow(together, "spectrum binary"))
    return Spectrum.read(found.first().spectrum, dims)


def summed(x: DataFrame, dims: int, products, size: int) -> np.ndarray:  # noqa: ANN001
    """The sum over all batches of ``products`` (a square matrix of ``size``): summed by task, then by row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            total += products(matrix(batch, dims))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(total))], names=["i", "row"])

    each = x.select("x").mapInArrow(run, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "value"))
    out = np.zeros((size, size))
    got = each.groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()  # a row an entry
    out[got["i"].to_numpy(), got["j"].to_numpy()] = got["value"].to_numpy()
    return out


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row that counts and each component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = cut(whole_vectors(rows))
    first = x.limit(1).collect()
    if not first:
        return rows.sparkSession.createDataFrame([], schema)
    dims = len(first[0].x)
    sums = x.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    n, s = sums[0].n, [0] * dims
    for r in sums:  # a row a dimension
        s[r["at"]] = int(r.s)
    mean, rest = np.array([v // n for v in s], np.int64), np.array([v % n for v in s], np.int64)

    def centred(v: np.ndarray) -> np.ndarray:
        """x - S/n, rounded once: the difference of whole numbers is exact."""
        return (v - mean) - rest / n

    basis, _ = np.linalg.qr(incremental(x, dims).basis)

    def in_basis(v: np.ndarray) -> np.ndarray:
        y = centred(v) @ basis
        return y.T @ y

    cov = summed(x, dims, in_basis, dims) / n
    values, turn = np.linalg.eigh((cov + cov.T) / 2)
    values, axes = values[::-1], (basis @ turn)[:, ::-1]
    kept = np.flatnonzero(values[:components] > LEAST * max(values[0], 0))
    trace = float(np.trace(cov))
    scale = axes[:, kept] / np.sqrt(values[kept])

    def squares(v: np.ndarray) -> np.ndarray:
        y = np.concatenate([centred(v) @ scale, np.ones((len(v), 1))], axis=1)
        return y.T @ y

    error = None
    if len(kept):
        moment = summed(x, dims, squares, len(kept) + 1) / n
        middle = moment[-1, :-1]
        error = float(np.abs(moment[:-1, :-1] - np.outer(middle, middle) - np.eye(len(kept))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch, dims)
            off = v - mean
            most = int(np.abs(off).max(initial=0)) + 1
            if (n * most) ** 2 * dims < 1 << 63:
                deviation = pa.array(((n * off - rest) ** 2).sum(axis=1))
            else:  # beyond 64-bit steps, in whole numbers of any length
                deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, rest, strict=True)) for row in off]
                deviation = pa.array([d if d < 1 << 63 else None for d in deviation], pa.int64())
            k = len(kept)
            again = pa.array(np.repeat(np.arange(len(v)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(again),
                    pa.array(np.tile(kept + 1, len(v)), pa.int32()),
                    pa.array(np.full(len(v) * k, n), pa.int64()),
                    deviation.take(again),
                    pa.array((centred(v) @ scale).ravel()),
                    pa.array(np.tile(values[kept] / trace, len(v)), pa.float64()),
                    pa.array(np.full(len(v) * k, error or 0.0)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(run, schema)
