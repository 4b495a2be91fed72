"""Whitening of embeddings by incremental eigendecomposition.

The fit list is each distinct integer vector once. Every partition of it keeps a mean and the eigenpairs of its scatter
matrix, and takes vectors in by centred rank-one updates: the update of diag(d) by z z' is solved through its secular
equation, after entries with a tiny z and clusters of equal d are deflated, with eigenvectors from z recomputed to fit
the roots (so they stay orthogonal). A batch of more vectors than dimensions is first reduced by an orthogonal
factorisation to as many rank-one terms as there are dimensions, with the same scatter. Spectra of partitions are
combined, FAN at a time in rounds of Spark jobs, by the rank-one terms of one taken into the other and one term for the
shift of the means. A last distributed pass projects the centred vectors on the basis found (Rayleigh-Ritz): its small
matrix gives the components to double precision; one more measures the covariance of what is whitened.

Every partition holds one dims x dims matrix; the driver gets one such matrix and the sums, whatever the rows.

Defined cases: rows with a null vector or a null, NaN or infinite entry are left out; short vectors count as filled with
zeros; an entry beyond a long stops at its ends; a null vec_id is a row like any other; repeated rows each have their
results and count once in the fit; a component without variance (also with fewer than two distinct vectors) has
whitened and explained 0 and is left out of identity_error; vectors without any entry have no components, so no rows;
deviation is null where it does not fit a long; with no rows left there are no results. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .vectors import matrix, whole, width

FAN = 8
TOP = 4
FLAT = 1e-12  # of the trace: a component with less variance has none
EPS = np.finfo(float).eps


def roots(d: np.ndarray, z2: np.ndarray) -> np.ndarray:
    """gaps[i, j] = d[i] - root j of the secular equation 1 + sum(z2 / (d - x)) = 0, for ascending unlike d and z2 > 0. Each root
    is found as an offset from the pole nearer to it, by rational steps between its two poles, within a bracket."""
    k, total = len(d), z2.sum()
    last = np.arange(k) == k - 1
    upper = np.append(d[1:], d[-1] + total)
    half = (upper - d) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = 1 + (z2[:, None] / (d[:, None] - (d + half))).sum(0) >= 0
        near = np.where(left | last, d, upper)
        gap = d[:, None] - near
        low = np.where(left | last, np.where(left, 0.0, half), -half)
        high = np.where(left, half, np.where(last, total, 0.0))
        a, b = d - near, np.where(last, np.inf, upper - near)
        below = np.tri(k, dtype=bool).T  # poles up to j
        x = (low + high) / 2
        for _ in range(80):
            at = gap - x
            w = z2[:, None] / at
            f = 1 + w.sum(0)
            done = np.abs(f) <= 4 * EPS * (1 + np.abs(w).sum(0))
            if done.all():
                break
            low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
            slope = w / at
            psi, dpsi = np.where(below, w, 0).sum(0), np.where(below, slope, 0).sum(0)
            phi, dphi = f - 1 - psi, slope.sum(0) - dpsi
            s, t = (a - x) ** 2 * dpsi, np.where(last, 0.0, (b - x) ** 2 * dphi)
            c = 1 + psi - (a - x) * dpsi + np.where(last, 0.0, phi - (b - x) * dphi)
            # c (a - y)(b - y) + s (b - y) + t (a - y) = 0, or c (a - y) + s = 0 for the last root
            q1, q0 = c * (a + b) + s + t, c * a * b + s * b + t * a
            disc = np.sqrt(np.maximum(q1 * q1 - 4 * c * q0, 0))
            one = np.where(q1 >= 0, 2 * q0 / (q1 + disc), (q1 - disc) / (2 * c))
            two = np.where(q1 >= 0, (q1 + disc) / (2 * c), 2 * q0 / (q1 - disc))
            y = np.where((one > low) & (one < high), one, two)
            y = np.where(last, a + s / c, y)
            y = np.where((y > low) & (y < high), y, (low + high) / 2)
            y = np.where(done, x, y)
            if (np.abs(y - x) <= EPS * np.abs(x)).all():
                break
            x = y
    return gap - x


def raised(d: np.ndarray, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors of q diag(d) q' + v v'."""
    z = q.T @ v
    size = float(z @ z)
    if size == 0.0:
        return d, q
    tiny = 8 * EPS * max(abs(d[-1]), abs(d[0]), size)
    cuts = np.flatnonzero(np.diff(d) > tiny) + 1
    if len(cuts) < len(d) - 1:  # a cluster of equal d: a reflection leaves one z of it
        q = q.copy()
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(d))):
            if hi - lo > 1:
                u = z[lo:hi].copy()
                norm = math.sqrt(u @ u)
                if norm == 0.0:
                    continue
                u[-1] += math.copysign(norm, u[-1])
                q[:, lo:hi] -= np.outer(q[:, lo:hi] @ u, u * (2 / (u @ u)))
                z[lo:hi] = 0.0
                z[hi - 1] = -math.copysign(norm, u[-1])
    on = np.flatnonzero(np.abs(z) * math.sqrt(size) > tiny)
    if not len(on):
        return d, q
    gaps = roots(d[on], z[on] ** 2)
    new = d[on] - np.diagonal(gaps)
    # z that fits the roots exactly, so the eigenvectors are orthogonal
    apart = d[on][:, None] - d[on]
    np.fill_diagonal(apart, 1.0)
    ratio = gaps / apart
    fit = np.sqrt(np.abs(np.prod(np.abs(ratio), axis=1))) * np.sign(z[on])
    u = fit[:, None] / gaps
    u /= np.sqrt((u * u).sum(0))
    out, vectors = d.copy(), q.copy()
    out[on], vectors[:, on] = new, q[:, on] @ u
    order = np.argsort(out, kind="stable")
    return out[order], vectors[:, order]


class Spectrum:
    """n vectors taken in: their mean, and eigenvalues and vectors of their scatter about it."""

    def __init__(self, dims: int):
        self.n, self.mean, self.d, self.q = 0, np.zeros(dims), np.zeros(dims), np.eye(dims)

    def shift(self, n: int, mean: np.ndarray) -> None:
        """The rank-one term for n more vectors about another mean; the mean moves."""
        gap, both = mean - self.mean, self.n + n
        if self.n and n:
            self.d, self.q = raised(self.d, self.q, gap * math.sqrt(self.n * n / both))
        self.mean = self.mean + gap * (n / both)
        self.n = both

    def take(self, x: np.ndarray) -> None:
        """Rows of x, by rank-one updates: one a row, or one a dimension where there are more rows."""
        if not len(x):
            return
        mean = x.mean(0)
        c = x - mean
        for v in np.linalg.qr(c, "r") if len(c) > c.shape[1] else c:
            self.d, self.q = raised(self.d, self.q, v)
        self.shift(len(x), mean)

    def join(self, other: Spectrum) -> None:
        for e, v in zip(other.d, other.q.T):
            if e > 0:
                self.d, self.q = raised(self.d, self.q, v * math.sqrt(e))
        self.shift(other.n, other.mean)

    def row(self, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "n": pa.array([self.n], pa.int64()), **{k: pa.array([a.tobytes()], pa.binary()) for k, a in (("mean", self.mean), ("d", self.d), ("q", self.q))}})

    @classmethod
    def of(cls, dims: int, n: int, mean: bytes, d: bytes, q: bytes) -> Spectrum:
        out = cls(dims)
        out.n, out.mean, out.d, out.q = n, np.frombuffer(mean), np.frombuffer(d), np.frombuffer(q).reshape(dims, dims)
        return out


SPECTRUM = "part long, n long, mean binary, d binary, q binary"


def spectrum(fit: DataFrame, dims: int, batch: int = 1 << 16) -> Spectrum:
    """The spectrum of all vectors (column x, arrays of longs); batch: vectors taken in at once (1: one by one)."""

    def own(batches):
        from pyspark import TaskContext

        s = Spectrum(dims)
        for b in batches:
            x = longs(b.column(0), dims).astype(float)
            for i in range(0, len(x), batch):
                s.take(x[i : i + batch])
        if s.n:
            yield s.row(TaskContext.get().partitionId())

    def merged(t: pa.Table) -> pa.Table:
        t = t.sort_by("part").to_pylist()
        s = Spectrum(dims)
        for r in t:
            s.join(Spectrum.of(dims, r["n"], r["mean"], r["d"], r["q"]))
        return pa.Table.from_batches([s.row(t[0]["to"])])

    parts = written(fit.select("x").mapInArrow(own, SPECTRUM), "spectra")
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        parts = written(parts.withColumn("to", F.floor(F.col("part") / FAN)).groupBy("to").applyInArrow(merged, SPECTRUM), "spectra")
    r = parts.first()
    return Spectrum.of(dims, r["n"], r["mean"], r["d"], r["q"]) if r else Spectrum(dims)


def longs(column, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def summed(fit: DataFrame, term, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all tasks of term(x), an array of doubles or of longs of one shape. Tasks' arrays are added in Spark, FAN x FAN
    at a time, before one comes to the driver."""
    def own(batches):
        from pyspark import TaskContext

        total = None
        for b in batches:
            part = term(b.column(0))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "kind": [total.dtype.str], "a": pa.array([total.tobytes()], pa.binary())})

    def merged(t: pa.Table) -> pa.Table:
        rows = t.sort_by("part").to_pylist()
        total = sum(np.frombuffer(r["a"], r["kind"]) for r in rows)
        return pa.Table.from_pydict({"part": pa.array([rows[0]["to"]], pa.int64()), "kind": [rows[0]["kind"]], "a": pa.array([total.tobytes()], pa.binary())})

    parts = written(fit.select("x").mapInArrow(own, "part long, kind string, a binary"), "sums")
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        parts = written(parts.withColumn("to", F.floor(F.col("part") / (FAN * FAN))).groupBy("to").applyInArrow(merged, "part long, kind string, a binary"), "sums")
    r = parts.first()
    return np.frombuffer(r["a"], r["kind"]).reshape(shape) if r else np.zeros(shape)


def integers(rows: DataFrame, dims: int, *keep: str) -> DataFrame:
    """keep and x: the vector as dims longs."""

    def run(batches):
        for b in batches:
            x = np.clip(matrix(b.column(len(keep)), dims), -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)  # as a cast to long does
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], arrays], [*keep, "x"])

    kept = rows.select(*keep, "embedding")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)]), "x array<bigint>"])
    return kept.mapInArrow(run, schema)


class Whitening:
    """A fitted whitening: n, exact sums, components (columns, by falling eigenvalue), eigenvalues, trace."""

    def __init__(self, n: int, sums: list[int], axes: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.axes, self.values, self.trace = n, sums, axes, values, trace
        self.mean = np.array([s / n for s in sums]) if n else np.zeros(len(sums))  # Python's division of longs rounds once

    def white(self, x: np.ndarray, top: int) -> np.ndarray:
        e = self.values[:top]
        on = e > FLAT * max(self.trace, 0.0)
        return np.where(on, (x - self.mean) @ self.axes[:, :top] / np.sqrt(np.where(on, e, 1.0)), 0.0)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exactly; null beyond a long."""
        s = np.array(self.sums, object)
        rough = ((self.n * x.astype(float) - s.astype(float)) ** 2).sum(1)
        if not len(x) or rough.max() < 2**61 and float(np.abs(x).max()) * self.n < 2**61:
            gap = self.n * x - np.array(self.sums, np.int64)
            return (gap * gap).sum(1).tolist()
        exact = [sum((self.n * int(v) - t) ** 2 for v, t in zip(r, self.sums)) for r in x]
        return [v if v < 2**63 else None for v in exact]


def fitted(fit: DataFrame, dims: int, batch: int = 1 << 16) -> Whitening:
    """Whitening of a fit list, column x."""
    found = spectrum(fit, dims, batch)

    def counted(c) -> np.ndarray:
        x = longs(c, dims)
        return np.array([len(x), *(v for k in (0, 1) for v in ((x & 0xFFFFFFFF) if k else (x >> 32)).sum(0))], np.int64)  # halves of 32 bits: sums of 2**31 rows fit

    total = summed(fit, counted, (1 + 2 * dims,)) if found.n else np.zeros(1 + 2 * dims, np.int64)
    n, sums = int(total[0]), [(int(h) << 32) + int(v) for h, v in zip(total[1 : 1 + dims], total[1 + dims :])]
    first = Whitening(n, sums, np.eye(dims), np.ones(dims), 1.0)
    basis, mean = np.linalg.qr(found.q[:, ::-1])[0], first.mean

    def projected(c) -> np.ndarray:
        y = (longs(c, dims) - mean) @ basis
        return y.T @ y

    small = summed(fit, projected, (dims, dims)) / max(n, 1)
    e, u = np.linalg.eigh((small + small.T) / 2)
    return Whitening(n, sums, basis @ u[:, ::-1], e[::-1].copy(), float(np.trace(small)))


def identity_error(fit: DataFrame, w: Whitening, dims: int, top: int) -> float:
    """Largest entry of the covariance of the whitened distinct vectors minus the identity, over components with variance."""
    on = w.values[:top] > FLAT * max(w.trace, 0.0)
    if not on.any():
        return 0.0

    def outer(c) -> np.ndarray:
        y = w.white(longs(c, dims), top)[:, on]
        return y.T @ y

    k = int(on.sum())
    return float(np.abs(summed(fit, outer, (k, k)) / w.n - np.eye(k)).max())


def whiten(embeddings: DataFrame, top: int = TOP, batch: int = 1 << 16) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row that takes part and each
    of the first top components."""
    rows = embeddings.where(whole()).select("vec_id", "embedding")
    dims = width(rows)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dims:
        return embeddings.sparkSession.createDataFrame([], schema)
    vectors = integers(rows, dims, "vec_id")
    distinct = written(vectors.select("x").distinct(), "whitening-list")
    w = fitted(distinct, dims, batch)
    k = min(top, dims)
    error = identity_error(distinct, w, dims, k)
    share = np.where(w.values[:k] > FLAT * max(w.trace, 0.0), w.values[:k] / (w.trace or 1.0), 0.0)

    def run(batches):
        for b in batches:
            x = longs(b.column(1), dims)
            each = lambda a: np.repeat(np.asarray(a), k)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(each(np.arange(len(x))))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, w.n)), pa.array([v for v in w.deviation(x) for _ in range(k)], pa.int64()),
                                              pa.array(w.white(x, k).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(x) * k, error))], [f.split()[0] for f in schema.split(", ")])

    return vectors.mapInArrow(run, schema)
