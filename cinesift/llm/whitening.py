"""Whitening of embeddings: Welford moments, merged across partitions, and a symmetric QR eigen-solve."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import materialize
from .common import map_batches

#: Components that are kept, and partial moments that one task, or the driver, merges.
COMPONENTS, FAN_IN = 16, 32
#: Integer entries are below this, so entries and their differences are exact as 64-bit integers.
LARGEST = 1 << 61
_LONG = np.iinfo(np.int64).max


def as_integers(rows: DataFrame, column: str = "embedding", scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """rows with x, the entries c of `column` as floor(scale * c) + offset. Left out are rows
    whose vector is null, empty, or holds null or non-finite entries or one for which x
    isn't below LARGEST; and those with another number of entries than most vectors have
    (of equally common numbers the largest counts)."""
    entry = lambda c: c.cast("double") * F.lit(scale)
    sound = F.coalesce(F.forall(column, lambda c: F.coalesce(F.abs(entry(c)) < F.lit(float(LARGEST) / 2), F.lit(False))), F.lit(False))
    rows = rows.where(sound & (F.size(column) > 0)).withColumn("x", F.transform(column, lambda c: F.floor(entry(c)).cast("long") + F.lit(offset)))
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows if common is None else rows.where(F.size("x") == common["d"])


@dataclass
class Moments:
    """Of n integer vectors: sums of each entry, exact, and the sums of products of
    entries less their means."""

    n: int
    sums: list[int]
    products: np.ndarray

    def merged(self, other: Moments) -> Moments:
        """Of both together, by the parallel update formula. The means' difference is
        taken from exact sums."""
        n = self.n + other.n
        apart = np.array([float(Fraction(b * self.n - a * other.n, self.n * other.n)) for a, b in zip(self.sums, other.sums, strict=True)])
        products = self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], products)


class Welford:
    """Moments of a stream of integer vectors, by a rank-one update for each.

    Vectors are taken relative to the first one, which is exact, so large offsets cost
    no digits."""

    def __init__(self, pivot: np.ndarray):
        d = len(pivot)
        self.n, self.pivot, self.mean, self.products = 0, pivot, np.zeros(d), np.zeros((d, d))
        self.high, self.low = np.zeros(d, np.int64), np.zeros(d, np.int64)

    def add(self, x: np.ndarray) -> None:
        """Each row of x."""
        away = x - self.pivot
        self.high += (away >> 31).sum(axis=0)
        self.low += (away & 0x7FFFFFFF).sum(axis=0)
        for v in away.astype(np.float64):
            self.n += 1
            delta = v - self.mean
            self.mean += delta / self.n
            self.products += np.multiply.outer(delta, v - self.mean)

    def moments(self) -> Moments:
        sums = [self.n * int(p) + (int(h) << 31) + int(lo) for p, h, lo in zip(self.pivot, self.high, self.low, strict=True)]
        return Moments(self.n, sums, (self.products + self.products.T) / 2)


def vectors(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


MOMENTS = "part long, n long, sums array<string>, products binary"


def _row(part: int, m: Moments) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([m.n], pa.int64()), pa.array([[str(s) for s in m.sums]], pa.list_(pa.string())), pa.array([m.products.tobytes()], pa.binary())],
        names=["part", "n", "sums", "products"],
    )


def _moments(n: int, sums: Iterable[str], products: bytes) -> Moments:
    sums = [int(s) for s in sums]
    return Moments(n, sums, np.frombuffer(products, np.float64).reshape(len(sums), len(sums)))


def moments(fit_list: DataFrame, fan_in: int = FAN_IN) -> Moments | None:
    """Of all vectors (x). Each task streams its partition and gives one row; rows are
    merged by `fan_in` in a task, level by level, until as few are left for the driver.
    None if there are no vectors."""
    from pyspark import TaskContext

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            x = vectors(batch.column(0))
            if len(x):
                held = held or Welford(x[0])
                held.add(x)
        if held is not None:
            yield _row(TaskContext.get().partitionId(), held.moments())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, None
        for batch in batches:
            for p, n, sums, products in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = _moments(n, sums, products)
                if p != part:
                    if held is not None:
                        yield _row(part, held)
                    part, held = p, own
                else:
                    held = held.merged(own)
        if held is not None:
            yield _row(part, held)

    rows, level = materialize(fit_list.select("x").mapInArrow(stream, MOMENTS), "moments"), 0
    while rows.count() > fan_in:
        level += 1
        dealt = rows.withColumn("part", F.expr(f"part div {fan_in}")).repartition("part").sortWithinPartitions("part", "n", "sums")
        rows = materialize(dealt.mapInArrow(merge, MOMENTS), f"moments-{level}")
    out = None
    for r in sorted(rows.collect(), key=lambda r: r["part"]):
        own = _moments(r["n"], r["sums"], bytes(r["products"]))
        out = own if out is None else out.merged(own)
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and Q of Q.T @ a @ Q, by Householder reflections."""
    a, n = a.astype(np.float64), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0 or not np.any(v[1:]):
            continue
        v[0] += math.copysign(size, v[0])
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = p - v * (v @ p)
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, whose
    entry of the largest size is positive: implicit QR steps with Wilkinson's shift on
    the tridiagonal form, split where an off-diagonal entry is nothing beside its neighbours."""
    d, e, q = tridiagonal(a)
    rows, high, steps = q.T.copy(), len(d) - 1, 0  # rows of q.T are vectors: contiguous
    tiny = np.finfo(float).eps
    while high > 0:
        for i in range(high):
            if abs(e[i]) <= tiny * (abs(d[i]) + abs(d[i + 1])):
                e[i] = 0.0
        if e[high - 1] == 0:
            high -= 1
            continue
        if (steps := steps + 1) > 60 * len(d):
            raise ArithmeticError("QR steps don't converge: the matrix isn't finite")
        low = high - 1
        while low > 0 and e[low - 1] != 0:
            low -= 1
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + math.copysign(math.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):  # chase the bulge down
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            p, o, t = d[k], e[k], d[k + 1]
            d[k], d[k + 1] = c * c * p + 2 * c * s * o + s * s * t, s * s * p - 2 * c * s * o + c * c * t
            e[k] = c * s * (t - p) + (c * c - s * s) * o
            x = e[k]
            if k < high - 1:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            rows[k], rows[k + 1] = c * rows[k] + s * rows[k + 1], c * rows[k + 1] - s * rows[k]
    order = np.argsort(-d, kind="stable")
    values, vectors_ = d[order], rows[order]
    vectors_ *= np.sign(vectors_[np.arange(len(d)), np.argmax(np.abs(vectors_), axis=1)])[:, None]
    return values, vectors_.T


@dataclass
class Whitening:
    """n and sums of the fit list; rows of `components` are unit eigenvectors, over `roots` of their
    eigenvalues; explained: shares of the trace. Components without variance have root nan."""

    n: int
    sums: list[int]
    components: np.ndarray
    roots: np.ndarray
    explained: np.ndarray

    def __post_init__(self):
        self.near = [(2 * s + self.n) // (2 * self.n) for s in self.sums]  # the whole numbers beside the means
        self.rest = np.array([float(Fraction(s - k * self.n, self.n)) for s, k in zip(self.sums, self.near, strict=True)])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - np.array(self.near, np.int64)).astype(np.float64) - self.rest) @ self.components.T / self.roots

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S) ** 2 over entries, exact; None beyond a long."""
        near = x - np.array(self.near, np.int64)
        most = int(np.abs(near).max(initial=0)) + 1
        if (most * self.n) ** 2 * x.shape[1] < _LONG:
            away = self.n * near - np.array([s - k * self.n for s, k in zip(self.sums, self.near, strict=True)], np.int64)
            return (away * away).sum(axis=1).tolist()
        out = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        return [v if v <= _LONG else None for v in out]


def fit(fit_list: DataFrame, components: int = COMPONENTS, fan_in: int = FAN_IN) -> Whitening | None:
    """The whitening of distinct integer vectors (x). The covariance, a square of the number
    of entries, is solved on the driver. None if there are no vectors."""
    m = moments(fit_list, fan_in)
    if m is None:
        return None
    values, vectors_ = eigen(m.products / m.n)
    trace, k = float(np.trace(m.products / m.n)), min(components, len(values))
    has = values[:k] > max(trace, 0.0) * len(values) * np.finfo(float).eps
    explained = np.where(has, values[:k], 0.0) / trace if trace > 0 else np.full(k, np.nan)
    return Whitening(m.n, m.sums, vectors_[:, :k].T.copy(), np.sqrt(np.where(has, values[:k], np.nan)), explained)


def identity_error(fit_list: DataFrame, model: Whitening, fan_in: int = FAN_IN) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity,
    over components with variance, measured on the rows: their products are summed in
    each task, and the tasks' sums by the driver's `fan_in` tables at most."""
    shared, has = fit_list.sparkSession.sparkContext.broadcast(model), np.isfinite(model.roots)
    k = int(has.sum())
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = shared.value.whitened(vectors(batch.column(0)))[:, has]
                sums += w.sum(axis=0)
                products += w.T @ w
        at = np.arange(k * (k + 1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([products.ravel(), sums]))], names=["at", "v"])

    rows = fit_list.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    v = np.zeros(k * (k + 1))
    v[rows["at"].to_numpy()] = rows["v"].to_numpy() / model.n
    mean = v[k * k :]
    return float(np.abs(v[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, column: str = "embedding", scale: float = 64.0, offset: int = 1_000_000, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: for each row
    that as_integers() keeps, a row for each component.

    Vectors are fitted as whole numbers (as_integers()), each distinct one once: n of them.
    Components are eigenvectors of their covariance, numbered from 1 by falling
    eigenvalue; there are as many as entries, `components` at most. whitened: the vector
    less the mean, projected on the component, over the eigenvalue's root. explained: the
    eigenvalue's share of the trace. deviation: the sum over entries of (n * x - S) ** 2, S being
    the sums of the fit list, exact; null beyond a long. identity_error: see there.

    Components without variance (also all, if the vectors are one) have whitened null and
    explained 0, or null if there's no variance at all. Null ids stay; repeated rows each give
    their rows and count once in the fit. No rows, or none with a sound vector: no rows.
    Other columns of rows are ignored, also those with names of the result.
    """
    x = as_integers(rows.select("vec_id", column), column, scale, offset).select("vec_id", "x")
    fit_list = materialize(x.select("x").distinct(), "vectors")
    model = fit(fit_list, components)
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error, shared = identity_error(fit_list, model), rows.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value
        k = len(known.explained)

        def f(batch):
            each = np.repeat(np.arange(batch.num_rows), k)
            own = vectors(batch.column(1))
            if not len(own):
                return
            floats = lambda v: pa.array(v, pa.float64(), mask=~np.isfinite(v))
            arrays = [
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))), pa.array(np.full(len(each), known.n, np.int64)), pa.array(known.deviations(own), pa.int64()).take(pa.array(each)),
                floats(known.whitened(own).ravel()), floats(np.tile(known.explained, len(own))), pa.array(np.full(len(each), error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

        return f

    return map_batches(x, make, schema, rows=1024)
