"""Operator 11: whitening of embeddings by FEAST contour integration.

Entries become whole numbers; counts, sums and centred products of the distinct vectors are summed exactly, in partial
blocks that tasks merge in two levels, so the covariance V is right to its last digit whatever the mean.  Sylvester's
law of inertia, on a tridiagonal form congruent to V - sI, counts the eigenvalues on either side of a shift and places
intervals in gaps.  In each interval (one task each) Gauss-Legendre points on a circle around it give complex shifted systems
whose solutions project a random block onto the interval's eigenspace; Rayleigh-Ritz extracts values and vectors, and the round
repeats until the residuals vanish.  An interval whose vectors are not as many as its inertia count is done again with a
wider block, and in the end refused.

Vectors that are null, empty, or hold a null or non-finite entry take no part, nor do vectors of another length than the
commonest one (ties: the longer).  Scaled entries beyond 2**56 in size stand for 2**56.  A null id is kept as it is;
equal rows are whitened each, and count once in the fit.  Components without variance (up to rounding) are left out,
so equal vectors, one vector or an empty table give no rows.  A deviation that no long can hold is the largest long.  Ties
(equal eigenvalues) are numbered in either order, alike for all rows.  Extra columns are never read.  What reaches the driver is
one matrix of the embedding's width.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, materialise, read

SCALE, SHIFT, BOUND = 64, 1_000_000, float(1 << 56)
COMPONENTS = 16
#: Eigenvalues sought in one interval, quadrature points on its half circle, rounds, groups of the first level of sums.
PER_INTERVAL, POINTS, ROUNDS, GROUPS = 8, 8, 40, 64
#: Bytes that a block of a partial matrix takes, about.
BLOCK_BYTES = 1 << 20
LONG = (1 << 63) - 1


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array of longs) of the vectors that take part."""
    c = F.col("embedding").cast("array<double>")
    good = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select("vec_id", F.when(c.isNotNull() & (F.size(c) > 0), c).alias("embedding")).where(F.col("embedding").isNotNull() & good)
    common = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    x = F.transform("embedding", lambda e: F.floor(F.least(F.greatest(e * SCALE, F.lit(-BOUND)), F.lit(BOUND))) + SHIFT)
    return rows.where(F.size("embedding") == (common.width if common else 0)).select("vec_id", x.alias("x"))


# exact whole numbers in arrays: long while they fit, Python's own beyond


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype == np.float64:
        return a + b
    if a.dtype == object or b.dtype == object or float(np.abs(a).max(initial=0)) + float(np.abs(b).max(initial=0)) >= 2.0**62:
        return a.astype(object) + b.astype(object)
    return a + b


def products(y: np.ndarray) -> np.ndarray:
    """Sum of y y^T over the rows of y."""
    top = float(np.abs(y).max(initial=0))
    if top * top * len(y) < 2.0**53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    y = y.astype(object)
    return y.T @ y


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S of each entry."""
    if n * max(float(np.abs(x).max(initial=0)), 1.0) < 2.0**61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b, b.column(b.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def summed(fit: DataFrame, partial, width: int) -> np.ndarray:
    """Sum over all tasks of ``partial``(rows of a batch), an array of ``width`` columns, merged by row blocks in two levels."""
    tall = max(1, BLOCK_BYTES // (8 * width))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for _, x in matrices(batches):
            part = partial(x)
            total = part if total is None else plus(total, part)
        if total is not None:
            k = range(0, len(total), tall)
            yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()] * len(k), "block": list(k), "sums": [pickle.dumps(total[i : i + tall]) for i in k]}, schema=SUMS)

    def merged(t: pa.Table) -> pa.Table:
        t = t.sort_by("task")
        total = None
        for s in t["sums"]:
            part = pickle.loads(s.as_py())
            total = part if total is None else plus(total, part)
        return pa.table({"task": [t["task"][0].as_py()], "block": [t["block"][0].as_py()], "sums": [pickle.dumps(total)]}, schema=SUMS)

    parts = fit.mapInArrow(first, "task int, block int, sums binary")
    for keys in (["block", F.pmod("task", F.lit(GROUPS))], ["block"]):
        parts = parts.groupBy(*keys).applyInArrow(merged, "task int, block int, sums binary")
    return np.concatenate([pickle.loads(bytes(r.sums)) for r in sorted(parts.collect(), key=lambda r: r.block)])


SUMS = pa.schema([("task", pa.int32()), ("block", pa.int32()), ("sums", pa.binary())])


# eigenvalues by intervals


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a tridiagonal matrix orthogonally similar to a symmetric one."""
    a = a.copy()
    n = len(a)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        if size:
            v /= size
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            w = p - (v @ p) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            col = a[k + 1 :, k]
            col -= 2 * (v @ col) * v
    return np.diag(a).copy(), np.diag(a, -1) ** 2


def inertia(form: tuple[np.ndarray, np.ndarray], shifts: np.ndarray) -> np.ndarray:
    """Eigenvalues below each shift: the negative pivots of the shifted form."""
    d, e2 = form
    tiny = np.finfo(float).tiny ** 0.5
    below = np.zeros(len(shifts), int)
    q = np.ones(len(shifts))
    for i in range(len(d)):
        q = d[i] - shifts - (e2[i - 1] / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def located(form: tuple[np.ndarray, np.ndarray], ranks: list[int], top: float) -> np.ndarray:
    """The eigenvalues of the given ranks (1 is the smallest), by bisection with inertia counts."""
    ranks = np.array(ranks)
    lo, hi = np.full(len(ranks), -2.0 * top), np.full(len(ranks), 2.0 * top)
    for _ in range(80):
        mid = (lo + hi) / 2
        low = inertia(form, mid) < ranks
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def intervals(v: np.ndarray, want: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) from the top down, together with the ``want`` largest ones that are not zero."""
    form, p = tridiagonal(v), len(v)
    top = float(np.abs(v).sum(axis=1).max())
    if not top:
        return []
    zero = p * np.finfo(float).eps * top
    want = min(want, p - int(inertia(form, np.array([zero]))[0]))
    out, high, done = [], 1.5 * top, 0
    while done < want:
        # cut in the first gap at or below the wanted rank
        last = min(done + PER_INTERVAL, want)
        while True:
            ends = located(form, [p - last + 1, max(p - last, 1)], top)
            below = ends[1] if last < p else -top
            if last == p or ends[0] - below > 1e-9 * top:
                break
            last += 1
        low = max(zero, (ends[0] + below) / 2) if ends[0] > 2 * zero else (ends[0] + below) / 2
        out.append((float(low), float(high), last - done))
        high, done = low, last
    return out


def feast(v: np.ndarray, low: float, high: float, count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors of v inside (low, high), which holds ``count`` of them."""
    p = len(v)
    # the upper end of the first interval is far away: a circle around the eigenvalues themselves converges sooner
    x, weight = np.polynomial.legendre.leggauss(POINTS)
    turn = np.exp(0.5j * math.pi * (x + 1))
    scale, rng = float(np.abs(v).sum(axis=1).max()), np.random.default_rng(seed)
    for wide in (count + count // 2 + 4, 2 * count + 16, p):
        block = rng.standard_normal((p, min(p, wide)))
        a, b = low, high
        for _ in range(ROUNDS):
            centre, radius = (a + b) / 2, (b - a) / 2
            q = np.zeros_like(block)
            for t, w in zip(turn, weight, strict=True):
                q += 0.5 * w * (radius * t * np.linalg.solve((centre + radius * t) * np.eye(p) - v, block)).real
            q = np.linalg.qr(q)[0]
            values, turned = np.linalg.eigh(q.T @ v @ q)
            block = q @ turned
            inside = (values > low) & (values < high)
            worst = np.linalg.norm(v @ block[:, inside] - block[:, inside] * values[inside], axis=0).max(initial=0.0)
            if inside.sum() == count:
                b = min(high, values[inside].max() + (values[inside].max() - low) * 0.1)
                if worst <= 64 * np.finfo(float).eps * scale:
                    return values[inside], block[:, inside]
        if inside.sum() == count and worst <= 1e-12 * scale * p:
            return values[inside], block[:, inside]
    raise ArithmeticError(f"{inside.sum()} eigenvectors between {low} and {high}, {count} by inertia, residual {worst}")


@dataclass
class Whitening:
    """n distinct vectors with sums S; eigenvalues and unit eigenvectors (columns) of their covariance by falling value."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact n * x - S, and whitened rows."""
        dev = deviations(x, self.n, self.sums)
        return dev, (dev / self.n).astype(np.float64) @ (self.vectors / np.sqrt(self.values))


def covariance(fit: DataFrame) -> tuple[int, list[int], np.ndarray | None]:
    """n, S and the covariance (divisor n) of fit(x); every sum is exact."""
    one = fit.select(F.size("x").alias("p")).first()
    if one is None:
        return 0, [], None
    p = one.p

    def ones_and_sums(x):
        exact = x if float(np.abs(x).max()) * len(x) < 2.0**62 else x.astype(object)
        return np.concatenate([[[len(x)]], exact.sum(axis=0)[None, :]], axis=1)

    head = summed(fit, ones_and_sums, p + 1)[0]
    n, sums = int(head[0]), [int(s) for s in head[1:]]
    centre = np.array([s // n for s in sums], np.int64)
    c = summed(fit, lambda x: products(x - centre), p).astype(object)
    rest = np.array([s - n * int(m) for s, m in zip(sums, centre, strict=True)], object)
    return n, sums, ((n * c - np.outer(rest, rest)) / (n * n)).astype(np.float64)


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The model of distinct vectors fit(x), written once by the caller: it is read three times."""
    spark = fit.sparkSession
    n, sums, v = covariance(fit)
    parts = intervals(v, components) if v is not None else []
    if not parts:
        return Whitening(n, sums, 0.0, np.zeros(0), np.zeros((len(sums), 0)))
    held = spark.sparkContext.broadcast(v)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                values, vectors = feast(held.value, r["low"], r["high"], r["count"])
                yield pa.RecordBatch.from_pydict({"found": [pickle.dumps((values, vectors))]})

    found = [pickle.loads(bytes(r.found)) for r in spark.createDataFrame(parts, "low double, high double, count int").repartition(len(parts)).mapInArrow(solve, "found binary").collect()]
    held.unpersist()
    values, vectors = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found], axis=1)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    # one sign for all rows: the largest entry of a component is positive
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    model = Whitening(n, sums, float(np.trace(v)), values, vectors)

    def second(x):
        w = model.project(x)[1]
        return np.concatenate([w.T @ w, w.sum(axis=0)[None, :]])

    total = summed(fit, second, len(order))
    mean = total[-1] / n
    model.identity_error = float(np.abs(total[:-1] / n - np.outer(mean, mean) - np.eye(len(order))).max())
    return model


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation (exact), whitened (an entry for each component) of rows(vec_id, x)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in matrices(batches):
            dev, w = model.project(x)
            if dev.dtype != object and float(np.abs(dev).max()) ** 2 * dev.shape[1] >= 2.0**62:
                dev = dev.astype(object)
            far = (dev * dev).sum(axis=1)
            far = far if far.dtype != object else [min(int(a), LONG) for a in far]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("vec_id")), pa.array(far, pa.int64()), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1], w.ravel())], ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(apply, "vec_id long, deviation long, whitened array<double>")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: a row for each remaining vector and component."""
    rows = whole_vectors(read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    fit = materialise(rows.select("x").distinct(), "vectors")
    model = fit_whitening(fit)
    drop(spark, fit)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values]) if len(model.values) else F.array().cast("array<double>")
    out = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return out.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("i")].alias("explained"), F.lit(model.identity_error).alias("identity_error"))
