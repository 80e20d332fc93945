"""Embedding whitening by mixed-precision refinement (operator 13).

The covariance of all distinct vectors is one distributed, exact sum: entries are long
integers, the integer next to each dimension's mean is taken off before multiplying, blocks
are multiplied in doubles as long as every sum stays below 2^53, and added as integers. So
no order of partitions changes a bit of it.

Its eigenvectors are found in float32 and corrected by Ogita-Aishima iterations, which are
matrix products alone, in extended precision. Where eigenvalues lie too close for that
correction, the cluster's own small problem, shifted by its centre, is solved and its vectors
turned (after which the eigenvalues are apart on the cluster's own scale).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixshard.session import cut, prepare_session

#: Fixed values of the grid: x = floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1000000
#: Components returned.
COMPONENTS = 16
#: Rows multiplied at once, at most.
BLOCK_ROWS = 8192
#: Largest exactly representable sum of a block's products.
EXACT = float(1 << 53)
#: Largest entry of a correction at which the vectors count as settled.
SETTLED = 1e-17
MOST_STEPS = 40

Wide = np.longdouble


# --- eigenvectors


def correction(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, correction E, closeness): one Ogita-Aishima step for ``x`` is x + x E.
    Eigenvalues closer than ``closeness`` get no rotation against each other."""
    r = np.eye(x.shape[1], dtype=x.dtype) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2  # then E + Eᵀ = R, and vectors of close eigenvalues stay orthogonal
    lam = np.diagonal(s) / (1 - np.diagonal(r))
    # Frobenius norms bound the spectral ones
    off = s - np.diag(lam)
    near = 2 * (np.sqrt((off * off).sum()) + np.sqrt((a * a).sum()) * np.sqrt((r * r).sum()))
    gap = lam[None, :] - lam[:, None]
    apart = np.abs(gap) > near
    e = np.where(apart, (s + lam[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return lam, e, float(near)


def clusters(lam: np.ndarray, near: float) -> list[np.ndarray]:
    """Runs of two or more eigenvalues with neighbours no further apart than ``near``."""
    order = np.argsort(lam, kind="stable")
    cuts = np.flatnonzero(np.diff(lam[order]) > near) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of ``a`` from approximate vectors ``x``, in the precision of ``a``."""
    x, last, stuck = x.astype(a.dtype), np.inf, 0
    for _ in range(MOST_STEPS):
        lam, e, near = correction(a, x)
        x = x + x @ e
        for c in clusters(lam, near):
            # the cluster's vectors, orthonormal among themselves, and its problem around its centre
            v = _orthonormal(x[:, c])
            mu = lam[c].mean()
            t = v.T @ (a @ v - mu * v)
            t = (t + t.T) / 2
            size = np.abs(t).max()
            x[:, c] = v @ np.linalg.eigh((t / size).astype(np.float64))[1].astype(a.dtype) if size > 0 else v
        step = float(np.abs(e).max())
        stuck = stuck + 1 if step >= last / 2 else 0  # rounding over the gap is all that is left
        if step <= SETTLED or stuck == 2:
            break
        last = step
    x = _orthonormal(x)
    lam = (x * (a @ x)).sum(axis=0) / (x * x).sum(axis=0)
    return lam, x / np.sqrt((x * x).sum(axis=0))


def _orthonormal(v: np.ndarray) -> np.ndarray:
    """The orthonormal vectors next to nearly orthonormal ones (two Newton-Schulz steps)."""
    one = np.eye(v.shape[1], dtype=v.dtype)
    for _ in range(2):
        v = v + v @ ((one - v.T @ v) / 2)
    return v


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns) of a symmetric matrix, in
    its precision: float32 first, then ``refine``."""
    if not a.size:
        return np.empty(0, a.dtype), np.empty((0, 0), a.dtype)
    size = np.abs(a).max()
    if not size > 0:
        return np.zeros(len(a), a.dtype), np.eye(len(a), dtype=a.dtype)
    a = a / size
    lam, x = refine(a, np.linalg.eigh(a.astype(np.float32))[1])
    order = np.argsort(-lam, kind="stable")
    return lam[order] * size, x[:, order]


# --- the distributed fit


def grid(vec: str = "embedding"):
    """The long array of a vector column: floor(64 c) + 1000000 of each entry as a double."""
    return F.transform(F.col(vec).cast("array<double>"), lambda c: F.floor(c * SCALE).cast("long") + OFFSET)


def usable(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows whose vector is not null and holds finite entries only."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.where(F.col(vec).isNotNull() & ~F.exists(F.col(vec).cast("array<double>"), bad))


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), d)


def products(z: np.ndarray) -> np.ndarray:
    """Sum of z zᵀ over rows of integers, exact: int64, or Python integers where that is too small."""
    n, d = z.shape
    top = float(np.abs(z).max()) if n else 0.0
    rows = int(EXACT // (top * top)) if top else n
    if rows < 1:
        w = z.astype(object)
        return w.T @ w
    total = np.zeros((d, d), np.int64 if top * top * n < 2**62 else object)
    step = max(1, min(rows, BLOCK_ROWS))
    for lo in range(0, n, step):
        w = z[lo: lo + step].astype(np.float64)
        total = total + (w.T @ w).astype(np.int64).astype(total.dtype)
    return total


def _sums(distinct: DataFrame, d: int, shift: np.ndarray | None):
    """Exact column sums (or, with ``shift``, products of shifted columns) over ``distinct(x)``:
    a row of each dimension per task, added by Spark, d or d x d integers at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            x = _matrix(b.column(0), d)
            for lo in range(0, len(x), BLOCK_ROWS):
                part = x[lo: lo + BLOCK_ROWS]
                new = part.sum(axis=0).astype(object) if shift is None else products(part - shift).astype(object)
                total = new if total is None else total + new
            n += len(x)
        if n:
            rows = [[v] for v in total] if shift is None else total.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(d), len(rows[0])), pa.int32()), pa.array(list(range(len(rows[0]))) * d, pa.int32()),
                                              pa.array([str(v) for r in rows for v in r]), pa.array([n] * (d * len(rows[0])), pa.int64())], names=["i", "j", "v", "n"])

    out = distinct.mapInArrow(run, "i int, j int, v string, n long").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.sum("n").alias("n")).collect()
    total = np.zeros((d, 1 if shift is None else d), object)
    for r in out:
        total[r["i"], r["j"]] = int(r["v"])
    return (int(out[0]["n"]) if out else 0), total


def _wide(x: Fraction) -> np.longdouble:
    """A fraction in extended precision: its double and what that leaves."""
    high = float(x)
    return Wide(high) + Wide(float(x - Fraction(high)))


class Fit:
    """What a fit sends to the executors: d x (components + 3) numbers."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.trace = n, sums, trace
        self.shift = np.array([_nearest(s, n) for s in sums], np.int64)
        self.rest = np.array([s - n * int(m) for s, m in zip(sums, self.shift)], object)  # S - n m, at most n / 2
        self.mean_rest = np.array([float(Fraction(int(r), n)) for r in self.rest])
        self.values = np.asarray(values, np.float64)
        self.usable = self.values > trace * 1e-15 * max(1, len(sums))
        scale = np.zeros(vectors.shape[1])
        scale[self.usable] = 1.0 / np.sqrt(self.values[self.usable])
        self.projection = vectors.astype(np.float64) * scale

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.shift).astype(np.float64) - self.mean_rest) @ self.projection

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S)^2, exact; raises where it passes a long."""
        z = x - self.shift
        top = float(np.abs(z).max()) * self.n + float(np.abs(self.rest).max()) if z.size else 0.0
        if top * top * max(1, x.shape[1]) < 2**62:
            y = z * self.n - self.rest.astype(np.int64)
            return (y * y).sum(axis=1)
        y = z.astype(object) * self.n - self.rest
        out = (y * y).sum(axis=1)
        if len(out) and max(out) >= 2**63:
            raise OverflowError("a deviation is beyond a long")
        return out.astype(np.int64)


def _nearest(s: int, n: int) -> int:
    return (2 * s + n) // (2 * n)


def fit(distinct: DataFrame, d: int, components: int = COMPONENTS) -> Fit | None:
    """The exact covariance of ``distinct(x)`` and its leading eigenvectors; None without rows.
    Two passes: sums, then products of what lies beyond each mean's integer."""
    n, s = _sums(distinct, d, None)
    if not n:
        return None
    sums = [int(v) for v in s[:, 0]]
    shift = np.array([_nearest(v, n) for v in sums], np.int64)
    _, g = _sums(distinct, d, shift)
    rest = [v - n * int(m) for v, m in zip(sums, shift)]
    cov = np.array([[_wide(Fraction(n * int(g[i, j]) - rest[i] * rest[j], n * n)) for j in range(d)] for i in range(d)], Wide).reshape(d, d)
    values, vectors = eigen(cov)
    return Fit(n, sums, vectors[:, :components], values[:components], float(np.trace(cov)))


def identity_error(distinct: DataFrame, d: int, model: Fit, shared) -> float | None:
    """Largest absolute entry of (covariance of the whitened fit list - identity), computed from
    the whitened values themselves in one more pass. Components without variance are left out."""
    use = np.flatnonzero(model.usable)
    k = len(use)
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            x = _matrix(b.column(0), d)
            for lo in range(0, len(x), BLOCK_ROWS):
                w = shared.value.whiten(x[lo: lo + BLOCK_ROWS])[:, use]  # already centred on S / n
                total[0] += w.sum(axis=0)
                total[1:] += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k + 1), k), pa.int32()), pa.array(list(range(k)) * (k + 1), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    total = np.zeros((k + 1, k))
    for r in distinct.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["i"], r["j"]] = r["v"]
    mean = total[0] / model.n
    return float(np.abs(total[1:] / model.n - np.outer(mean, mean) - np.eye(k)).max())


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _project(rows: DataFrame, d: int, shared, error: float | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Fit = shared.value
        k = m.projection.shape[1]
        explained = np.where(m.usable, m.values / m.trace if m.trace > 0 else 0.0, 0.0)
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                x = _matrix(part.column(1), d)
                r = len(x)
                none = np.tile(~m.usable, r)
                who = pa.array(part.column(0).to_pylist(), pa.int64()).take(pa.array(np.repeat(np.arange(r), k)))
                yield pa.RecordBatch.from_arrays([
                    who, pa.array(np.tile(np.arange(1, k + 1), r), pa.int32()), pa.array(np.full(r * k, m.n), pa.int64()), pa.array(np.repeat(m.deviation(x), k), pa.int64()),
                    pa.array(m.whiten(x).ravel(), pa.float64(), mask=none), pa.array(np.tile(explained, r), pa.float64(), mask=none if m.trace <= 0 else None),
                    pa.array([error] * (r * k), pa.float64())], names=[f.split()[0] for f in WHITENED.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(run, WHITENED)


def whiten(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row whose
    vector is not null and holds neither null nor non-finite entries, for up to ``components``
    components (as many as the vector has entries, if fewer).

    Repeated vectors count once in the fit and keep their own rows; null ids stay null; other
    columns are not read; vectors of different lengths are fitted by themselves; empty vectors
    have no components; an empty table gives an empty result. A component without variance
    has a null ``whitened`` (and, if no component has any, null ``explained`` and
    ``identity_error``). Entries beyond a long on the grid raise.

    The fit list is written once in the shared folder: two passes sum it exactly, one measures
    the result. Equal vectors meet after map-side combine; the driver gets d x d integers."""
    prepare_session(spark)
    rows = usable(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"))).select("vec_id", grid().alias("x"))
    distinct = cut(rows.select("x").distinct(), "fit-list")
    out = None
    for d in sorted(r["d"] for r in distinct.select(F.size("x").alias("d")).distinct().collect()):
        own = distinct.where(F.size("x") == d)
        model = fit(own, d, components) if d else None
        if model is None:
            continue
        shared = spark.sparkContext.broadcast(model)
        part = _project(rows.where(F.size("x") == d), d, shared, identity_error(own, d, model, shared))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], WHITENED)


def q_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``embeddings`` whitened by the covariance of all distinct vectors."""
    return whiten(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
