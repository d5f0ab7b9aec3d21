"""Whitening of embeddings by their leading principal components.

Entries become whole numbers on a fixed grid, ``x = floor(scale * c) + offset``, so that sums are
exact. Pass one adds n, sums and bounds per dimension; pass two adds the centred products
``(x - S/n)(x - S/n)'`` as one matrix per task, the cells of which Spark sums. The matrix is as
large as the dimension squared, whatever the number of rows, and the driver solves it: Householder
reflections make it tridiagonal, Sturm counts bisect for the leading eigenvalues, inverse iteration
finds their vectors, those of close values are made orthogonal again, and the reflections are
applied backwards. The components go to all tasks; pass three projects and writes, and the
covariance of what was written is compared with the identity.

Every task streams its batches and keeps sums only; no row has a key, so nothing can be skewed.

Defined cases: a vector that is null, empty, or holds a null, NaN or infinite entry is dropped;
so is one whose length is not the most frequent one (of equally frequent ones the longest);
entries beyond +-2^40 grid steps count as that bound; components of eigenvalue 0 (up to rounding,
as with fewer rows than dimensions, equal rows or one row) are left out, without any there are no
rows; repeated rows and null or equal ids each get their rows; ``deviation`` is exact as a decimal
and null where 38 digits do not hold it; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, collector_off, stage

SCALE, OFFSET = 64, 1_000_000
#: Grid steps at which entries saturate.
BOUND = 1 << 40
EPS = np.finfo(float).eps


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (array of doubles): finite vectors of the most frequent length."""
    v = col(vector_col).cast("array<double>")
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    found = rows.select(col(id_col).alias("vec_id"), v.alias("v")).where((F.size("v") > 0) & whole)
    top = found.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.where(F.size("v") == (top.d if top else 0))


def grid(vectors) -> np.ndarray:
    """Whole numbers of one batch of vectors, a row for each."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    steps = np.clip(np.floor(SCALE * flat), -BOUND, BOUND).astype(np.int64) + OFFSET
    return steps.reshape(len(vectors), -1)


def _sums(batches):
    """n, sum, least and largest grid value of each dimension in one task."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = grid(batch.column(1))
            part = [int(s) for s in x.sum(0)]
            total = part if total is None else [a + b for a, b in zip(total, part)]
            low = x.min(0) if n == 0 else np.minimum(low, x.min(0))
            high = x.max(0) if n == 0 else np.maximum(high, x.max(0))
            n += len(x)
    if n:
        yield pa.record_batch({
            "j": pa.array(range(len(total)), pa.int32()), "n": pa.array([n] * len(total), pa.int64()),
            "s": pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)), "lo": pa.array(low), "hi": pa.array(high)})


def _products(column: int, centre):
    """A kernel that adds the outer products of ``centre(batch column)`` in one task."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                c = centre(batch.column(column))
                total = c.T @ c if total is None else total + c.T @ c
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "p": pa.array(total[i, j])})

    return run


def _matrix(cells: DataFrame, d: int) -> np.ndarray:
    """Symmetric matrix from summed cells of the upper triangle."""
    out = np.zeros((d, d))
    for i, j, p in cells.groupBy("i", "j").agg(F.sum("p").alias("p")).toLocalIterator():
        out[i, j] = out[j, i] = p
    return out


# -- eigenvectors of a symmetric matrix, on the driver ------------------------------------------


def tridiagonal(a: np.ndarray):
    """Diagonal, off-diagonal and reflection vectors of a Householder reduction."""
    a = a.copy()
    reflections = []
    for k in range(len(a) - 2):
        x = a[k + 1 :, k]
        norm = np.linalg.norm(x)
        v = x.copy()
        v[0] += norm if x[0] >= 0 else -norm
        size = np.linalg.norm(v)
        if size > 0:
            v /= size
            # A <- H A H with H = I - 2 v v', on the trailing block and the column k
            p = a[k + 1 :, k + 1 :] @ v
            w = p - (v @ p) * v
            a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1 :, k] -= 2 * v * (v @ x)
            a[k, k + 1 :] = a[k + 1 :, k]
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def count_below(diag: np.ndarray, off2: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are less than each of ``at``: negative pivots of T - at (Sturm)."""
    tiny = np.finfo(float).tiny ** 0.5
    q = diag[0] - at
    below = (q < 0).astype(int)
    for i in range(1, len(diag)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = diag[i] - at - off2[i - 1] / q
        below += q < 0
    return below


def leading_values(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues in falling order, all brackets halved at once."""
    n = len(diag)
    around = np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))
    span = max((diag + around).max() - (diag - around).min(), np.finfo(float).tiny)
    low = np.full(k, (diag - around).min() - EPS * span)
    high = np.full(k, (diag + around).max() + EPS * span)
    rank = n - np.arange(k)  # value j is the least one with at least rank[j] values not above it
    while True:
        mid = (low + high) / 2
        open_ = (mid > low) & (mid < high)
        if not open_.any():
            return mid
        above = count_below(diag, off * off, mid) >= rank
        high = np.where(open_ & above, mid, high)
        low = np.where(open_ & ~above, mid, low)


def solve_shifted(diag: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; pivots of 0 become ``least``."""
    n = len(diag)
    d, up, up2, low, x = diag - shift, np.append(off, 0.0), np.zeros(n), off.copy(), b.copy()
    for i in range(n - 1):
        if abs(low[i]) > abs(d[i]):
            d[i], low[i] = low[i], d[i]
            up[i], d[i + 1] = d[i + 1], up[i]
            up2[i], up[i + 1] = up[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(d[i]) < least:
            d[i] = least
        m = low[i] / d[i]
        d[i + 1] -= m * up[i]
        up[i + 1] -= m * up2[i]
        x[i + 1] -= m * x[i]
    if abs(d[n - 1]) < least:
        d[n - 1] = least
    for i in range(n - 1, -1, -1):
        rest = x[i]
        if i + 1 < n:
            rest -= up[i] * x[i + 1]
        if i + 2 < n:
            rest -= up2[i] * x[i + 2]
        x[i] = rest / d[i]
    return x


def tridiagonal_vectors(diag, off, values) -> np.ndarray:
    """Unit eigenvectors as columns; each is kept orthogonal to those of its cluster of values."""
    size = max(np.abs(diag).max() + 2 * (np.abs(off).max() if len(off) else 0), 1e-100)
    least, near = EPS * size, 1e-3 * size
    rng = np.random.default_rng(7)
    out = np.zeros((len(diag), len(values)))
    first = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > near:
            first = j
        shift = value - 2 * EPS * size * (j - first)  # equal values do not share one solution
        x = rng.uniform(-1, 1, len(diag))
        for _ in range(5):
            x = solve_shifted(diag, off, shift, x / np.linalg.norm(x), least)
            for _ in range(2):
                x = x - out[:, first:j] @ (out[:, first:j].T @ x)
        out[:, j] = x / np.linalg.norm(x)
    return out


def leading_components(matrix: np.ndarray, k: int):
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    diag, off, reflections = tridiagonal(matrix)
    values = leading_values(diag, off, min(k, len(diag)))
    vectors = tridiagonal_vectors(diag, off, values)
    for step in range(len(reflections) - 1, -1, -1):
        v = reflections[step]
        vectors[step + 1 :] -= 2 * np.outer(v, v @ vectors[step + 1 :])
    return values, vectors


# -- the operator ---------------------------------------------------------------------------------


def whiten(rows: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n, deviation (exact decimal), whitened (array, one value for each component),
    explained (array), identity_error of each usable row."""
    spark = rows.sparkSession
    out = "vec_id long, deviation decimal(38,0), whitened array<double>"
    found = usable(rows, id_col, vector_col)
    sums = found.mapInArrow(_sums, "j int, n long, s decimal(38,0), lo long, hi long")
    at = sums.groupBy("j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    at = sorted(at.collect())  # a row for each dimension
    empty = spark.createDataFrame([], out).selectExpr("vec_id", "0L n", "deviation", "whitened", "array(0D) explained", "0D identity_error")
    if not at:
        return empty
    n, total, d = at[0].n, [int(r.s) for r in at], len(at)
    far = max(max(n * r.hi - t, t - n * r.lo) for r, t in zip(at, total))
    exact = np.int64 if d * far * far < 1 << 63 else object
    sums_of = np.array(total, exact)

    def residual(vectors):
        """n * x - S, exact."""
        return n * grid(vectors).astype(exact) - sums_of

    def centred(vectors):
        return residual(vectors).astype(float) / n

    v = _matrix(found.mapInArrow(_products(1, centred), "i int, j int, p double"), d) / n
    trace = float(np.trace(v))
    values, vectors = leading_components(v, components)
    keep = values > max(d, 10) * EPS * max(values[0], 0.0)
    values, vectors = values[keep], vectors[:, keep]
    if not len(values):
        return empty
    onto = vectors / np.sqrt(values)
    most = 10**38

    @collector_off
    def project(batches):
        for batch in batches:
            if batch.num_rows:
                r = residual(batch.column(1))
                w = (r.astype(float) / n) @ onto
                off = [Decimal(int(s)) if s < most else None for s in (r * r).sum(1)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.record_batch({"vec_id": batch.column(0).cast(pa.int64()), "deviation": pa.array(off, pa.decimal128(38, 0)), "whitened": lists})

    done = stage(found.mapInArrow(project, out))
    k = len(values)
    means = done.select(F.posexplode("whitened").alias("j", "w")).groupBy("j").agg(F.avg("w").alias("m")).collect()
    mean = np.array([r.m for r in sorted(means)])

    def around_mean(lists):
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, k) - mean

    again = _matrix(done.mapInArrow(_products(2, around_mean), "i int, j int, p double"), k) / n
    error = float(np.abs(again - np.eye(k)).max())
    return done.select(
        "vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.lit((values / trace).tolist()).alias("explained"), F.lit(error).alias("identity_error"))


def per_component(white: DataFrame) -> DataFrame:
    """A row for each vector and component, numbered from 1."""
    each = white.select("*", F.posexplode("whitened").alias("p", "w"))
    return each.select(
        "vec_id", (F.col("p") + 1).cast("int").alias("component"), "n", F.expr("try_cast(deviation AS long)").alias("deviation"),
        F.col("w").alias("whitened"), F.get("explained", F.col("p")).alias("explained"), "identity_error")
