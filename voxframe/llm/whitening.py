"""Whitening of embeddings by singular values of the bidiagonal form.

Each entry c of a vector becomes the whole number floor(64 c) + 1000000, so that sums and the mean are exact and equal
vectors are told apart exactly. Directions are fitted on the distinct vectors:

1. counts and sums per dimension, added up on Spark;
2. blockwise QR: a task reduces its centred rows, block by block, to one triangle; triangles are reduced FAN at a time, in
   rounds of Spark tasks, to a single one of d x d, which alone reaches the driver;
3. there, Householder reflections turn the triangle into a bidiagonal matrix; dqds (differential quotient-difference
   steps with shifts) finds all its singular values to high relative accuracy;
4. twisted factorisations of the shifted tridiagonal matrix B'B give the leading right singular vectors, corrected by
   their Rayleigh quotients; neighbours closer than CLOSE are made orthogonal, and where that leaves too little, found
   together by block inverse iteration. Reflections carry them back to the given dimensions.

All rows, repeated ones too, are then projected in one pass, with a matrix of d x 16 numbers. Memory is a block of rows
and d x d numbers in a task and on the driver (d = 1024: 8 MB).

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries go; so do entries that no long holds
(64 c of 2**62 or more). The dimension is the one that most rows have (of equally many, the largest), as other rows
lack entries or have too many: they go too. Directions without variance (singular values within rounding of 0)
can't be whitened and give no rows, so equal vectors, a single one, or an empty table give an empty result. A null
vec_id stays null; repeated rows give repeated results; of equal singular values any basis is taken, the same for all
rows; a component's entry of largest size is positive; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.shared import publish, scratch

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
BLOCK, FAN = 4096, 16
CLOSE, EPS, LEAST = 1e-6, np.finfo(float).eps, 1e-290
RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


# --- the solver, on a triangle of d x d ---


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Diagonal and superdiagonal of U'rV, and the reflections that make up V."""
    r, d = r.copy(), len(r)
    right = []
    for k in range(d):
        v = _reflection(r[k:, k])
        r[k:, k:] -= np.outer(2 * v, v @ r[k:, k:])
        if k < d - 2:
            v = _reflection(r[k, k + 1 :])
            r[k:, k + 1 :] -= np.outer(r[k:, k + 1 :] @ v, 2 * v)
            right.append((k + 1, v))
    return np.diag(r).copy(), np.diag(r, 1).copy(), right


def _reflection(x: np.ndarray) -> np.ndarray:
    """Unit v so that (I - 2vv')x has only its first entry; zero if it has no others already."""
    v = x.copy()
    size = np.linalg.norm(x)
    if size == 0 or not np.any(x[1:]):
        return np.zeros_like(x)
    v[0] += np.copysign(size, x[0])
    return v / np.linalg.norm(v)


def _step(q: list, e: list, shift: float) -> tuple[list, list, float, int]:
    """One differential qd step: the new arrays, the least d, and the first place at which d is negative (-1: nowhere)."""
    d = q[0] - shift
    least, bad = d, 0 if d < 0 else -1
    nq, ne = [], []
    for i, ei in enumerate(e):
        s = d + ei
        if s == 0:
            s = LEAST
        nq.append(s)
        t = q[i + 1] / s
        ne.append(ei * t)
        d = d * t - shift
        if d < 0 and bad < 0:
            bad = i + 1
        least = min(least, d)
    nq.append(d)
    return nq, ne, least, bad


def squared_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the upper bidiagonal matrix with diagonal a, superdiagonal b; falling."""
    found, waiting = [], [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)]
    small = (100 * EPS) ** 2
    while waiting:
        q, e, total = waiting.pop()
        while q:
            if len(q) == 1 or e[-1] <= small * (total + q[-1]):
                found.append(total + q.pop())
                e = e[: len(q) - 1] if q else []
                continue
            cut = next((i for i, x in enumerate(e) if x <= small * total or x == 0), None)
            if cut is not None:
                waiting.append((q[: cut + 1], e[:cut], total))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[-1] > 1.5 * q[0]:  # small ones belong at the end
                q.reverse()
                e.reverse()
            # The lesser value of the last two rows and columns, from above; steps that prove it too large are repeated.
            upper, lower = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1]
            mid, product = (upper + lower) / 2, upper * lower - q[-2] * e[-1]
            shift = max(0.0, min(product / (mid + np.sqrt(max(0.0, mid * mid - product))), q[-1])) if mid > 0 else 0.0
            for attempt in range(6):
                nq, ne, least, bad = _step(q, e, shift if attempt < 5 else 0.0)
                if bad < 0:
                    total += shift if attempt < 5 else 0.0
                    break
                # If only the last d is negative, shift + d bounds the least value from below.
                shift = max(0.0, shift + least) if bad == len(q) - 1 and attempt < 3 else shift / 4
            q, e = [max(x, 0.0) for x in nq], ne
    return np.sort(np.array(found))[::-1]


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, float, float]:
    """A vector z that solves (B'B - value) z = g e_k for the k of least |g|, of length 1; g and the length before."""
    n = len(a)
    diag, ratio, floor = (a * a).tolist(), (b / a[:-1]).tolist(), EPS * LEAST**0.5
    plus, minus, s, p = [0.0] * (n - 1), [0.0] * (n - 1), [0.0] * n, [0.0] * n
    s[0] = -value
    for i in range(n - 1):
        t = diag[i] + s[i]
        t = -floor if abs(t) < floor else t
        plus[i] = diag[i] * ratio[i] / t
        s[i + 1] = plus[i] * ratio[i] * s[i] - value
    p[n - 1] = diag[n - 1] - value
    for i in range(n - 2, -1, -1):
        t = diag[i] * ratio[i] ** 2 + p[i + 1]
        t = diag[i] / (floor if abs(t) < floor else t)
        minus[i] = ratio[i] * t
        p[i] = p[i + 1] * t - value
    g = [x + y + value for x, y in zip(s, p, strict=True)]
    k = min(range(n), key=lambda i: abs(g[i]))
    z = [0.0] * n
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -minus[i] * z[i]
    z = np.array(z)
    length = np.linalg.norm(z)
    return z / length, g[k], length


def vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Eigenvectors of B'B, as columns, of its leading values."""
    a = np.where(np.abs(a) < EPS * EPS, EPS * EPS, a)
    n, columns = len(a), []
    for j, value in enumerate(values):
        z, tried = None, float(value)
        if n == 1:
            columns.append(np.ones(1))
            continue
        for _ in range(4):
            z, g, length = twisted(a, b, tried)
            step = g / length**2
            if abs(step) <= 2 * EPS * value or abs(step) > 1e-6 * value:
                break
            tried += step
        near = [columns[i] for i in range(j) if values[i] - value <= CLOSE * values[i]]
        for _ in range(2):
            for c in near:
                z = z - (c @ z) * c
        size = np.linalg.norm(z)
        columns.append(z / size if size > 0.5 else _apart(a, b, value, near, j))
    return np.array(columns).T


def _apart(a: np.ndarray, b: np.ndarray, value: float, near: list, seed: int) -> np.ndarray:
    """Inverse iteration for a vector orthogonal to those found for values all but equal."""
    t = np.diag(a * a + np.concatenate([[0.0], b * b])) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    t -= value * (1 + 4 * EPS) * np.eye(len(a))
    z = np.random.default_rng(seed).standard_normal(len(a))
    for _ in range(4):
        for c in near * 2:
            z = z - (c @ z) * c
        z = np.linalg.solve(t, z / np.linalg.norm(z))
    for c in near * 2:
        z = z - (c @ z) * c
    return z / np.linalg.norm(z)


def directions(r: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Leading right singular vectors of r as columns, the squares of their singular values, and the sum of all squares."""
    size = np.abs(r).max(initial=0.0)
    if size == 0:
        return np.empty((r.shape[1], 0)), np.empty(0), 0.0
    square = np.zeros((r.shape[1],) * 2)
    square[: len(r)] = r / size
    a, b, right = bidiagonal(square)
    values = squared_values(a, b)
    chosen = values[:count][values[:count] > (len(a) * EPS) ** 2 * values[0] * 16]
    z = vectors(a, b, chosen)
    for k, v in reversed(right):
        z[k:] -= np.outer(2 * v, v @ z[k:])
    z *= np.sign(z[np.abs(z).argmax(axis=0), np.arange(z.shape[1])])
    return z, chosen * size**2, float(values.sum()) * size**2


# --- the work on Spark ---


def whole(table: DataFrame, dimension: int | None = None) -> DataFrame:
    """vec_id and x (array of longs) of the rows that remain of table (vec_id, embedding)."""
    c = lambda e: e.cast("double")
    good = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(c(e) * SCALE) < 2.0**62)
    kept = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.coalesce(F.forall("embedding", good), F.lit(False)) & (F.size("embedding") > 0))
    if dimension is None:
        most = kept.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
        dimension = most["size"] if most else 0
    return kept.filter(F.size("embedding") == dimension).select("vec_id", F.transform("embedding", lambda e: F.floor(c(e) * SCALE).cast("long") + SHIFT).alias("x"))


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """An Arrow list column as rows."""
    return np.asarray(column.flatten()).astype(kind, copy=False).reshape(len(column), -1)


def offsets(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exactly: in 64 bits where they suffice."""
    most = max(int(x.max()), -int(x.min()), 0)
    if n * most + max(map(abs, sums.tolist()), default=0) < 2**63:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors and sums per dimension, by partial sums of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), "int64")
                part = x.sum(axis=0) if int(np.abs(x).max()) * len(x) < 2**62 else x.astype(object).sum(axis=0)
                n, total = n + len(x), part.astype(object) if total is None else total + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total))), pa.array([n] * len(total)), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["place", "n", "total"])

    parts = fit.select("x").mapInArrow(run, "place long, n long, total decimal(38,0)")
    rows = parts.groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("place").collect()
    return (rows[0]["n"] if rows else 0), np.array([int(r["total"]) for r in rows], object)


def _packed(key: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([r.tobytes()], pa.binary())], ["part", "r"])


def triangle(fit: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows of fit (x)."""
    d = len(sums)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.empty((0, d))
        for batch in batches:
            for rows in (batch.slice(i, BLOCK) for i in range(0, batch.num_rows, BLOCK)):
                centred = offsets(matrix(rows.column(0), "int64"), n, sums).astype(float) / n
                r = np.linalg.qr(np.vstack([r, centred]), mode="r")
        if len(r):
            yield _packed(TaskContext.get().partitionId(), r)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.empty((0, d))
        for batch in batches:
            for part in batch.column("r").to_pylist():
                r = np.linalg.qr(np.vstack([r, np.frombuffer(part).reshape(-1, d)]), mode="r")
        yield _packed(key[0].as_py(), r)

    spark = fit.sparkSession
    found = publish(fit.select("x").mapInArrow(reduce, "part long, r binary"), scratch(spark, "triangles"))
    while (most := found.agg(F.max("part")).first()[0]) > 0:
        grouped = found.withColumn("part", F.floor(F.col("part") / FAN)).repartition(most // FAN + 1, "part")
        found = publish(grouped.groupBy("part").applyInArrow(merge, "part long, r binary"), scratch(spark, "triangles"))
    return np.frombuffer(found.first()["r"]).reshape(-1, d)


def _error(fit: DataFrame, n: int, sums: np.ndarray, w: np.ndarray) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity."""
    k = w.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, product = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for rows in (batch.slice(i, BLOCK) for i in range(0, batch.num_rows, BLOCK)):
                y = offsets(matrix(rows.column(0), "int64"), n, sums).astype(float) / n @ w
                total += y.sum(axis=0)
                product += y.T @ y
        values = [*total, *product.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values))), pa.array(values)], ["place", "value"])

    rows = fit.select("x").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()
    values = np.array([r["value"] for r in rows]) / n
    # Rows are centred before they are multiplied; what is left of their mean is rounding.
    return float(np.abs(values[k:].reshape(k, k) - np.outer(values[:k], values[:k]) - np.eye(k)).max())


def fitted(fit: DataFrame, count: int = COMPONENTS) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, float]:
    """n, sums, directions over their standard deviations (d x components), explained shares, and identity_error of fit
    (x), whose rows are distinct."""
    n, sums = _sums(fit)
    if not n:
        return 0, sums, np.empty((0, 0)), np.empty(0), 0.0
    z, squares, total = directions(triangle(fit, n, sums), count)
    w = z * np.sqrt(n / squares)
    return n, sums, w, squares / total if total else squares, _error(fit, n, sums, w) if len(squares) else 0.0


def whitened(table: DataFrame, count: int = COMPONENTS, dimension: int | None = None) -> DataFrame:
    """Rows of table (vec_id, embedding) by component: the columns of RESULT. deviation is exact; it outgrows a long beyond
    some 10 million vectors, hence its type."""
    spark = table.sparkSession
    kept = whole(table, dimension)
    n, sums, w, explained, error = fitted(publish(kept.select("x").distinct(), scratch(spark, "vectors")), count)
    k = w.shape[1]
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in (batch.slice(i, BLOCK) for i in range(0, batch.num_rows, BLOCK)):
                off = offsets(matrix(rows.column(1), "int64"), n, sums)
                far = int(np.abs(off).max())
                if far * far * off.shape[1] < 2**63:
                    deviation = pa.array((off.astype(np.int64) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
                else:
                    deviation = pa.array([Decimal(int(t)) for t in (off.astype(object) ** 2).sum(axis=1)], pa.decimal128(38, 0))
                m = len(off)
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [rows.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation.take(each), pa.array((off.astype(float) / n @ w).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, names)

    if not k:
        return spark.createDataFrame([], RESULT)
    return kept.mapInArrow(run, RESULT)


def report(table: DataFrame) -> DataFrame:
    """whitened, deviation as a long: an error if it doesn't fit, never a wrong number."""
    return whitened(table).withColumn("deviation", F.col("deviation").cast("long"))
