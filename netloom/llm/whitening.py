"""Whitening of embeddings on the leading principal components, found by spectrum slicing.

Vectors become whole numbers, so that counts, sums and products of centred entries are exact, in any order. The
covariance is summed on the executors over distinct vectors, centred at whole numbers next to the means; only it, as many numbers
as the square of a vector's length, comes to the driver. There

* the inertia of the covariance less a shift, read off the pivots of its LDL' factors (diagonal pivots of one and two
  rows), counts the eigenvalues above the shift; halving intervals isolates each of the leading ones;
* inverse iteration in such an interval, then Rayleigh quotient iteration, whose convergence is cubic, finds value and vector; a result
  outside the interval is discarded and the interval halved again. Eigenvalues too close to be told apart are
  found together, by block iteration;
* counts just above and below each result certify its number.

Rows are then projected where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import materialize
from .common import bounded_batches, table

#: Steps of the grid that entries are rounded down to, what is added, components returned.
STEPS, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Longest vectors whose covariance the driver may hold.
MOST_DIMS = 2_048
#: Whole numbers up to this size are exact as doubles, as are sums of products of the smaller ones over a batch.
EXACT, SMALL = 1 << 53, 1 << 21

EPS = np.finfo(float).eps


def grid_vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x``: each entry c as floor(64 c) + 1,000,000.

    Rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do those with an entry beyond what a
    double counts exactly (about 1.4e14).
    """
    scaled = F.transform(df[vector_column].cast("array<double>"), lambda c: c * STEPS)
    rows = df.select(df[id_column].alias("vec_id"), scaled.alias("v")).filter("v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < EXACT - 2 * OFFSET))
    return rows.filter(fine).select("vec_id", F.transform("v", lambda c: F.floor(c).cast("bigint") + OFFSET).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _exact(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows of ``fit`` and the sums of its dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for batch in batches:
            n += batch.num_rows
            total += _matrix(batch.column(0), dims).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), _exact(total)], ["i", "n", "s"])

    rows = fit.mapInArrow(run, "i int, n bigint, s decimal(38,0)").groupBy("i").agg(F.sum("n"), F.sum("s")).orderBy("i").collect()
    return (rows[0][1], [int(r[2]) for r in rows]) if rows else (0, [])


def _products(fit: DataFrame, centre: list[int]) -> list[list[int]]:
    """Sums over ``fit`` of the products of all dimensions less ``centre``."""
    dims, at = len(centre), np.array(centre)
    i, j = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part, rows = np.zeros((dims, dims), object), np.zeros((dims, dims), np.int64), 0
        for batch in batches:
            y = _matrix(batch.column(0), dims) - at
            for lo in range(0, len(y), 512):
                some = y[lo : lo + 512]
                if np.abs(some).max(initial=0) >= SMALL:
                    total += some.astype(object).T @ some.astype(object)
                    continue
                part += (some.T.astype(float) @ some.astype(float)).astype(np.int64)  # below 2^51: exact
                rows += 1
                if rows == 1 << 11:
                    total, part, rows = total + part, np.zeros((dims, dims), np.int64), 0
        total += part
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), _exact(total[i, j])], ["i", "j", "dot"])

    out = [[0] * dims for _ in range(dims)]
    for a, b, dot in fit.mapInArrow(run, "i int, j int, dot decimal(38,0)").groupBy("i", "j").agg(F.sum("dot")).collect():
        out[a][b] = out[b][a] = int(dot)
    return out


def positive_pivots(a: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are positive: the inertia of D in its LDL' factors (Bunch and Kaufman's pivots)."""
    a, n, k, found = a.copy(), len(a), 0, 0
    bound = (1 + 17**0.5) / 8
    while k < n:
        wide, column = 1, np.abs(a[k + 1 :, k])
        if len(column) and (most := column.max()) > 0 and abs(a[k, k]) < bound * most:
            r = k + 1 + int(column.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            top = row.max()
            if abs(a[k, k]) * top < bound * most * most:
                wide, at = (1, k) if abs(a[r, r]) >= bound * top else (2, k + 1)
                a[[at, r]] = a[[r, at]]
                a[:, [at, r]] = a[:, [r, at]]
        if wide == 1:
            pivot = a[k, k]
            found += int(pivot > 0)
            if pivot:
                a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k] / pivot, a[k + 1 :, k])
        else:  # such a pair of rows has one eigenvalue of each sign
            found += 1
            a[k + 2 :, k + 2 :] -= a[k + 2 :, k : k + 2] @ np.linalg.solve(a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2].T)
        k += wide
    return found


def _solved(a: np.ndarray, b: np.ndarray, nudge: float) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        return np.linalg.solve(a + nudge * np.eye(len(a)), b)


def leading_eigenpairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    d = len(v)
    eye, scale = np.eye(d), float(np.abs(v).sum(axis=1).max())
    k, tiny = min(k, d), 8 * d * EPS * scale
    if not scale:
        return np.zeros(k), eye[:, :k]
    above = lambda shift: positive_pivots(v - shift * eye)
    rng = np.random.default_rng(7)
    values, vectors = [], np.empty((d, 0))
    open_ = [(-scale - tiny, scale + tiny, d, 0)]  # from, to, eigenvalues above each end; the uppermost interval last
    while open_ and len(values) < k:
        lo, hi, to, first = open_.pop()
        if to == first:
            continue
        middle = (lo + hi) / 2
        if to - first > 1 and hi - lo > tiny:
            cut = min(max(above(middle), first), to)
            open_ += [(lo, middle, to, cut), (middle, hi, cut, first)]
            continue
        block = rng.standard_normal((d, to - first))
        block -= vectors @ (vectors.T @ block)
        for _ in range(3):
            block = np.linalg.qr(_solved(v - middle * eye, block, tiny))[0]
        if to - first == 1:
            w = block[:, 0]
            for _ in range(12):
                value = float(w @ v @ w)
                if np.linalg.norm(v @ w - value * w) <= EPS * scale:
                    break
                w = _solved(v - value * eye, w, EPS * scale)
                w /= np.linalg.norm(w)
            value, block = float(w @ v @ w), w[:, None]
            if not lo - tiny <= value <= hi + tiny and hi - lo > tiny:  # another eigenvalue was nearer
                cut = min(max(above(middle), first), to)
                open_ += [(lo, middle, to, cut), (middle, hi, cut, first)]
                continue
            found = [value]
        else:
            found, turn = np.linalg.eigh(block.T @ v @ block)
            found, block = found[::-1].tolist(), block @ turn[:, ::-1]
        values += found
        vectors = np.column_stack([vectors, block])
    vectors = np.linalg.qr(vectors)[0][:, :k]
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    for i, value in enumerate(values):
        if above(value + 4 * tiny) > i or above(value - 4 * tiny) < i + 1:
            raise ArithmeticError(f"component {i + 1} can't be numbered")
    return values, vectors


def _projected(batch_x: np.ndarray, centre: np.ndarray, rest: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(x - S/n) by component; ``rest`` is S/n - centre."""
    return ((batch_x - centre).astype(float) - rest) @ weights


def _identity_error(fit: DataFrame, centre: np.ndarray, rest: np.ndarray, weights: np.ndarray, n: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    dims, k = weights.shape
    i, j = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, total = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = _projected(_matrix(batch.column(0), dims), centre, rest, weights)
            square += w.T @ w
            total += w.sum(axis=0)
        a, b = np.concatenate([i, np.full(k, -1)]), np.concatenate([j, np.arange(k)])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(np.concatenate([square[i, j], total]))], ["i", "j", "s"])

    sums = {(r[0], r[1]): r[2] / n for r in fit.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s")).collect()}
    return max(abs(sums[a, b] - sums[-1, a] * sums[-1, b] - (a == b)) for a, b in zip(i.tolist(), j.tolist()))


def whiten(df: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Rows of ``df`` by component: ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Covariances are over distinct vectors (``n`` of them, sums S). ``deviation`` is the sum over dimensions of (n x - S)^2, exact; null
    beyond a long. ``whitened`` is x - S/n on the component over the root of its eigenvalue, ``explained`` the eigenvalue's
    share of the trace. Only eigenvalues above rounding (those of a rank) are components, so that one distinct vector alone gives an empty
    result, as an empty table does. See ``grid_vectors`` for rows that take no part; vectors of another length than the most
    frequent one (ties: the shortest) don't either. A null id keeps its rows; repeated rows have rows each. Vectors longer than
    ``MOST_DIMS`` raise. Other columns are not read.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    kind = df.schema[id_column].dataType
    schema = f"vec_id {kind.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = grid_vectors(df, id_column, vector_column)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims = lengths["d"]
    if dims > MOST_DIMS:
        raise ValueError(f"vectors longer than {MOST_DIMS}")
    rows = rows.filter(F.size("x") == dims)
    fit = materialize(rows.select("x").distinct(), "fit")
    n, sums = _sums(fit, dims)
    middle = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle)]
    dots = _products(fit, middle)
    covariance = np.array([[(n * dots[i][j] - rest[i] * rest[j]) / (n * n) for j in range(dims)] for i in range(dims)])
    values, vectors = leading_eigenpairs(covariance, components)
    k = int((values > 8 * dims * EPS * max(float(np.trace(covariance)), 0.0)).sum())
    if not k:
        return spark.createDataFrame([], schema)
    trace = sum(n * dots[i][i] - rest[i] ** 2 for i in range(dims)) / (n * n)
    explained, weights = values[:k] / trace, vectors[:, :k] / np.sqrt(values[:k])
    centre, off = np.array(middle), np.array([r / n for r in rest])
    error = _identity_error(fit, centre, off, weights, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(rest, object)
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            y = x - centre
            if float(np.abs(y).max(initial=0) + 1) ** 2 * n * n * dims < 2.0**62:
                deviation = pa.array(((y * n - whole.astype(np.int64)) ** 2).sum(axis=1))
            else:
                sizes = ((y.astype(object) * n - whole) ** 2).sum(axis=1)
                deviation = pa.array([s if s < 1 << 63 else None for s in sizes], pa.int64())
            at = pa.array(np.repeat(np.arange(len(x)), k))
            many = len(at)
            fixed = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(many, n))]
            rest_ = [pa.array(_projected(x, centre, off, weights).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(many, error))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at).cast(to_arrow_type(kind)), *fixed, deviation.take(at), *rest_], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the leading 16 components, whitened."""
    return whiten(table(spark, sf_dir, "embeddings"))
