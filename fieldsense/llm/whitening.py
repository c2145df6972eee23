"""Whitening of embeddings by a covariance from variances alone.

Entries become integers, so that everything summed is exact. For every
dimension, and for the sum of every pair of dimensions, the squares of the
centred values are added up; a pair's covariance is half of what the variance
of its sum exceeds the two variances by (the polarisation identity). The
matrix is assembled from these and decomposed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry c counts as floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Rows whose sums are taken at once: their limbs' squares fit 64 bits.
ROWS = 4096
#: Entries of this size or more, scaled, are refused.
LARGEST = float(1 << 50)
_LIMB = 20


@dataclass
class Fit:
    """The exact sums over all vectors and the components by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def integers(column: pa.Array, dims: int, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    """The vectors of a list column without nulls as rows of integers."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    scaled = np.floor(c * scale)
    if scaled.size and np.abs(scaled).max() >= LARGEST:
        raise ValueError("an entry is too large for exact sums")
    return scaled.astype(np.int64) + offset


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: 64-bit where that holds it, else Python integers."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    away = x - base
    if x.size and (int(np.abs(away).max()) + 1) * n >= 1 << 61:
        return away.astype(object) * n - rest.astype(object)
    return away * n - rest


def square_sums(u: np.ndarray) -> list[int]:
    """The exact sum of squares of each column, of ``ROWS`` rows at most."""
    if not len(u):
        return [0] * u.shape[1]
    if u.dtype == object or np.abs(u).max() >= 1 << 45:
        return [int(v) for v in (u.astype(object) ** 2).sum(axis=0)]
    high, low = u >> _LIMB, u & ((1 << _LIMB) - 1)
    hh, hl, ll = (high * high).sum(axis=0), (high * low).sum(axis=0), (low * low).sum(axis=0)
    return [(int(a) << 2 * _LIMB) + (int(b) << _LIMB + 1) + int(c) for a, b, c in zip(hh, hl, ll)]


def _rows(batches: Iterator[pa.RecordBatch], column: int, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            yield part, integers(part.column(column), dims)


def usable(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, vector) of the rows whose vector has only finite entries, and
    the number of dimensions: of several, the one most rows have (of equally
    frequent ones the largest), and rows of another are dropped."""
    v = F.col("vector")
    own = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"))
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    own = own.where(v.isNotNull() & (F.size(v) > 0) & whole)
    most = own.groupBy(F.size(v).alias("dims")).count().orderBy(F.col("count").desc(), F.col("dims").desc()).first()
    dims = most["dims"] if most else 0
    return own.where(F.size(v) == dims), dims


def _decimal(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def fit(own: DataFrame, dims: int) -> Fit | None:
    """Components of (vec_id, vector); None without rows.

    Two passes: the sums, then the squares around them. A task hands on one row
    for each dimension or pair, which is also what reaches the driver."""
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for _, x in _rows(batches, 0, dims):
            n += len(x)
            total = [t + int(s) for t, s in zip(total, x.sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), _decimal(total)],
                                             names=["i", "n", "total"])

    sums = (own.select("vector").mapInArrow(totals, "i int, n bigint, total decimal(38,0)")
            .groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect())
    if not sums:
        return None
    n, sums = sums[0]["n"], [int(r["total"]) for r in sorted(sums, key=lambda r: r["i"])]

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_sums, pair_sums, seen = [0] * dims, [[0] * (dims - 1 - i) for i in range(dims)], False
        for _, x in _rows(batches, 0, dims):
            z, seen = centred(x, n, sums), True
            own_sums = [a + b for a, b in zip(own_sums, square_sums(z))]
            for i in range(dims - 1):
                pair_sums[i] = [a + b for a, b in zip(pair_sums[i], square_sums(z[:, i:i + 1] + z[:, i + 1:]))]
        if seen:
            at = [(i, i, s) for i, s in enumerate(own_sums)] + [(i, i + 1 + k, s) for i, p in enumerate(pair_sums) for k, s in enumerate(p)]
            i, j, s = zip(*at)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), _decimal(s)], names=["i", "j", "total"])

    found = (own.select("vector").mapInArrow(squares, "i int, j int, total decimal(38,0)")
             .groupBy("i", "j").agg(F.sum("total").alias("total")).collect())
    total = {(r["i"], r["j"]): int(r["total"]) for r in found}
    v = np.zeros((dims, dims))
    for (i, j), s in total.items():
        both = 2 * s if i == j else s - total[i, i] - total[j, j]  # twice the (co)variance of n * x, times n
        v[i, j] = v[j, i] = float(Fraction(both, 2 * n ** 3))
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(dims)])
    return Fit(n, sums, values, vectors * signs, float(np.trace(v)))


def _identity_error(own: DataFrame, dims: int, whitened, k: int, n: int) -> float:
    """The largest entry of the whitened vectors' covariance less the identity:
    a pass for their means, and one for the products around them."""
    def sums(batches: Iterator[pa.RecordBatch], means: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k if means is None else k * k)
        for _, x in _rows(batches, 0, dims):
            w = whitened(x)
            out += w.sum(axis=0) if means is None else ((w - means).T @ (w - means)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(out)], names=["i", "total"])

    def whole(means: np.ndarray | None = None) -> np.ndarray:
        rows = (own.select("vector").mapInArrow(lambda b: sums(b, means), "i int, total double")
                .groupBy("i").agg(F.sum("total").alias("total")).collect())
        return np.array([r["total"] for r in sorted(rows, key=lambda r: r["i"])]) / n

    covariance = whole(whole()).reshape(k, k)
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each row of ``rows`` with a finite vector and each of the first
    ``components`` components: vec_id, component (from 1), n, deviation (squared
    distance of n times the integer vector from the sums, exact, a decimal),
    whitened, explained (the component's share of the variance) and
    identity_error (the same everywhere).

    A component's sign is such that its largest entry is positive. A vector
    that is null, empty, or holds nulls or entries that aren't finite is
    dropped, and so is one of another length than most have; a null id stays;
    repeated rows count as often as they are there. Components without
    variance can't be whitened and have no rows, so equal vectors, a single
    one, and an empty table give none. Entries from 2 ** 40 on are refused.
    """
    spark = rows.sparkSession
    own, dims = usable(rows, id_col, vec_col)
    id_type = rows.schema[id_col].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(own, dims) if dims else None
    if model is None:
        return spark.createDataFrame([], schema)
    n, sums = model.n, model.sums
    least = max(model.values[0], 0.0) * dims * np.finfo(float).eps
    k = int(min(components, (model.values > least).sum()))
    if k == 0:
        return spark.createDataFrame([], schema)
    onto = model.vectors[:, :k] / np.sqrt(model.values[:k])
    explained = model.values[:k] / model.trace

    def whitened(x: np.ndarray) -> np.ndarray:
        return (centred(x, n, sums) / n).astype(np.float64) @ onto

    error = _identity_error(own, dims, whitened, k, n)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _rows(batches, 1, dims):
            at = np.repeat(np.arange(len(x)), k)
            far = square_sums_of_rows(centred(x, n, sums))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(at), n)), _decimal(far).take(pa.array(at)), pa.array(whitened(x).ravel()),
                 pa.array(np.tile(explained, len(x))), pa.array(np.full(len(at), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return own.mapInArrow(project, schema)


def square_sums_of_rows(z: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    out = []
    for at in range(0, z.shape[1], ROWS):
        part = square_sums(z[:, at:at + ROWS].T)
        out = part if not out else [a + b for a, b in zip(out, part)]
    return out


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings on their first eight whitened components; a deviation
    beyond 64 bits is null."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
