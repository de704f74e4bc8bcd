"""Whitening of embeddings by two passes over the rows.

Numbers become integers first, so sums are exact and the mean doesn't depend on
how rows are spread over tasks.  The second pass subtracts the mean before it
multiplies: a task adds up the products of its centred rows by blocks, one matrix of
d x d leaves it, and ``treeAggregate`` merges these.  The eigenvectors of the covariance,
which LAPACK finds on the driver, go to every task as a d x k projection.

What a task and the driver hold is d x d numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.scratch import stage
from lodestar.llm.words import give_back

#: A number c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Numbers of a block of rows.
BLOCK_NUMBERS = 2_000_000
#: Numbers from here on don't become exact integers; they count as non-finite.
LARGEST = float(1 << 51)
#: A deviation of more digits than a decimal has is null.
_DIGITS = 10**38


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their integers as a matrix) for valid rows of one length each; ``column`` holds arrays of doubles."""
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = batch.column(column)
        flat = vectors.flatten()
        numbers = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null is NaN
        sizes = np.where(np.asarray(vectors.is_valid()), np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False)), 0).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        bad = np.concatenate([[0], np.cumsum(~(np.abs(numbers) < LARGEST))])
        valid = (sizes > 0) & (bad[starts + sizes] == bad[starts])
        for dim in np.unique(sizes[valid]).tolist():
            rows = np.flatnonzero(valid & (sizes == dim))
            step = max(1, BLOCK_NUMBERS // dim)
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                x = numbers[starts[some][:, None] + np.arange(dim)]
                yield batch.take(pa.array(some)), np.floor(SCALE * x).astype(np.int64) + SHIFT
    give_back()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vectors -> (dim, rows, sums of the upper and of the lower 32 bits of each dimension)."""
    found: dict[int, tuple[int, np.ndarray]] = {}
    for _, x in _blocks(batches, 0):
        n, total = found.get(x.shape[1], (0, 0))
        found[x.shape[1]] = (n + len(x), total + np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]))
    dims = list(found)
    yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array([found[d][0] for d in dims], pa.int64()), pa.array([found[d][1].tobytes() for d in dims], pa.binary())], ["dim", "n", "sums"])


@dataclass(frozen=True)
class Mean:
    """Exact mean of n rows: ``whole + rest / n`` per dimension, with 0 <= rest < n."""

    n: int
    whole: np.ndarray
    rest: tuple[int, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - sum)^2 for each row, exactly."""
        gap = x - self.whole
        most = self.n * (int(np.abs(gap).max(initial=0)) + 1)
        if most * most * x.shape[1] < 1 << 63:
            return ((self.n * gap - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        return ((self.n * gap.astype(object) - np.array(self.rest, object)) ** 2).sum(axis=1).tolist()


def exact_mean(vectors: DataFrame) -> tuple[int, Mean] | None:
    """(length, mean) of the vectors of the most common length, the shorter of two as common; None without any."""
    sums = stage(vectors.mapInArrow(_sums, "dim int, n long, sums binary"), "whitening-sums")
    top = sums.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not top:
        return None
    dim, n = top[0]

    def exact(raw: bytes) -> np.ndarray:
        high, low = np.frombuffer(raw, np.int64).reshape(2, -1).astype(object)
        return high * (1 << 32) + low

    total = sums.where(F.col("dim") == dim).select("sums").rdd.map(lambda r: exact(r[0])).treeAggregate(np.zeros(dim, object), np.add, np.add)
    return dim, Mean(n, np.array([s // n for s in total], np.int64), tuple(int(s % n) for s in total))


def _outer(dim: int, mean: Mean):
    """vectors -> one d x d matrix: the sum of the products of centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for _, x in _blocks(batches, 0):
            if x.shape[1] == dim:
                c = mean.centred(x)
                total += c.T @ c
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def covariance(vectors: DataFrame, dim: int, mean: Mean) -> np.ndarray:
    """Covariance of the rows of length ``dim``, divisor n."""
    parts = vectors.mapInArrow(_outer(dim, mean), "sums binary").rdd.map(lambda r: np.frombuffer(r[0]).reshape(dim, dim))
    return parts.treeAggregate(np.zeros((dim, dim)), np.add, np.add) / mean.n


@dataclass(frozen=True)
class Projection:
    """``matrix`` takes centred rows to whitened ones; ``explained`` is each component's share of the variance."""

    matrix: np.ndarray
    explained: list[float]


def components(v: np.ndarray, k: int) -> Projection:
    """The first k eigenvectors over the root of their eigenvalues, NaN where an eigenvalue is 0 but for rounding."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    trace = float(np.trace(v))
    some = values > len(v) * np.finfo(np.float64).eps * max(trace, 0)
    root = np.sqrt(np.where(some, values, np.nan))
    return Projection(vectors / root, [float(e) / trace if s else 0.0 for e, s in zip(values, some)])


def _project(dim: int, mean: Mean, projection: Projection):
    """(id, vector) -> (id, deviation, whitened numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in _blocks(batches, 1):
            if x.shape[1] != dim:
                continue
            y = mean.centred(x) @ projection.matrix
            flat = pa.array(np.ascontiguousarray(y).ravel(), from_pandas=True)  # NaN is null
            white = pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1], np.int32), flat)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([Decimal(v) if v < _DIGITS else None for v in mean.deviation(x)], pa.decimal128(38, 0)), white], ["id", "deviation", "whitened"])

    return run


def _spread(k: int):
    """whitened rows -> (n, mean, sum of products of centred rows) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (0, np.zeros(k), np.zeros((k, k)))
        for batch in batches:
            if batch.num_rows:
                y = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                centre = y.mean(axis=0)
                state = _merge(state, (len(y), centre, (y - centre).T @ (y - centre)))
        yield pa.RecordBatch.from_arrays([pa.array([state[0]], pa.int64()), pa.array([state[1].tobytes()], pa.binary()), pa.array([state[2].tobytes()], pa.binary())], ["n", "mean", "products"])

    return run


def _merge(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def identity_error(whitened: DataFrame, k: int) -> float | None:
    """Largest absolute entry of the covariance of ``whitened`` (one array column) minus the identity; null numbers are left out with their component."""
    rows = whitened.mapInArrow(_spread(k), "n long, mean binary, products binary").rdd.map(lambda r: (r[0], np.frombuffer(r[1]), np.frombuffer(r[2]).reshape(k, k)))
    n, _, products = rows.treeAggregate((0, np.zeros(k), np.zeros((k, k))), _merge, _merge)
    gap = np.abs(products / max(n, 1) - np.eye(k))
    return None if np.isnan(gap).all() else float(np.nanmax(gap))


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 8) -> DataFrame:
    """``(id_col, n, deviation, whitened, explained, identity_error)`` per row; arrays have a number for each of k components.

    Rows are left out if the vector is null, empty, holds null or non-finite numbers or
    numbers of 2^51 or more, or isn't of the most common length (the shorter of two as common).
    ``n`` is the number of other rows; a ``deviation`` of more than 38 digits is null.  Fewer dimensions than k give as many components.
    A component without variance (equal vectors, or fewer vectors than components) has null
    numbers and explains 0; ``identity_error`` is over the others, null without any.  Null ids stay, repeated
    rows count each, an empty table gives an empty table, and other columns are ignored.
    """
    kind = T.ArrayType(T.DoubleType())
    vectors = df.select(F.col(vector).cast(kind).alias("v"))
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", kind)])
    found = exact_mean(vectors)
    if found is None:
        none = df.sparkSession.createDataFrame([], schema)
        return none.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n"), "deviation", "whitened", F.col("whitened").alias("explained"), F.lit(None).cast("double").alias("identity_error"))
    dim, mean = found
    projection = components(covariance(vectors, dim, mean), min(k, dim))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast(kind).alias("v")).mapInArrow(_project(dim, mean, projection), schema)
    rows = stage(rows, "whitened")
    error = identity_error(rows.select("whitened"), min(k, dim))
    return rows.select(
        F.col("id").alias(id_col), F.lit(mean.n).cast("long").alias("n"), "deviation", "whitened", F.array(*map(F.lit, projection.explained)).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
