"""Training: k-means, product and residual codebooks, rotations, inverted files, autoencoder, PCA.

Sums over rows are Spark aggregations: each task reduces its batches to one partial
result of a size that the model fixes (centroids, a d x d matrix, gradients), and only
those are added up.  Starting points come from a sample by hash of the id, so a run
doesn't depend on how rows are split.

Training takes the finite vectors of the most common length and leaves other rows out; a
table without any is an error (``ValueError``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.scan import by_length, row_slices
from lodestar.operators.search import pq_assign
from lodestar.session import dimension, valid

#: Rows that starting points are chosen from, or twice the number of centroids if that is more.
START_ROWS = 4_096
#: Centroids up to which a sample gives the starting points; for more of them all rows do.
SAMPLED_STARTS = 256
#: Rows for each centroid that a cell of a tree is trained on at most, and cells that a row looks for its centroid in.
CELL_SAMPLE, LOOKED_IN = 64, 4
#: Partial sums that reach the driver at most.
PARTIAL_SUMS = 64


def starting_rows(df: DataFrame, dims: int, rows: int, seed: int = 0) -> np.ndarray:
    """Vectors of length ``dims`` with the smallest hashes of their ids: at most ``rows``."""
    picked = valid(df.select("id", "vec"), dims).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(rows).collect()
    if not picked:
        raise ValueError("no finite vector to start from")
    return np.array([r["vec"] for r in picked], np.float64)


def summed(df: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], dims: int) -> np.ndarray:
    """Sum over the finite vectors of length ``dims`` of ``part(rows)``, an array of fixed shape.

    A task gives one row, and these are added in groups before the driver adds the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        acc = np.zeros(shape)
        for batch in batches:
            for n, _, x in by_length(batch.column(0)):
                if n == dims and len(x):
                    acc += part(x)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % PARTIAL_SUMS], pa.int32()), pa.array([acc.tobytes()], pa.binary())], ["at", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(int(np.prod(shape)))
        for one in group.column("sums").to_pylist():
            total += np.frombuffer(one)
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    rows = df.select("vec").mapInArrow(run, "at int, sums binary").groupBy("at").applyInArrow(add, "sums binary").collect()
    return sum((np.frombuffer(bytes(r["sums"])) for r in rows), np.zeros(int(np.prod(shape)))).reshape(shape)


def plus_plus(x: np.ndarray, k: int, seed: int, weight: np.ndarray | None = None) -> np.ndarray:
    """k-means++ starting points; a row counts as often as its weight says."""
    rng = np.random.default_rng(seed)
    w = np.ones(len(x)) if weight is None else weight
    first = rng.integers(len(x)) if weight is None else rng.choice(len(x), p=w / w.sum())
    chosen = [x[first]]
    near = ((x - chosen[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)):
        mass = near * w
        p = mass / mass.sum() if mass.sum() > 0 else np.full(len(x), 1 / len(x))
        chosen.append(x[rng.choice(len(x), p=p)])
        near = np.minimum(near, ((x - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def oversampled(df: DataFrame, k: int, dims: int, change: Callable[[np.ndarray], np.ndarray], seed: int, rounds: int = 4) -> np.ndarray:
    """k-means|| starting points: every round takes rows with a chance in proportion to their distance from what is taken so far.

    A round reads all rows and takes about k of them, by a hash of the id; a row is then weighed by
    the rows that it is nearest to, and k-means++ picks k of the few times k that were taken.
    """
    taken = change(starting_rows(df, dims, 1, seed))
    kind = dict(df.dtypes)["id"]
    for i in range(rounds):
        now = taken

        def gaps(x: np.ndarray) -> np.ndarray:
            return ((x - now[nearest(x, now)]) ** 2).sum(1)  # noqa: B023

        cost = float(summed(df, lambda x: gaps(change(x)).sum(), (), dims))  # noqa: B023
        if cost <= 0:
            break

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, at, x in by_length(batch.column(2)):
                    if n == dims and len(x):
                        u = batch.column(1).to_numpy()[at]
                        some = at[u * cost < k * gaps(change(x))]  # noqa: B023
                        yield batch.select([0, 2]).take(pa.array(some))

        u = (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(1 << 30)) + 0.5) / (1 << 30)
        vec = dict(df.dtypes)["vec"]
        rows = df.select("id", u.alias("u"), "vec").mapInArrow(pick, f"id {kind}, vec {vec}").orderBy(F.xxhash64("id"), "id").limit(4 * k).collect()  # about ``k``
        if rows:
            taken = np.vstack([taken, change(np.array([r["vec"] for r in rows], np.float64))])
    last = taken
    weight = summed(df, lambda x: np.bincount(nearest(change(x), last), minlength=len(last)).astype(float), (len(last),), dims)
    return plus_plus(taken, k, seed, np.maximum(weight, 1e-9))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The closest centroid of each row, a bounded block of products at a time."""
    norms, out = (centroids * centroids).sum(1)[None], np.zeros(len(x), np.int64)
    for s in row_slices(x, len(centroids)):
        out[s] = (norms - 2 * x[s] @ centroids.T).argmin(1)
    return out


def kmeans(df: DataFrame, k: int, rounds: int = 15, seed: int = 0, tolerance: float = 1e-6, transform: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Centroids of Lloyd's algorithm over all rows; an empty cluster keeps its centroid.

    There are ``k``, or as many as vectors with distinct ids if those are fewer.
    """
    change, dims = transform or (lambda x: x), dimension(df)
    if k > SAMPLED_STARTS:
        cents = oversampled(df, k, dims, change, seed)
    else:
        cents = plus_plus(change(starting_rows(df, dims, max(START_ROWS, 2 * k), seed)), k, seed)
    width = cents.shape[1]
    for _ in range(rounds):
        now = cents

        def part(x: np.ndarray) -> np.ndarray:
            x = change(x)
            near = nearest(x, now)
            acc = np.zeros((len(now), width + 1))
            np.add.at(acc, near, np.hstack([x, np.ones((len(x), 1))]))
            return acc

        acc = summed(df, part, (len(cents), width + 1), dims)
        cents = np.where(acc[:, -1:] > 0, acc[:, :-1] / np.maximum(acc[:, -1:], 1), cents)
        if np.abs(cents - now).max() < tolerance:
            break
    return cents


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=x.copy(), where=n > 0)


def clusters(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(id, cluster)`` by nearest centroid, of the finite vectors of the centroids' length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, at, x in by_length(batch.column(1)):
                if n == centroids.shape[1]:
                    near = nearest(x, centroids)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(near.astype(np.int32))], ["id", "cluster"])

    return df.select("id", "vec").mapInArrow(run, f"id {dict(df.dtypes)['id']}, cluster int")


@dataclass(frozen=True)
class CentroidTree:
    """Many centroids under few: a row looks among the children of the ``LOOKED_IN`` nearest of ``coarse``.

    ``fine`` is sorted by parent; children of parent p are ``fine[starts[p]:starts[p + 1]]``.
    """

    coarse: np.ndarray
    fine: np.ndarray
    starts: np.ndarray

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Number of the nearest looked-at centroid of each row; products are bounded blocks."""
        best, gap = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        norms = (self.coarse * self.coarse).sum(1)[None]
        near = np.zeros((len(x), min(LOOKED_IN, len(self.coarse))), np.int64)
        for s in row_slices(x, len(self.coarse)):
            near[s] = np.argsort(norms - 2 * x[s] @ self.coarse.T, axis=1, kind="stable")[:, : near.shape[1]]
        for p in np.unique(near).tolist():
            rows = np.flatnonzero((near == p).any(axis=1))
            children = self.fine[self.starts[p] : self.starts[p + 1]]
            if not len(children):
                continue
            own = (children * children).sum(1)[None]
            for s in row_slices(rows, len(children)):
                d = own - 2 * x[rows[s]] @ children.T
                at = d.argmin(axis=1)
                least = d[np.arange(len(at)), at]
                better = least < gap[rows[s]]
                best[rows[s][better]], gap[rows[s][better]] = at[better] + self.starts[p], least[better]
        return best

    def assign(self, df: DataFrame, out: str = "list_id", transform: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
        """``df`` with ``out``; rows without a finite vector of the centroids' length are left out."""
        from pyspark.sql import types as T

        rows, change = df.drop(out), transform or (lambda x: x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, at, x in by_length(batch.column("vec")):
                    if n == self.coarse.shape[1] and len(x):
                        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(self.nearest(change(x)).astype(np.int32))], [*batch.schema.names, out])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.IntegerType())]))

    def centroids(self, df: DataFrame) -> DataFrame:
        """``(list_id, centroid)``, in the session of ``df``."""
        return df.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(self.fine)], "list_id int, centroid array<double>")


def tree_train(df: DataFrame, k: int, rounds: int = 10, seed: int = 0, transform: Callable[[np.ndarray], np.ndarray] | None = None) -> CentroidTree:
    """About k centroids in two levels: the root of k from all rows, then in each cell its share, on a bounded sample of it.

    Cells are trained apart from each other, each in one group of at most ``CELL_SAMPLE`` rows a centroid.
    """
    change, dims = transform or (lambda x: x), dimension(df)
    coarse = kmeans(df, max(1, round(k**0.5)), rounds, seed, transform=transform)
    cells = CentroidTree(coarse, coarse, np.arange(len(coarse) + 1)).assign(df.select("id", "vec"), "cell", transform)
    sizes = {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()}  # a row per coarse centroid
    total = sum(sizes.values())
    share = {c: max(1, round(k * n / total)) for c, n in sizes.items()}
    # A row is in the sample by a hash of its id, with twice the chance that gives the bound.
    wanted = df.sparkSession.createDataFrame([(c, share[c], min(1.0, 2 * CELL_SAMPLE * share[c] / n)) for c, n in sizes.items()], "cell int, share int, chance double")
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    some = cells.join(F.broadcast(wanted), "cell").where(u < F.col("chance"))
    w = Window.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    some = some.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= CELL_SAMPLE * F.col("share")).select("cell", "share", "vec")

    def grow(group: pa.Table) -> pa.Table:
        cell, own = group.column("cell")[0].as_py(), group.column("share")[0].as_py()
        x = np.vstack([change(m) for _, _, m in by_length(group.column("vec").combine_chunks())])
        c = plus_plus(x, min(own, len(x)), seed)
        for _ in range(rounds):
            at, sums = nearest(x, c), np.zeros_like(c)
            np.add.at(sums, at, x)
            n = np.bincount(at, minlength=len(c))[:, None]
            c = np.where(n > 0, sums / np.maximum(n, 1), c)
        return pa.table({"cell": pa.array([cell] * len(c), pa.int32()), "at": pa.array(range(len(c)), pa.int32()), "centroid": pa.array(c.tolist(), pa.list_(pa.float64()))})

    grown = some.groupBy("cell").applyInArrow(grow, "cell int, at int, centroid array<double>").orderBy("cell", "at").collect()  # about ``k``
    counts = np.bincount([r["cell"] for r in grown], minlength=len(coarse))
    return CentroidTree(coarse, np.array([r["centroid"] for r in grown]).reshape(-1, dims if transform is None else coarse.shape[1]), np.concatenate([[0], np.cumsum(counts)]))


def ivf_train(df: DataFrame, lists: int, rounds: int = 15, seed: int = 0) -> DataFrame:
    """``(list_id, centroid)`` of unit vectors."""
    cents = kmeans(df, lists, rounds, seed, transform=unit_rows)
    return df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(cents)], "list_id int, centroid array<double>")


# Codebooks ---------------------------------------------------------------------------


def pq_train(df: DataFrame, parts: int, k: int = 256, rounds: int = 10, seed: int = 0, transform: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Codebook (parts, k, width): k-means in every sub-space, all sub-spaces in one pass over the rows a round."""
    change, dims = transform or (lambda x: x), dimension(df)
    start = change(starting_rows(df, dims, max(START_ROWS, 2 * k), seed))
    if start.shape[1] % parts:
        raise ValueError(f"{start.shape[1]} dimensions don't divide into {parts} parts")
    width, k = start.shape[1] // parts, min(k, len(start))
    book = np.stack([plus_plus(start[:, i * width : (i + 1) * width], k, seed + i) for i in range(parts)])
    for _ in range(rounds):
        now = book

        def part(x: np.ndarray) -> np.ndarray:
            x = change(x)
            codes, acc = pq_assign(x, now), np.zeros((parts, k, width + 1))
            for i in range(parts):
                np.add.at(acc[i], codes[:, i], np.hstack([x[:, i * width : (i + 1) * width], np.ones((len(x), 1))]))
            return acc

        acc = summed(df, part, (parts, k, width + 1), dims)
        book = np.where(acc[..., -1:] > 0, acc[..., :-1] / np.maximum(acc[..., -1:], 1), book)
        if np.abs(book - now).max() < 1e-6:
            break
    return book


def pq_restore(codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.concatenate([book[i][codes[:, i]] for i in range(len(book))], axis=1)


def opq_train(df: DataFrame, parts: int, k: int = 256, turns: int = 5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, codebook): a random rotation, then in turn a codebook and the best rotation for it.

    The rotation comes from the SVD of the d x d cross product of vectors and their
    decoded forms, which is summed over all rows.
    """
    dims = dimension(df)
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    book = None
    for _ in range(turns):
        turned = rotation
        book = pq_train(df, parts, k, 4, seed, lambda x: x @ turned)

        def part(x: np.ndarray) -> np.ndarray:
            y = x @ turned
            return x.T @ pq_restore(pq_assign(y, book), book)

        u, _, v = np.linalg.svd(summed(df, part, (dims, dims), dims))
        rotation = u @ v
    final = rotation
    return rotation, pq_train(df, parts, k, 4, seed, lambda x: x @ final)


@dataclass(frozen=True)
class ResidualCodebook:
    """Codebooks of successive passes; vectors are padded with zeros to a multiple of the parts."""

    books: tuple[np.ndarray, ...]
    dims: int

    def pad(self, x: np.ndarray) -> np.ndarray:
        width = self.books[0].shape[0] * self.books[0].shape[2] if self.books else x.shape[1]
        return np.pad(x, ((0, 0), (0, width - x.shape[1])))

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(rows, passes, parts)"""
        rest, out = self.pad(x), []
        for b in self.books:
            codes = pq_assign(rest, b)
            out.append(codes)
            rest = rest - pq_restore(codes, b)
        return np.stack(out, axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(pq_restore(codes[:, i], b) for i, b in enumerate(self.books))[:, : self.dims]


def rq_train(df: DataFrame, passes: int, parts: int, k: int = 256, rounds: int = 6, seed: int = 0) -> ResidualCodebook:
    dims = dimension(df)
    width = -(-dims // parts) * parts
    books: tuple[np.ndarray, ...] = ()
    for i in range(passes):
        done = books

        def rest(x: np.ndarray) -> np.ndarray:
            x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
            for b in done:
                x = x - pq_restore(pq_assign(x, b), b)
            return x

        books = (*books, pq_train(df, parts, k, rounds, seed + i, rest))
    return ResidualCodebook(books, dims)


def mapped(df: DataFrame, change: Callable[[np.ndarray], np.ndarray], out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the vectors after a function of whole batches.

    The function gets the finite vectors of the most common length; ``out`` of other rows is null.
    """
    from pyspark.sql import types as T

    rows = df.drop(out)
    dims = dimension(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.nulls(batch.num_rows, pa.list_(pa.float32()))
            for n, at, x in by_length(batch.column("vec")):
                if n == dims and len(x):
                    y = np.ascontiguousarray(change(x), np.float32)
                    made = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
                    place = np.full(batch.num_rows, -1)
                    place[at] = np.arange(len(at))
                    lists = made.take(pa.array(place, mask=place < 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def bf16(x: np.ndarray) -> np.ndarray:
    """16-bit brain floats (as unsigned), nearest with halves to even."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
    return ((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype(np.uint16)


def bf16_restore(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.uint32) << 16).view(np.float32)


def nf4_mixed(x: np.ndarray, outliers: list[int]) -> np.ndarray:
    """Vectors after half precision for the outlier dimensions and NF4 for the others."""
    from lodestar.operators.codecs import NF4_LEVELS, nf4_thresholds

    x = np.ascontiguousarray(x, np.float32)
    out, rest = x.copy(), [i for i in range(x.shape[1]) if i not in set(outliers)]
    if rest:
        y = x[:, rest]
        scale = np.abs(y).max(axis=1, keepdims=True)
        codes = np.searchsorted(np.array(nf4_thresholds(), np.float32), y / np.where(scale == 0, np.float32(1), scale))
        out[:, rest] = np.array(NF4_LEVELS, np.float32)[codes] * scale
    out[:, outliers] = x[:, outliers].astype(np.float16)
    return out


# Autoencoder, PCA ----------------------------------------------------------------------


@dataclass
class Autoencoder:
    """Two-layer ReLU encoder and decoder of unit vectors with 8-bit codes."""

    weights: list[np.ndarray]
    scale: float = 1.0

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(unit_rows(x) @ self.weights[0], 0) @ self.weights[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(self.hidden(x) / self.scale * 127), -127, 127).astype(np.int8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return unit_rows(np.maximum(codes.astype(np.float64) * self.scale / 127 @ self.weights[2], 0) @ self.weights[3])


def _gradients(model: Autoencoder, x: np.ndarray) -> np.ndarray:
    """Flat gradients of the summed cosine loss, then the loss and the largest code."""
    a, b, c, d = model.weights
    x = unit_rows(x)
    h1 = x @ a
    r1 = np.maximum(h1, 0)
    z = r1 @ b
    h2 = z @ c
    r2 = np.maximum(h2, 0)
    y = r2 @ d
    n = np.linalg.norm(y, axis=1, keepdims=True) + 1e-9
    cos = (x * y).sum(1, keepdims=True) / n
    gy = -(x / n - cos * y / (n * n))
    gd = r2.T @ gy
    gh2 = (gy @ d.T) * (h2 > 0)
    gc = z.T @ gh2
    gz = gh2 @ c.T
    gb = r1.T @ gz
    ga = x.T @ ((gz @ b.T) * (h1 > 0))
    return np.concatenate([*(g.ravel() for g in (ga, gb, gc, gd)), [(1 - cos).sum()]])


def autoencoder_train(df: DataFrame, code: int, hidden: int = 64, epochs: int = 30, rate: float = 0.02, decay: float = 1e-4, seed: int = 0) -> Autoencoder:
    """Adam on full-batch gradients, each a sum over all rows."""
    rng = np.random.default_rng(seed)
    dims = dimension(df)
    shapes = [(dims, hidden), (hidden, code), (code, hidden), (hidden, dims)]
    model = Autoencoder([rng.standard_normal(s) * np.sqrt(2 / sum(s)) for s in shapes])
    sizes = [int(np.prod(s)) for s in shapes]
    m, v, n = np.zeros(sum(sizes)), np.zeros(sum(sizes)), df.count()
    for t in range(1, epochs + 1):
        now = Autoencoder([w.copy() for w in model.weights])
        g = summed(df, lambda x: _gradients(now, x), (sum(sizes) + 1,), dims)[:-1] / n
        flat = np.concatenate([w.ravel() for w in model.weights])
        g = g + decay * flat
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        model.weights = [w.reshape(s) for w, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), shapes)]
    final = model

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [float(np.abs(final.hidden(x)).max()) for n, _, x in by_length(batch.column(0)) if n == dims and len(x)]
            yield pa.RecordBatch.from_arrays([pa.array(tops, pa.float64())], ["top"])

    top = df.select("vec").mapInArrow(largest, "top double")
    model.scale = top.agg(F.max("top")).first()[0] or 1.0
    return model


def pca(df: DataFrame, k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(mean, components): eigenvectors of the covariance, which is summed over all rows; each has its largest entry positive."""
    dims = dimension(df)
    acc = summed(df, lambda x: np.vstack([x.T @ x, x.sum(0, keepdims=True), np.full((1, dims), len(x))]), (dims + 2, dims), dims)
    n = acc[-1, 0]
    mean = acc[-2] / n
    _, vectors = np.linalg.eigh(acc[:dims] / n - np.outer(mean, mean))
    parts = vectors[:, ::-1][:, :k].T
    return mean, parts * np.sign(parts[np.arange(k), np.abs(parts).argmax(1)])[:, None]


def pca_project(df: DataFrame, mean: np.ndarray, components: np.ndarray) -> DataFrame:
    return mapped(df, lambda x: (x - mean) @ components.T, "projected")
