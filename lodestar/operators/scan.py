"""Queries against rows in blocks: every query meets every row once, or every row of its cell.

A query table within ``HELD_BLOCKS`` blocks of ``QUERY_ROWS``, and ``QUERY_NUMBERS``, goes to every task, which multiplies
each Arrow batch with it.  A larger one is cut into blocks and the rows into parts; each
block meets each part in a group of its own.  Either way ``SCORES`` are made at once, and what
leaves a task is what a reducer makes of them: the best few, ends, sums, or all of them.

Vectors only meet vectors of their own length.  Those that are null, or hold a null or
non-finite number, meet none; a score that isn't a number counts as no score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries, and numbers in them, of a block; so many blocks, of no more numbers, go to every task.
QUERY_ROWS, QUERY_NUMBERS, HELD_BLOCKS = 1_024, 4_000_000, 16
#: Products of rows and centroids at once.
PRODUCTS = 8_000_000
#: Rows of a part, rows that are scored at once, and scores of them at once.
PART_ROWS, SCORED_ROWS, SCORES = 65_536, 4_096, 1_000_000

#: Squared distances below this share of the squared norms are computed from differences, so many numbers of them at once.
CANCELLED, DIFFERENCES = 1e-6, 4_000_000

ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}

Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]
Reducer = Callable[[pa.Array, pa.Array, np.ndarray], pa.RecordBatch]


def row_slices(x: np.ndarray, width: int) -> Iterator[slice]:
    """Slices of the rows of ``x`` whose products with ``width`` columns are at most ``PRODUCTS`` numbers."""
    step = max(1, PRODUCTS // max(width, 1))
    return (slice(at, at + step) for at in range(0, len(x), step))


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, matrix) of the finite vectors of each length in a list column."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        ok = np.isfinite(x).all(axis=1)
        yield n, at[ok], x[ok]


def squared_distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(rows, queries) squared distances: by products, and by differences where products would cancel."""
    norms = (x * x).sum(1)[:, None] + (q * q).sum(1)[None]
    out = norms - 2 * x @ q.T
    row, query = np.nonzero(~(out > CANCELLED * norms))
    for at in range(0, len(row), step := max(1, DIFFERENCES // max(x.shape[1], 1))):
        r, j = row[at : at + step], query[at : at + step]
        gap = x[r] - q[j]
        out[r, j] = (gap * gap).sum(1)
    return out


def scorer(metric: str) -> Scorer:
    """(rows, queries) scores; the larger, the nearer."""

    def hamming(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        a, b = (x > 0).astype(np.float32), (q > 0).astype(np.float32)
        return -(a.sum(1)[:, None] + b.sum(1)[None] - 2 * a @ b.T).astype(np.float64)

    def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None]
        return np.divide(x @ q.T, n, out=np.zeros_like(n), where=n > 0)

    known = {
        "dot": lambda x, q: x @ q.T,
        "l2": lambda x, q: -np.sqrt(squared_distances(x, q)),
        "l1": lambda x, q: -np.stack([np.abs(x - row).sum(1) for row in q], axis=1),
        "cosine": cosine,
        "hamming": hamming,
    }
    if metric not in known:
        raise ValueError(f"unknown metric {metric!r}")
    return known[metric]


def best(k: int, own: bool = True) -> Reducer:
    """query_id, id, score of each query's k best rows; of equals, those with the smallest ids.  Without ``own``, no query finds its own id."""

    def reduce(names: pa.Array, found: pa.Array, scores: np.ndarray) -> pa.RecordBatch:
        if not own:
            scores[found.to_numpy(zero_copy_only=False)[:, None] == names.to_numpy(zero_copy_only=False)[None]] = -np.inf
        keep = scores > -np.inf
        if len(scores) > k:
            keep &= scores >= np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
            tied = np.flatnonzero(keep.sum(axis=0) > k)
            ids = found.to_pylist() if len(tied) else []
            for j in tied:
                order = sorted(np.flatnonzero(keep[:, j]).tolist(), key=lambda i: (-scores[i, j], ids[i] is None, ids[i]))[:k]  # noqa: B023
                keep[:, j] = False
                keep[order, j] = True
        row, query = np.nonzero(keep)
        return pa.RecordBatch.from_arrays([names.take(pa.array(query)), found.take(pa.array(row)), pa.array(scores[row, query])], ["query_id", "id", "score"])

    return reduce


def everything(names: pa.Array, found: pa.Array, scores: np.ndarray) -> pa.RecordBatch:
    """query_id, id, score of all pairs."""
    return best(len(scores))(names, found, scores)


def ends(names: pa.Array, found: pa.Array, scores: np.ndarray) -> pa.RecordBatch:
    """query_id with least and largest score."""
    seen = scores > -np.inf
    some = seen.any(axis=0)
    low, high = np.where(seen, scores, np.inf).min(axis=0, initial=np.inf), scores.max(axis=0, initial=-np.inf)
    return pa.RecordBatch.from_arrays([names.filter(pa.array(some)), pa.array(low[some]), pa.array(high[some])], ["query_id", "low", "high"])


def sums(names: pa.Array, found: pa.Array, scores: np.ndarray) -> pa.RecordBatch:
    """id with the sum of its scores."""
    seen = scores > -np.inf
    some = seen.any(axis=1)
    return pa.RecordBatch.from_arrays([found.filter(pa.array(some)), pa.array(np.where(seen, scores, 0).sum(axis=1)[some])], ["id", "score"])


def _reduced(reduce: Reducer, score: Scorer, names: pa.Array, q: np.ndarray, found: pa.Array, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a reducer makes of the scores of some rows, for some queries at a time."""
    step = max(1, SCORES // max(len(x), 1))
    for at in range(0, len(q) if len(x) else 0, step):
        with np.errstate(over="ignore", invalid="ignore"):
            scores = score(x, q[at : at + step])
        scores[np.isnan(scores)] = -np.inf
        yield reduce(names.slice(at, step), found, scores)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, SCORED_ROWS) for at in range(0, batch.num_rows, SCORED_ROWS))


def pairs(queries: DataFrame, rows: DataFrame, reduce: Reducer, schema: str, score: Scorer, ratio: int = 1, meets: int | None = None, part_rows: int | None = None) -> DataFrame:
    """What ``reduce`` makes of the scores of ``queries`` (query_id, query) and ``rows`` (id, vec).

    With a third column ``cell`` in both, queries meet the rows of their cell; a query may
    have several.  ``ratio``: a query is that many times as long as a row that it meets; ``meets``: rows
    of any length meet queries of that one.  ``part_rows``: rows of a part, ``PART_ROWS`` if not given, of whose scores with
    a block of queries a task holds what the reducer leaves.
    A reducer's results for one query, or row, come from several tasks.
    """
    celled = "cell" in queries.columns
    asked = queries.select("query_id", "query", *(["cell"] if celled else [])).where(F.size("query") > 0)
    db = rows.select("id", "vec", *(["cell"] if celled else []))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("query")), F.lit(0)).alias("numbers")).first()
    if not size["n"]:
        return rows.sparkSession.createDataFrame([], schema)
    if size["n"] > QUERY_ROWS * HELD_BLOCKS or size["numbers"] > QUERY_NUMBERS:
        return _grid(asked, db, reduce, schema, score, ratio, meets, celled, part_rows or PART_ROWS)
    if size["n"] > QUERY_ROWS and not celled:  # much work for a row: as many tasks as there are cores, however the rows are stored
        db = db.repartition("id")
    held: dict[tuple, tuple[list, list]] = {}
    for r in asked.collect():  # within both bounds
        if all(v is not None and np.isfinite(v) for v in r["query"]):
            names, vectors = held.setdefault((r["cell"] if celled else None, len(r["query"])), ([], []))
            names.append(r["query_id"])
            vectors.append(r["query"])
    kind = ARROW.get(dict(queries.dtypes)["query_id"])
    groups = {key: (pa.array(names, kind), np.array(vectors, np.float64)) for key, (names, vectors) in held.items()}
    if celled:  # an index stored by cell is only read where it is asked for
        db = db.where(F.col("cell").isin(sorted({c for c, _ in groups})))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in _slices(b)):
            cells = batch.column(2).to_numpy(zero_copy_only=False) if celled else None
            for n, at, x in by_length(batch.column(1)):
                for cell in np.unique(cells[at]).tolist() if celled else [None]:
                    if (cell, meets or n * ratio) in groups:
                        mine = cells[at] == cell if celled else slice(None)
                        yield from _reduced(reduce, score, *groups[cell, meets or n * ratio], batch.column(0).take(pa.array(at[mine])), x[mine])

    return db.mapInArrow(run, schema)


def _grid(asked: DataFrame, db: DataFrame, reduce: Reducer, schema: str, score: Scorer, ratio: int, meets: int | None, celled: bool, part_rows: int) -> DataFrame:
    """Blocks of queries against parts of rows; both are counted by length and cell first."""
    key = ["n", "cell"] if celled else ["n"]
    q, r = asked.withColumn("n", F.size("query")), db.where(F.size("vec") > 0).withColumn("n", F.size("vec") * ratio if meets is None else F.lit(meets))
    block = F.greatest(F.lit(1), F.least(F.lit(QUERY_ROWS), F.floor(F.lit(QUERY_NUMBERS) / F.col("n"))))
    blocks = q.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).select(*key, F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    parts = r.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    grid = blocks.join(parts, key)

    def dealt(df: DataFrame, by: str, own: str, other: str) -> DataFrame:
        """Rows in their own block or part, once for each one of the other kind; with names of its own, as both sides come from one grid."""
        every = df.join(grid.toDF(*grid.columns), key).withColumn(own, F.pmod(F.xxhash64(by), F.col(own + "s")).cast("int"))
        every = every.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other + "s") - 1))).drop("blocks", "parts")
        return every.toDF(*every.columns)

    left, right = (df.groupBy(*key, "block", "part") for df in (dealt(q, "query_id", "block", "part"), dealt(r, "id", "part", "block")))

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        out = []
        for qs in one.combine_chunks().to_batches():
            for _, at, q in by_length(qs.column("query")):
                names = qs.column("query_id").take(pa.array(at))
                for rs in (s for b in two.combine_chunks().to_batches() for s in _slices(b)):
                    for _, where, x in by_length(rs.column("vec")):
                        out.extend(_reduced(reduce, score, names, q, rs.column("id").take(pa.array(where)), x))
        if not out:  # no finite vector on one side
            none = pa.nulls(0, one.schema.field("query_id").type), pa.nulls(0, two.schema.field("id").type)
            out = [reduce(*none, np.zeros((0, 0)))]
        return pa.Table.from_batches(out)

    return left.cogroup(right).applyInArrow(meet, schema)
