"""Nearest-neighbour search: scores in blocks (``scan.py``) with a top-k per query.

A task keeps its own best k per query, so a shuffle carries at most k rows per query and
task.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import vec as V
from lodestar.operators import codecs, scan

#: Numbers in centroids that go to every task; more of them are searched like rows.
CENTROID_NUMBERS = 8_000_000


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", ascending: bool = False, id_col: str = "id") -> DataFrame:
    """Best k rows of each query with ``rank`` from 1; equal scores rank by id."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, id_col))).where(F.col("rank") <= k)


def _kinds(queries: DataFrame, db: DataFrame) -> str:
    return f"query_id {dict(queries.dtypes)['query_id']}, id {dict(db.dtypes)['id']}, score double"


def knn(queries: DataFrame, db: DataFrame, k: int, metric: str = "cosine", where: Column | None = None, include_self: bool = True) -> DataFrame:
    """``(query_id, id, score, rank)``: the k nearest rows of ``db`` (id, vec) for each of ``queries`` (query_id, query).

    ``where`` filters rows before they are scored.  Scores of l1, l2 and hamming are negated
    distances.  A query meets the vectors of its own length; vectors, and queries, that are null
    or hold a null or non-finite number are left out.
    """
    rows = db if where is None else db.where(where)
    if k < 1:
        return db.sparkSession.createDataFrame([], _kinds(queries, db) + ", rank int")
    return top_k(scan.pairs(queries, rows, scan.best(k, include_self), _kinds(queries, db), scan.scorer(metric)), k)


def all_scores(queries: DataFrame, db: DataFrame, metric: str = "cosine") -> DataFrame:
    """``(query_id, id, score)`` of every query and row, without ranks."""
    return scan.pairs(queries, db, scan.everything, _kinds(queries, db), scan.scorer(metric), part_rows=scan.SCORED_ROWS)


def score_ends(queries: DataFrame, db: DataFrame, metric: str = "cosine") -> DataFrame:
    """``(query_id, low, high)``: least and largest score of each query over all rows."""
    kind = dict(queries.dtypes)["query_id"]
    each = scan.pairs(queries, db, scan.ends, f"query_id {kind}, low double, high double", scan.scorer(metric))
    return each.groupBy("query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def score_sums(queries: DataFrame, db: DataFrame, metric: str = "cosine") -> DataFrame:
    """``(id, score)``: the sum of each row's scores over all queries."""
    each = scan.pairs(queries, db, scan.sums, f"id {dict(db.dtypes)['id']}, score double", scan.scorer(metric))
    return each.groupBy("id").agg(F.sum("score").alias("score"))


def knn_expression(queries: DataFrame, db: DataFrame, k: int, zero: float = 0.0) -> DataFrame:
    """Cosine search without Python: few queries are broadcast and meet every row; more than ``scan.QUERY_ROWS`` go to ``knn``."""
    if queries.limit(scan.QUERY_ROWS + 1).count() > scan.QUERY_ROWS:
        return knn(queries, db, k)
    scored = db.crossJoin(F.broadcast(queries)).select("query_id", "id", V.cosine(F.col("query"), F.col("vec"), zero).alias("score"))
    return top_k(scored, k)


def knn_coded(queries: DataFrame, coded: DataFrame, codec: str, k: int, metric: str = "cosine") -> DataFrame:
    """Search over stored codes: decode, then ``knn``."""
    return knn(queries, codecs.decode(coded, codec, out="vec").select("id", "vec"), k, metric)


def cosine_codes(query: Column, codes: Column) -> Column:
    """Cosine of a vector and integer codes: the scale cancels out."""
    return V.cosine(query, codes)


def hamming_topk(queries: DataFrame, db: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, distance, rank)`` over sign bits."""
    near = knn(queries, db, k, "hamming")
    return near.select("query_id", "id", (-F.col("score")).cast("int").alias("distance"), "rank")


def two_stage(queries: DataFrame, db: DataFrame, k: int, fetch: int) -> DataFrame:
    """Hamming search for ``fetch`` candidates, then exact cosine among them."""
    near = hamming_topk(queries, db, fetch).select("query_id", "id")
    joined = near.join(db.select("id", "vec"), "id").join(queries, "query_id")
    return top_k(joined.select("query_id", "id", V.cosine(F.col("query"), F.col("vec")).alias("score")), k)


# Inverted file ------------------------------------------------------------------


def assign(db: DataFrame, centroids: DataFrame) -> DataFrame:
    """``db`` with ``list_id``: the centroid (list_id, centroid) with the largest dot product.

    Rows without a finite vector of the centroids' length are left out.  Centroids go to
    every task while they have ``CENTROID_NUMBERS`` numbers at most; beyond that, rows look
    them up in blocks, and ids must be distinct.
    """
    size = centroids.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("centroid")).alias("d")).first()
    if not size["n"]:
        raise ValueError("no centroids")
    dims, rows = size["d"], db.drop("list_id")
    if size["n"] * dims > CENTROID_NUMBERS:
        near = knn(rows.select(F.col("id").alias("query_id"), F.col("vec").alias("query")), _as_rows(centroids), 1, "dot")
        return rows.join(near.select(F.col("query_id").alias("id"), F.col("id").alias("list_id")), "id").select(*rows.columns, F.col("list_id").cast("int"))
    table = centroids.orderBy("list_id").collect()
    lists, c = np.array([r["list_id"] for r in table], np.int32), np.array([r["centroid"] for r in table], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, at, x in scan.by_length(batch.column("vec")):
                if n == dims:
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(lists[_nearest(x, c)])], [*batch.schema.names, "list_id"])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("list_id", T.IntegerType())]))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row the largest dot product's column, a bounded block of products at a time."""
    out = np.zeros(len(x), np.int64)
    for s in scan.row_slices(x, len(c)):
        out[s] = (x[s] @ c.T).argmax(axis=1)
    return out


def _as_rows(centroids: DataFrame) -> DataFrame:
    return centroids.select(F.col("list_id").alias("id"), F.col("centroid").alias("vec"))


def probes(queries: DataFrame, centroids: DataFrame, n: int) -> DataFrame:
    """``(query_id, list_id, probe)``: each query's n best lists, probe 1 the best."""
    return knn(queries, _as_rows(centroids), n, "dot").select("query_id", F.col("id").alias("list_id"), F.col("rank").alias("probe"))


def probing(queries: DataFrame, centroids: DataFrame, n_probe: int) -> DataFrame:
    """Queries once for each list that they probe."""
    return probes(queries, centroids, n_probe).join(queries, "query_id").select("query_id", "query", F.col("list_id").alias("cell"))


def ivf_search(queries: DataFrame, index: DataFrame, centroids: DataFrame, k: int, n_probe: int, where: Column | None = None) -> DataFrame:
    """``(query_id, id, score, rank)`` among the rows of each query's ``n_probe`` best lists.

    An index stored by ``list_id`` is read only where a list is probed.
    """
    rows = (index if where is None else index.where(where)).withColumn("cell", F.col("list_id"))
    return top_k(scan.pairs(probing(queries, centroids, n_probe), rows, scan.best(k), _kinds(queries, index), scan.scorer("cosine")), k)


def probes_for_recall(queries: DataFrame, index: DataFrame, centroids: DataFrame, k: int, target: float) -> DataFrame:
    """``(query_id, n_probe, recall)``: the smallest power of two of probes (or all lists) that reaches the target.

    Every row of a query's exact top k has the probe at which its list comes up.
    """
    lists = centroids.count()
    exact = knn(queries, index, k).select("query_id", "id").join(index.select("id", "list_id"), "id")
    at = exact.join(probes(queries, centroids, lists), ["query_id", "list_id"])
    steps = sorted({min(1 << i, lists) for i in range(lists.bit_length() + 1)})
    tried = at.select("query_id", "probe", F.explode(F.array(*[F.lit(s) for s in steps])).alias("n_probe"))
    per = tried.groupBy("query_id", "n_probe").agg((F.count_if(F.col("probe") <= F.col("n_probe")) / F.count(F.lit(1))).alias("recall"))
    reached = per.where(F.col("recall") >= target).groupBy("query_id").agg(F.min(F.struct("n_probe", "recall")).alias("b"))
    return reached.select("query_id", "b.n_probe", "b.recall")


# Product quantisation -------------------------------------------------------------


def pq_codes(v: Column, codebook: list[list[list[float]]]) -> Column:
    """Nearest centroid (squared distance, the first of equals) of each sub-vector, as an expression over a literal codebook."""
    width = len(codebook[0][0])
    out = []
    for m, cents in enumerate(codebook):
        part = F.slice(v, m * width + 1, width)
        dist = F.array(*[V.l2_squared(part, F.array(*[F.lit(float(x)) for x in c])) for c in cents])
        out.append((F.array_position(dist, F.array_min(dist)) - 1).cast("int"))
    return F.array(*out)


def pq_encode(df: DataFrame, codebook: np.ndarray, out: str = "codes") -> DataFrame:
    """``df`` with PQ codes of ``vec``; the codebook (M, K, width) goes to every task.

    Codes of rows without a finite vector of the codebook's length are null, and are never found.
    """
    from pyspark.sql import types as T

    dims, parts = codebook.shape[0] * codebook.shape[2], codebook.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.nulls(batch.num_rows, pa.list_(pa.int32()))
            for n, at, x in scan.by_length(batch.column("vec")):
                if n == dims and len(x):
                    made = pa.FixedSizeListArray.from_arrays(pa.array(pq_assign(x, codebook).ravel(), pa.int32()), parts).cast(pa.list_(pa.int32()))
                    place = np.full(batch.num_rows, -1)
                    place[at] = np.arange(len(at))
                    lists = made.take(pa.array(place, mask=place < 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, out])

    rows = df.drop(out)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def pq_assign(x: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """(rows, M) nearest centroids."""
    m, _, width = codebook.shape
    parts = x.reshape(len(x), m, width)
    out = np.empty((len(x), m), np.int64)
    for i in range(m):
        c = codebook[i].astype(np.float64)
        out[:, i] = ((c * c).sum(1)[None] - 2 * parts[:, i] @ c.T).argmin(axis=1)
    return out


def pq_decode(codes: Column, codebook: np.ndarray) -> Column:
    """Centroids of the codes, strung together."""
    table = F.array(*[F.array(*[F.array(*[F.lit(float(x)).cast("float") for x in c]) for c in part]) for part in codebook.tolist()])
    return F.flatten(F.zip_with(codes, table, lambda c, part: F.element_at(part, c + 1)))


def adc_table(query: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """(M, K) squared distances of a query's parts to all centroids."""
    m, _, width = codebook.shape
    return ((np.asarray(query, np.float64).reshape(m, 1, width) - codebook.astype(np.float64)) ** 2).sum(axis=2)


def _adc(codebook: np.ndarray) -> scan.Scorer:
    """Negated distances of codes to queries by the queries' tables."""

    def score(codes: np.ndarray, q: np.ndarray) -> np.ndarray:
        tables, codes = np.stack([adc_table(row, codebook) for row in q]), codes.astype(np.int64)
        return -sum(tables[:, m, codes[:, m]].T for m in range(codes.shape[1]))

    return score


def _by_distance(scored: DataFrame, k: int) -> DataFrame:
    found = scored.select("query_id", "id", (-F.col("score")).alias("distance"))
    return top_k(found, k, score="distance", ascending=True)


def adc_topk(queries: DataFrame, coded: DataFrame, codebook: np.ndarray, k: int, where: Column | None = None) -> DataFrame:
    """``(query_id, id, distance, rank)``: search over PQ codes (id, codes) with each query's distance table, which tasks make."""
    rows = (coded if where is None else coded.where(where)).select("id", F.col("codes").alias("vec"))
    return _by_distance(scan.pairs(queries, rows, scan.best(k), _kinds(queries, coded), _adc(codebook), codebook.shape[2]), k)


def ivf_pq_search(queries: DataFrame, index: DataFrame, centroids: DataFrame, codebook: np.ndarray, k: int, n_probe: int) -> DataFrame:
    """ADC inside the probed lists of an index (id, list_id, codes)."""
    rows = index.select("id", F.col("codes").alias("vec"), F.col("list_id").alias("cell"))
    return _by_distance(scan.pairs(probing(queries, centroids, n_probe), rows, scan.best(k), _kinds(queries, index), _adc(codebook), codebook.shape[2]), k)


# Metadata -------------------------------------------------------------------------


def metadata_filter(conditions: list[tuple[str, str, object]], meta: str | None = None) -> Column:
    """All of (key, operator, value) with operators ``==`` and ``!=``; nulls compare as values.  Keys are columns, or entries of the map column ``meta``."""
    out = F.lit(True)
    for key, op, value in conditions:
        left = F.col(key) if meta is None else F.col(meta)[key]
        same = left.eqNullSafe(F.lit(value))
        if op not in ("==", "!="):
            raise ValueError(f"unknown operator {op!r}")
        out = out & (same if op == "==" else ~same)
    return out


def by_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is in a table of ids; unknown ids are left out."""
    return df.join(ids.select(id_col).distinct(), id_col, "left_semi")
