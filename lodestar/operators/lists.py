"""Inverted files with summaries of their lists: exact search by bounds, and filters that rule lists out.

A list's summary is the range of angles between its vectors and its centroid.  By the
triangle inequality on angles no vector of the list is nearer to a query than the query is to that
ring.  A search visits each query's lists from the best bound on, in rounds of twice as many, until
the bound of every list left is below the query's k-th score: the result is that of exact search.

Of metadata columns a summary has the least and largest value, whether there are nulls, and a Bloom
filter.  Conditions on these columns rule out lists before any row of them is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import vec as V
from lodestar.operators import scan, search
from lodestar.staging import sized, stage

#: Bits of a Bloom filter.
BITS = 2_048
#: Lists that a query visits in the first round.
FIRST = 2
#: Bounds are compared with this much to spare.
SLACK = 1e-7


def rings(index: DataFrame, centroids: DataFrame) -> DataFrame:
    """``(list_id, near, far, zeros)``: least and largest angle of a list's vectors to its centroid, and whether it has zero vectors, whose cosines are 0."""
    rows = index.select("list_id", "vec").join(centroids, "list_id")
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.cosine(F.col("vec"), F.col("centroid"), 2.0)))
    zero = V.norm(F.col("vec")) == 0
    angle = F.when(~zero, F.acos(cosine))
    return rows.select("list_id", angle.alias("a"), zero.alias("z")).groupBy("list_id").agg(F.min("a").alias("near"), F.max("a").alias("far"), F.max("z").alias("zeros"))


def bounds(queries: DataFrame, centroids: DataFrame, summary: DataFrame) -> DataFrame:
    """``(query_id, list_id, bound)``: no vector of the list has a larger cosine with the query."""
    each = search.all_scores(queries, centroids.select(F.col("list_id").alias("id"), F.col("centroid").alias("vec"))).withColumnRenamed("id", "list_id")
    at = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score"))))
    gap = F.greatest(F.lit(0.0), at - F.col("far"), F.col("near") - at)
    zero = F.when(F.col("zeros") | F.col("near").isNull(), F.lit(0.0)).otherwise(F.lit(-1.0))
    ring = F.when(F.col("near").isNotNull(), F.cos(gap)).otherwise(F.lit(-1.0))
    return each.join(F.broadcast(summary), "list_id").select("query_id", "list_id", (F.greatest(ring, zero) + SLACK).alias("bound"))  # a row per list


def _nothing_is_zero(queries: DataFrame) -> DataFrame:
    return queries.where(V.norm(F.col("query")) > 0)


def exact(queries: DataFrame, index: DataFrame, centroids: DataFrame, k: int, where: Column | None = None, summary: DataFrame | None = None) -> DataFrame:
    """``(query_id, id, score, rank)`` as ``search.knn`` by cosine over the rows of the index (id, vec, list_id)."""
    return top(queries, index, centroids, k, where, summary)[0]


def top(queries: DataFrame, index: DataFrame, centroids: DataFrame, k: int, where: Column | None = None, summary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The result of ``exact``, and the lists that each query visited ``(query_id, list_id)``.

    Zero queries, whose cosines are all 0, are compared with every row.
    """
    rows = index if where is None else index.where(where)
    celled = rows.withColumn("cell", F.col("list_id"))
    asked = stage(queries.select("query_id", "query"), "lists-queries")
    summary = stage(rings(index, centroids), "lists-rings") if summary is None else summary
    w = Window.partitionBy("query_id").orderBy(F.desc("bound"), "list_id")
    plan = stage(bounds(_nothing_is_zero(asked), centroids, summary).withColumn("place", F.row_number().over(w)), "lists-plan")
    kinds = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(index.dtypes)['id']}, score double"
    best = stage(search.knn(asked.where(V.norm(F.col("query")) == 0), rows, k), "lists-best")
    visited, at, width = plan.select("query_id", "list_id").limit(0), 0, FIRST
    while plan.where(F.col("place") > at).limit(1).count():
        worst = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("worst"))
        todo = plan.where((F.col("place") > at) & (F.col("place") <= at + width)).join(worst, "query_id", "left")
        todo = stage(todo.where(F.col("worst").isNull() | (F.col("bound") >= F.col("worst"))).select("query_id", "list_id"), "lists-todo")
        if not todo.limit(1).count():
            break
        probing = todo.join(sized(asked), "query_id").select("query_id", "query", F.col("list_id").alias("cell"))
        found = scan.pairs(probing, celled, scan.best(k), kinds, scan.scorer("cosine"))
        best = stage(search.top_k(best.select("query_id", "id", "score").unionByName(found), k), "lists-best")
        visited = visited.unionByName(todo)
        at, width = at + width, 2 * width
    return best, visited


# Metadata -----------------------------------------------------------------------------


def summaries(index: DataFrame, columns: list[str]) -> DataFrame:
    """``list_id`` and, for each column, a struct (low, high, nulls, bits)."""
    each = []
    for c in columns:
        bit = F.when(F.col(c).isNotNull(), F.pmod(F.xxhash64(c), F.lit(BITS)).cast("int"))
        each.append(F.struct(F.min(c).alias("low"), F.max(c).alias("high"), F.coalesce(F.max(F.col(c).isNull()), F.lit(False)).alias("nulls"), F.collect_set(bit).alias("bits")).alias(c))
    return index.groupBy("list_id").agg(*each)


def possible(summary: DataFrame, conditions: list[tuple[str, str, object]]) -> DataFrame:
    """``list_id`` of the lists that may have a row for which all conditions of ``search.metadata_filter`` hold."""
    keep = F.lit(True)
    for key, op, value in conditions:
        s = F.col(key)
        if op not in ("==", "!="):
            raise ValueError(f"unknown operator {op!r}")
        if value is None:
            keep = keep & (s["nulls"] if op == "==" else s["low"].isNotNull())
            continue
        kind = summary.schema[key].dataType["low"].dataType
        v = F.lit(value).cast(kind)
        same = v.eqNullSafe(F.lit(value)) & (v >= s["low"]) & (v <= s["high"]) & F.array_contains(s["bits"], F.pmod(F.xxhash64(v), F.lit(BITS)).cast("int"))
        keep = keep & F.coalesce(same if op == "==" else s["nulls"] | (s["low"] < s["high"]) | (s["low"] != F.lit(value)), F.lit(False))
    return summary.where(keep).select("list_id")


def filtered_search(queries: DataFrame, index: DataFrame, centroids: DataFrame, k: int, n_probe: int, conditions: list[tuple[str, str, object]], summary: DataFrame) -> DataFrame:
    """As ``search.ivf_search`` with ``search.metadata_filter(conditions)``; lists that can't have such a row aren't read."""
    open_ = possible(summary, conditions)
    probing = search.probing(queries, centroids, n_probe).join(open_.select(F.col("list_id").alias("cell")), "cell", "left_semi")
    rows = index.where(search.metadata_filter(conditions)).withColumn("cell", F.col("list_id"))
    kinds = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(index.dtypes)['id']}, score double"
    return search.top_k(scan.pairs(probing, rows, scan.best(k), kinds, scan.scorer("cosine")), k)
