"""Fusion, diversity and reranking of ranked lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import vec as V
from lodestar.operators.search import all_scores, knn, score_ends, top_k
from lodestar.staging import stage


def rrf(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """``(query_id, id, score)``: sum of 1 / (k + rank + 1) over lists ``(query_id, id, rank)`` with ranks from 0.

    An id that a list has twice counts at its first place; the ranks of others don't move up.
    """
    lists = [r.groupBy("query_id", "id").agg(F.min("rank").alias("rank")) for r in rankings]
    every = lists[0]
    for more in lists[1:]:
        every = every.unionByName(more)
    return every.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("score"))


def rrf_top_k(rankings: list[DataFrame], k: int, rrf_k: int = 60) -> DataFrame:
    return top_k(rrf(rankings, rrf_k), k)


def hybrid(dense: DataFrame, sparse: DataFrame, k: int, alpha: float) -> DataFrame:
    """``(query_id, id, score, rank)``: alpha * dense + (1 - alpha) * sparse, each min-max normalised per query.

    ``dense`` has all documents; one that ``sparse`` lacks scores 0 there.  A list
    whose scores are all equal counts as 0.  ``alpha`` is held within [0, 1].
    """
    alpha = min(1.0, max(0.0, alpha))
    both = dense.select("query_id", "id", F.col("score").alias("d")).join(sparse.select("query_id", "id", F.col("score").alias("s")), ["query_id", "id"], "left").fillna(0.0, ["s"])
    ends = both.groupBy("query_id").agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.min("s").alias("s0"), F.max("s").alias("s1"))
    part = lambda x: F.when(F.col(x + "1") > F.col(x + "0"), (F.col(x) - F.col(x + "0")) / (F.col(x + "1") - F.col(x + "0"))).otherwise(0.0)
    scored = both.join(ends, "query_id").select("query_id", "id", (alpha * part("d") + (1 - alpha) * part("s")).alias("score"))
    return top_k(scored, k)


def hybrid_search(queries: DataFrame, db: DataFrame, sparse: DataFrame, k: int, alpha: float) -> DataFrame:
    """As ``hybrid`` with the cosines of all rows of ``db`` (id, vec) as the dense list, of which few are ranked.

    A row that ``sparse`` lacks can only be among the first k if it is among the k nearest
    (or, with an ``alpha`` of 0, has one of the k smallest ids), so those and the rows that
    ``sparse`` has are all candidates; the ends of the cosines are an aggregate.
    """
    alpha = min(1.0, max(0.0, alpha))
    near = knn(queries, db, k) if alpha > 0 else all_scores(queries, top_k(db.where(F.size("vec") > 0).withColumn("dims", F.size("vec")), k, by="dims", score="id", ascending=True))
    near = near.select("query_id", "id", F.col("score").alias("d"))
    hits = sparse.select("query_id", "id", F.col("score").alias("s"))
    joined = hits.join(db.select("id", "vec"), "id").join(queries, "query_id")
    hit = stage(joined.where(F.size("vec") == F.size("query")).select("query_id", "id", V.cosine(F.col("query"), F.col("vec")).alias("d"), "s"), "hybrid-hits")  # read three times below
    both = near.join(hit.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("s", F.lit(0.0)).unionByName(hit)
    rows = db.where(F.size("vec") > 0).groupBy(F.size("vec").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    lengths = queries.select("query_id", F.size("query").alias("dims")).join(rows, "dims").select("query_id", "n")
    known = hit.groupBy("query_id").agg(F.min("s").alias("least"), F.max("s").alias("most"), F.count(F.lit(1)).alias("hits"))
    ends = score_ends(queries, db).join(lengths, "query_id").join(known, "query_id", "left")
    some = F.col("hits") < F.col("n")  # a row that sparse lacks scores 0 there
    ends = ends.select("query_id", "low", "high", F.when(some, F.least("least", F.lit(0.0))).otherwise(F.col("least")).alias("s0"), F.when(some, F.greatest("most", F.lit(0.0))).otherwise(F.col("most")).alias("s1"))
    part = lambda x, a, b: F.when(F.col(b) > F.col(a), (F.col(x) - F.col(a)) / (F.col(b) - F.col(a))).otherwise(0.0)
    scored = both.join(ends, "query_id").select("query_id", "id", (alpha * part("d", "low", "high") + (1 - alpha) * part("s", "s0", "s1")).alias("score"))
    return top_k(scored, k)


def cosine_rerank(queries: DataFrame, candidates: DataFrame, store: DataFrame, k: int) -> DataFrame:
    """Candidates ``(query_id, id)`` by cosine with the store's vectors; ids that the store lacks are left out."""
    joined = candidates.select("query_id", "id").join(store.select("id", "vec"), "id").join(queries, "query_id")
    return top_k(joined.select("query_id", "id", V.cosine(F.col("query"), F.col("vec")).alias("score")), k)


def rrf_rerank(queries: DataFrame, candidates: DataFrame, store: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Candidates ``(query_id, id, score)`` by the sum of their reciprocal ranks, as they came and by cosine.

    An id that the store lacks ranks last by cosine: at the number of candidates.
    """
    per = Window.partitionBy("query_id")
    known = candidates.select("query_id", "id", "score").join(store.select("id", "vec"), "id", "left").join(queries, "query_id")
    scored = known.withColumn("cosine", F.when(F.col("vec").isNotNull(), V.cosine(F.col("query"), F.col("vec")))).withColumn("n", F.count(F.lit(1)).over(per))
    first = F.row_number().over(per.orderBy(F.desc("score"), "id")) - 1
    second = F.when(F.col("cosine").isNull(), F.col("n")).otherwise(F.row_number().over(per.orderBy(F.desc_nulls_last("cosine"), "id")) - 1)
    fused = scored.select("query_id", "id", (1.0 / (rrf_k + first + 1) + 1.0 / (rrf_k + second + 1)).alias("score"))
    return top_k(fused, k)


def mmr(queries: DataFrame, candidates: DataFrame, k: int, balance: float = 0.5) -> DataFrame:
    """``(query_id, id, rank)``: greedy choice of k among a query's candidates ``(query_id, id, vec)``.

    Every step takes the largest ``balance * relevance - (1 - balance) * nearest
    chosen``; equals (to twelve places) go to the more relevant, then the smaller id.  Candidates are a
    bounded top-k of a search, so a query's fit in a task.
    """
    kinds = dict(candidates.dtypes)
    joined = candidates.select("query_id", "id", "vec").join(queries.select("query_id", "query"), "query_id")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        x = np.array(group["vec"].tolist(), np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-10
        q = np.array(group["query"].iloc[0], np.float64)
        relevance = x @ (q / (np.linalg.norm(q) + 1e-10))
        order = np.lexsort((group["id"].to_numpy(), -relevance))
        x, relevance, ids = x[order], relevance[order], group["id"].to_numpy()[order]
        free, nearest, chosen = np.ones(len(ids), bool), np.full(len(ids), -np.inf), []
        while len(chosen) < min(k, len(ids)):
            value = np.round(relevance if not chosen else balance * relevance - (1 - balance) * nearest, 12)
            best = int(np.where(free, value, -np.inf).argmax())
            chosen.append(best)
            free[best] = False
            nearest = np.maximum(nearest, x @ x[best])
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "id": ids[chosen], "rank": np.arange(1, len(chosen) + 1, dtype=np.int32)})

    return joined.groupBy("query_id").applyInPandas(choose, f"query_id {kinds['query_id']}, id {kinds['id']}, rank int")


def score_sum(scored: DataFrame) -> DataFrame:
    """Documents by the sum of their scores over several queries."""
    return scored.groupBy("id").agg(F.sum("score").alias("score"))
