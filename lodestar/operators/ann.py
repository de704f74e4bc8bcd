"""Approximate nearest neighbours with the calls of a graph index.

The index is an inverted file.  How many lists are probed follows from recall measured
against exact search for every row whose id is divisible by 50; ``ef`` asks for that many
candidates per query and can only add lists.  Deleted rows are tombstones until ``compact``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import lists, quality, search, store, training

#: Recall that the measured number of probes reaches on average.
RECALL = 0.9


@dataclass(frozen=True)
class AnnIndex:
    """rows (id, vec, ..., list_id), centroids and tombstones; every change returns a new index."""

    rows: DataFrame
    centroids: DataFrame
    tombstones: DataFrame | None = None
    #: Probes by k, once measured; a changed index measures anew.
    measured: dict[int, int] = field(init=False, default_factory=dict, compare=False, repr=False)

    @staticmethod
    def build(df: DataFrame, lists: int | None = None, rounds: int = 10, seed: int = 0) -> AnnIndex:
        """Lists default to the square root of the row count."""
        centroids = training.ivf_train(df, lists or max(1, isqrt(df.count())), rounds, seed)
        return AnnIndex(search.assign(df, centroids), centroids)

    def alive(self) -> DataFrame:
        return self.rows if self.tombstones is None else store.alive(self.rows, self.tombstones)

    def add(self, df: DataFrame) -> AnnIndex:
        """Insert rows, or replace those with known ids; a deleted id lives again."""
        rows = store.write(self.rows, search.assign(df, self.centroids), "overwrite")
        dead = None if self.tombstones is None else store.delete(self.tombstones, df)
        return replace(self, rows=rows, tombstones=dead)

    def delete(self, ids: DataFrame) -> AnnIndex:
        return replace(self, tombstones=store.tombstone(self.tombstones, ids))

    def compact(self) -> AnnIndex:
        return replace(self, rows=self.alive(), tombstones=None)

    def search(self, queries: DataFrame, k: int = 10, ef: int = 64, where: Column | None = None) -> DataFrame:
        """``(query_id, id, score, rank)``; a filter holds before ranking, so k rows come back where lists hold them."""
        known = self.centroids.count()
        per_list = max(1.0, self.rows.count() / max(known, 1))
        probes = min(known, max(self.probes(k, where), ceil(max(ef, k) * 4 / per_list)))
        return search.ivf_search(queries, self.alive(), self.centroids, k, probes, where)

    def probes(self, k: int = 10, where: Column | None = None) -> int:
        """Fewest lists that hold ``RECALL`` of the exact results of all rows with ids divisible by 50; all lists if there are none."""
        if where is None and k in self.measured:
            return self.measured[k]
        known, live = self.centroids.count(), self.alive()
        queries = live.where("try_cast(id AS bigint) % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
        exact = search.knn(queries, live, k, where=where).join(live.select("id", "list_id"), "id")
        held = exact.join(search.probes(queries, self.centroids, known), ["query_id", "list_id"]).groupBy("probe").count().collect()  # a row per list at most
        at, total, found, n = {r["probe"]: r["count"] for r in held}, sum(r["count"] for r in held), 0, 0
        while total and n < known and found < RECALL * total:
            n += 1
            found += at.get(n, 0)
        n = n or known
        if where is None:
            self.measured[k] = n
        return n

    def search_exact(self, queries: DataFrame, k: int = 10, where: Column | None = None) -> DataFrame:
        """As ``search`` with all of the k nearest, by bounds on the lists instead of a number of probes."""
        return lists.exact(queries, self.alive(), self.centroids, k, where)

    def search_for_recall(self, queries: DataFrame, k: int, target: float) -> DataFrame:
        """``(query_id, n_probe, recall)``: what each query needs."""
        return search.probes_for_recall(queries, self.alive(), self.centroids, k, target)

    def get(self, ids: DataFrame) -> DataFrame:
        return search.by_ids(self.alive(), ids)

    def stats(self) -> DataFrame:
        """One row: total, alive, deleted, lists, largest list."""
        per = self.rows.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
        lists = per.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("lists"), F.max("n").alias("largest"))
        dead = F.lit(0) if self.tombstones is None else F.lit(search.by_ids(self.rows, self.tombstones).count())
        return lists.select("total", (F.col("total") - dead).alias("alive"), dead.alias("deleted"), "lists", "largest")

    def recall_estimate(self, one_in: int = 10, k: int = 10, ef: int = 64) -> DataFrame:
        """Recall on a sample of rows by hash, with its 95 % interval."""
        queries = quality.sampled(self.alive(), one_in).select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
        truth = search.knn(queries, self.alive().select("id", "vec"), k)
        return quality.recall_estimate(quality.recall(truth, self.search(queries, k, ef), k), k)

    def save(self, path: str) -> None:
        self.centroids.write.mode("overwrite").parquet(f"{path}/centroids")
        self.alive().repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/rows")

    @staticmethod
    def load(spark: SparkSession, path: str) -> AnnIndex:
        return AnnIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/centroids"))
