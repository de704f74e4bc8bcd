"""Retrieval over a stored table of texts: what framework adapters ask of a vector store.

A store is a table ``(id, text, metadata MAP<STRING,STRING>, code)`` whose vectors are
kept as codes of one codec.  Appending encodes the new rows only.  A search filters
first, then decodes and scores what is left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import bm25, codecs, quality, ranking, search, store

Embed = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class TextStore:
    """``embed`` turns (id, text) into (id, vec); every change returns a new store."""

    rows: DataFrame | None
    embed: Embed
    codec: str = "int8"
    dims: int = 0

    def _coded(self, texts: DataFrame) -> DataFrame:
        vec = self.embed(texts.select("id", "text"))
        joined = texts.join(vec, "id")
        if "metadata" not in texts.columns:
            joined = joined.withColumn("metadata", F.create_map().cast("map<string,string>"))
        return codecs.encode(joined, self.codec).select("id", "text", "metadata", "code")

    def add(self, texts: DataFrame, policy: str = "overwrite") -> TextStore:
        """Rows ``(id, text[, metadata])``; ids that the store has follow the policy (skip, overwrite, fail)."""
        new = self._coded(texts)
        return replace(self, rows=new if self.rows is None else store.write(self.rows, new, policy))

    def delete(self, ids: DataFrame | None = None, where=None) -> TextStore:
        """Without rows of some ids, or of a condition; without either, empty."""
        if ids is not None:
            return replace(self, rows=store.delete(self.rows, ids))
        return replace(self, rows=self.rows.where(~F.coalesce(where, F.lit(False))) if where is not None else self.rows.limit(0))

    def get(self, ids: DataFrame) -> DataFrame:
        return search.by_ids(self.rows, ids)

    def filtered(self, conditions: list[tuple[str, str, object]] | None = None) -> DataFrame:
        return self.rows if not conditions else self.rows.where(search.metadata_filter(conditions, "metadata"))

    def _vectors(self, conditions) -> DataFrame:
        return codecs.decode(self.filtered(conditions), self.codec, out="vec").select("id", "vec")

    def search_vectors(self, queries: DataFrame, k: int = 4, conditions: list[tuple[str, str, object]] | None = None) -> DataFrame:
        """``(query_id, id, score, rank, text, metadata)`` for queries (query_id, query)."""
        found = search.knn(queries, self._vectors(conditions), k)
        return found.join(self.rows.select("id", "text", "metadata"), "id")

    def _asked(self, queries: DataFrame) -> DataFrame:
        return self.embed(queries.select(F.col("query_id").alias("id"), "text")).select(F.col("id").alias("query_id"), F.col("vec").alias("query"))

    def search(self, queries: DataFrame, k: int = 4, conditions: list[tuple[str, str, object]] | None = None) -> DataFrame:
        """As ``search_vectors`` for texts (query_id, text)."""
        return self.search_vectors(self._asked(queries), k, conditions)

    def search_mmr(self, queries: DataFrame, k: int = 4, fetch: int = 20, balance: float = 0.5, conditions: list[tuple[str, str, object]] | None = None) -> DataFrame:
        """``(query_id, id, rank, text)``: k of the ``fetch`` nearest, chosen for diversity."""
        asked, vectors = self._asked(queries), self._vectors(conditions)
        near = search.knn(asked, vectors, fetch).join(vectors, "id")
        return ranking.mmr(asked, near, k, balance).join(self.rows.select("id", "text"), "id")

    def search_hybrid(self, queries: DataFrame, k: int = 10, alpha: float = 0.7) -> DataFrame:
        """Blend of cosine and BM25."""
        sparse = bm25.score(bm25.build(self.rows.select("id", "text")), queries)
        return ranking.hybrid_search(self._asked(queries), self._vectors(None), sparse, k, alpha).join(self.rows.select("id", "text"), "id")

    def search_many(self, queries: DataFrame, k: int = 4) -> DataFrame:
        """``(id, score, text)``: the k documents with the largest sum of scores over all queries."""
        return search.score_sums(self._asked(queries), self._vectors(None)).orderBy(F.desc("score"), "id").limit(k).join(self.rows.select("id", "text"), "id")

    def stats(self) -> DataFrame:
        """One row: documents, dims, codec, ratio."""
        dims = F.first(F.size("vec"))
        return self._vectors(None).agg(F.count(F.lit(1)).alias("documents"), dims.alias("dims")).withColumn("codec", F.lit(self.codec)).withColumn("ratio", F.lit(codecs.CODECS[self.codec].ratio(1024)))

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(path)

    def load(self, path: str) -> TextStore:
        """This store's functions over the rows of another one's files."""
        return replace(self, rows=SparkSession.active().read.parquet(path))


def rrf_retrieve(sources: list[Callable[[DataFrame, int], DataFrame]], queries: DataFrame, k: int, fetch: int = 50, rrf_k: int = 60) -> DataFrame:
    """Fusion of several searches ``(queries, fetch) -> (query_id, id, rank from 1)``; one that fails counts as empty."""
    lists = []
    for source in sources:
        try:
            found = source(queries, fetch).select("query_id", "id", (F.col("rank") - 1).alias("rank"))
            found.limit(1).count()
        except Exception:  # noqa: BLE001, S112  a broken source must not take the others with it
            continue
        lists.append(found)
    if not lists:
        raise ValueError("every source failed")
    return ranking.rrf_top_k(lists, k, rrf_k)


def self_search(db: DataFrame, decoded: DataFrame, sample: DataFrame) -> DataFrame:
    """One row: mean, least and largest similarity of sampled vectors to their nearest decoded vector."""
    asked = search.by_ids(db, sample).select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    top = search.knn(asked, decoded, 1)
    return top.agg(F.avg("score").alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"))


def cosine_matrix(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(query_id, id, score)`` of every row of ``a`` (query_id, query) with every row of ``b``."""
    return search.all_scores(a, b)


def by_dimensions(df: DataFrame, codec: str, dims: list[int]) -> DataFrame:
    """``(dims, mean_cosine)`` of prefixes after a codec."""
    from lodestar.functions import vec as V

    c = codecs.CODECS[codec]
    parts = df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dims"), F.slice("vec", 1, d).alias("v")) for d in dims])).alias("p")).select("p.dims", "p.v")
    return parts.groupBy("dims").agg(F.avg(V.cosine(F.col("v"), c.decode(c.encode(F.col("v"))))).alias("mean_cosine"))


def report(metrics: DataFrame, title: str = "Quality") -> str:
    """Text of one row of metrics."""
    row = metrics.first().asDict()
    return "\n".join([title, *[f"{k}: {v:.6g}" if isinstance(v, float) else f"{k}: {v}" for k, v in row.items()]])


def recall_of(store_: TextStore, queries: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    return quality.recall(truth, store_.search_vectors(queries, k), k)
