"""Corpus statistics that follow additions, changes and deletions of documents.

Every batch of changes leaves three small tables of its own: the counted words of its documents, and what it adds to, or
takes from, document frequencies and totals.  A batch is keyed by its id and overwrites
whatever an earlier attempt at it left, so a replayed batch counts once; statistics are sums over
the batches that have been committed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.operators import bm25, store

_LOG = "deleted boolean, length bigint, words array<string>, counts array<int>"


@dataclass(frozen=True)
class MaintainedCorpus:
    """Statistics of a corpus in a folder; ``id_kind`` is the type of its ids."""

    spark: SparkSession
    path: str
    id_kind: str = "bigint"

    def _read(self, name: str, columns: str) -> DataFrame:
        """Rows of the committed batches, with ``batch``."""
        marks = f"{self.path}/commits"
        jvm = self.spark._jvm  # noqa: SLF001
        p = jvm.org.apache.hadoop.fs.Path(marks)
        if not p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p):  # noqa: SLF001
            return self.spark.createDataFrame([], f"{columns}, batch bigint")
        done = self.spark.read.schema("batch bigint").parquet(marks)
        return self.spark.read.schema(f"{columns}, batch bigint").parquet(f"{self.path}/{name}").join(F.broadcast(done), "batch", "left_semi")  # a row per batch

    def _log(self) -> DataFrame:
        return self._read("log", f"id {self.id_kind}, {_LOG}")

    def _latest(self, log: DataFrame) -> DataFrame:
        """The last version of each document, deleted or not."""
        last = log.groupBy("id").agg(F.max("batch").alias("batch"))  # ids and batches alone
        return log.join(last, ["id", "batch"])

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Fold in ``(id, text, deleted, order)``; of several changes of an id the one with the largest ``order`` holds.

        Columns ``deleted`` and ``order`` may be missing: no row is a deletion, and of a repeated id any row
        holds.  A deletion of an unknown id changes nothing; null ids are ignored.  Batches come in the order of their ids;
        one that comes again replaces what it did before, and must be followed again by those after it.
        """
        rows = changes.where("id is not null")
        if "deleted" not in rows.columns:
            rows = rows.withColumn("deleted", F.lit(False))
        rows = store.last_per_id(rows, "order" if "order" in rows.columns else None)
        rows = rows.select(F.col("id").cast(self.id_kind).alias("id"), F.when(~F.coalesce("deleted", F.lit(False)), F.coalesce("text", F.lit(""))).alias("text"))
        new = bm25.counted(rows.where("text is not null")).withColumn("deleted", F.lit(False))
        gone = rows.where("text is null").select("id", F.lit(True).alias("deleted"), F.lit(0).cast("bigint").alias("length"), F.expr("cast(array() as array<string>)").alias("words"), F.expr("cast(array() as array<int>)").alias("counts"))
        here = f"{self.path}/log/batch={batch}"
        new.select("id", "deleted", "length", "words", "counts").unionByName(gone).write.mode("overwrite").parquet(here)
        now = self.spark.read.schema(f"id {self.id_kind}, {_LOG}").parquet(here)
        before = self._latest(self._log().where(F.col("batch") < batch).join(now.select("id"), "id", "left_semi"))
        both = now.where("not deleted").withColumn("sign", F.lit(1)).unionByName(before.where("not deleted").drop("batch").withColumn("sign", F.lit(-1)))
        terms = both.select("sign", F.explode("words").alias("term")).groupBy("term").agg(F.sum("sign").alias("df")).where("df <> 0")
        terms.write.mode("overwrite").parquet(f"{self.path}/terms/batch={batch}")
        both.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("documents"), F.coalesce(F.sum(F.col("sign") * F.col("length")), F.lit(0)).alias("length")).write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")
        self.spark.range(1).select(F.lit(True).alias("done")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")

    def follow(self, changes: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Fold in a stream of changes; a restart goes on where the checkpoint stands, and replays its last batch at most."""
        writer = changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()

    def documents(self) -> DataFrame:
        """``(id, length, words, counts)`` of the documents that live."""
        return self._latest(self._log()).where("not deleted").select("id", "length", "words", "counts")

    def terms(self) -> DataFrame:
        """``(term, df)``: in how many living documents each word is."""
        return self._read("terms", "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def totals(self) -> DataFrame:
        """One row: documents, length."""
        sums = self._read("totals", "documents bigint, length bigint")
        return sums.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))

    def index(self, k1: float = 1.5, b: float = 0.75) -> bm25.CountedIndex:
        """For ``bm25.search`` and ``bm25.score``; no text is cut again."""
        total = self.totals().first()
        return bm25.CountedIndex(self.documents(), self.terms(), total["documents"], total["length"] / max(total["documents"], 1), k1, b)

    def fold(self, path: str) -> MaintainedCorpus:
        """The same corpus in a new folder, as the one batch that was the last here."""
        last = self._read("totals", "documents bigint, length bigint").agg(F.max("batch")).first()[0] or 0
        out = MaintainedCorpus(self.spark, path, self.id_kind)
        self.documents().withColumn("deleted", F.lit(False)).write.mode("overwrite").parquet(f"{path}/log/batch={last}")
        self.terms().write.mode("overwrite").parquet(f"{path}/terms/batch={last}")
        self.totals().write.mode("overwrite").parquet(f"{path}/totals/batch={last}")
        self.spark.range(1).select(F.lit(True).alias("done")).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={last}")
        return out
