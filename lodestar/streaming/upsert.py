"""Streams of upserts and deletions into a table, and embeddings of a stream of texts.

Of every batch the rows that are newer than what is known of their ids go to a log, a folder
for each batch; a row that comes late, or again, is left out, and a batch that is replayed overwrites its
own.  The log is the state: a restart needs nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.functions.text import cache_key
from lodestar.operators.store import last_per_id
from lodestar.sources import cache
from lodestar.staging import stage

def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)  # noqa: SLF001


@dataclass(frozen=True)
class StreamedTable:
    """A table in a folder that follows a stream of ``schema``, which has ``id``, ``order`` and ``deleted``."""

    spark: SparkSession
    path: str
    schema: str

    def _log(self) -> DataFrame:
        if not _exists(self.spark, f"{self.path}/log"):
            return self.spark.createDataFrame([], f"{self.schema}, batch bigint")
        return self.spark.read.schema(f"{self.schema}, batch bigint").parquet(f"{self.path}/log")

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Log the newest row of each id, if it is newer than all of earlier batches.

        Batches come in the order of their ids; one that comes again replaces what it logged.  Rows with a null id or order are left
        out; of rows of one id and order one is taken.
        """
        rows = last_per_id(changes.where("id is not null and order is not null"), "order")
        ids = rows.select("id")
        known = self._log().where(F.col("batch") < batch).join(ids, "id", "left_semi").groupBy("id").agg(F.max("order").alias("_known"))
        fresh = rows.join(known, "id", "left").where(F.col("_known").isNull() | (F.col("order") > F.col("_known")))
        fresh.select(changes.columns).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")

    def follow(self, changes: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        writer = changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()

    def rows(self) -> DataFrame:
        """The newest version of every id that isn't deleted."""
        return last_per_id(self._log().drop("batch"), "order").where(~F.coalesce("deleted", F.lit(False))).drop("deleted")


@dataclass(frozen=True)
class StreamedEmbeddings:
    """A cache of embeddings in a folder that is filled by a stream of texts; ``function`` as in ``cache.embed``."""

    spark: SparkSession
    path: str
    function: Callable[[list[str]], np.ndarray]
    provider: str
    model: str
    dims: int

    def entries(self) -> DataFrame:
        """``(key, vec)``"""
        if not _exists(self.spark, f"{self.path}/entries"):
            return self.spark.createDataFrame([], "key string, vec array<float>")
        return self.spark.read.schema("key string, vec array<float>, batch bigint").parquet(f"{self.path}/entries").drop("batch")

    def apply(self, texts: DataFrame, batch: int) -> None:
        """Ask for the texts of a batch ``(text)`` that no batch has asked for; a replayed batch that had been written asks for none."""
        known = self.entries()
        seen = texts.select("text").where("text is not null").distinct()
        _, whole = cache.embed(seen, known, self.function, self.provider, self.model, self.dims)
        new = stage(whole.join(known.select("key"), "key", "left_anti"), "embedded-new")
        if new.limit(1).count():
            new.write.mode("append").parquet(f"{self.path}/entries/batch={batch}")

    def follow(self, texts: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        writer = texts.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()

    def embedded(self, texts: DataFrame) -> DataFrame:
        """``texts`` with ``vec``, null where the text hasn't come by."""
        keyed = texts.withColumn("key", cache_key(F.lit(self.provider), F.lit(self.model), F.col("text")))
        return keyed.join(self.entries(), "key", "left").drop("key")
