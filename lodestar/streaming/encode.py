"""Encoding and decoding on streams of files, and what a job reports about itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.functions import vec as V
from lodestar.operators import codecs


def encoded(spark: SparkSession, path: str, schema: str, codec: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of Parquet files ``(id, vec, ...)`` with ``code``; a trigger takes so many files at most."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return codecs.encode(rows, codec)


def run(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write a stream to Parquet until its files are used up; a restart goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and window, with late ones taken until the watermark; the same on a stream and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def observed(df: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """``df`` that reports rows, codec ratio inputs and mean cosine of ``vec`` and ``decoded`` as it is computed."""
    seen = Observation(stage)
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.avg(V.cosine(F.col("vec"), F.col("decoded"))).alias("mean_cosine"), F.sum(F.size("vec") * 4).alias("bytes_in"))
    return out, seen
