"""Sessions and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "lodestar", **conf: str) -> SparkSession:
    """A session with adaptive execution and Arrow on; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as (id, vec, label)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def valid(df: DataFrame, dims: int, vec: str = "vec") -> DataFrame:
    """Rows whose vector has ``dims`` finite numbers; the others are left out."""
    return df.where((F.size(vec) == dims) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def dimension(df: DataFrame, vec: str = "vec") -> int:
    """Most common length of the vectors, the smallest of equally common ones; a table without vectors is an error."""
    row = df.where(F.size(vec) > 0).groupBy(F.size(vec).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if row is None:
        raise ValueError("no vector to take the dimension from")
    return row["d"]
