"""Stored indexes, codebooks, profiles and configurations.

An inverted file is a directory with ``centroids`` and ``rows``, the latter partitioned
by list, so that a search reads only the lists that it probes.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import codecs, search, select, training


def save_ivf(rows: DataFrame, centroids: DataFrame, path: str) -> None:
    """Rows with ``list_id``, a directory per list."""
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    rows.repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/rows")


def load_ivf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, centroids)"""
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/centroids")


def save_codebook(spark: SparkSession, book: np.ndarray, path: str, rotation: np.ndarray | None = None) -> None:
    """Rows (m, k, centroid) and, beside them, the rotation's rows."""
    rows = [(m, k, [float(x) for x in book[m, k]]) for m in range(book.shape[0]) for k in range(book.shape[1])]
    spark.createDataFrame(rows, "m int, k int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    if rotation is not None:
        spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rotation)], "i int, row array<double>").write.mode("overwrite").parquet(f"{path}/rotation")


def load_codebook(spark: SparkSession, path: str, rotated: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(codebook, rotation or None); a codebook has at most parts x 256 rows."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("m", "k").collect()
    book = np.array([r["centroid"] for r in rows]).reshape(rows[-1]["m"] + 1, rows[-1]["k"] + 1, -1)
    turn = np.array([r["row"] for r in spark.read.parquet(f"{path}/rotation").orderBy("i").collect()]) if rotated else None
    return book, turn


def save_dataset(df: DataFrame, path: str, codec: str | None = None) -> None:
    """Vectors as they are or as codes; the codec's name goes with the rows."""
    out = df.withColumn("codec", F.lit("none")) if codec is None else codecs.encode(df, codec).drop("vec").withColumn("codec", F.lit(codec))
    out.write.mode("overwrite").parquet(path)


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """``(id, vec, ...)`` of a stored data set of any codec, decoded on reading."""
    df = spark.read.parquet(path)
    first = df.select("codec").first()
    if first is None or first["codec"] == "none":
        return df.drop("codec")
    return codecs.decode(df, first["codec"], out="vec").drop("code", "codec")


def with_ids(df: DataFrame, prefix: str = "vec_") -> DataFrame:
    """Rows with ids ``vec_0``, ``vec_1``, ... if they have none; numbers are unique, not consecutive."""
    if "id" in df.columns:
        return df
    return df.withColumn("id", F.concat(F.lit(prefix), F.monotonically_increasing_id().cast("string")))


def transport(coded: DataFrame, form: str) -> DataFrame:
    """Codes as other stores take them: ``base64`` with the scale as JSON, or ``ints``."""
    if form == "ints":
        return coded.select("id", F.transform("codes", lambda x: x.cast("int")).alias("codes"), "scale")
    if form == "base64":
        hexed = F.array_join(F.transform("codes", lambda x: F.lpad(F.hex((x.cast("int") + 256) % 256), 2, "0")), "")
        return coded.select("id", F.base64(F.unhex(hexed)).alias("codes"), F.to_json(F.struct("scale")).alias("scale"))
    raise ValueError(f"unknown form {form!r}")


@dataclass
class RunConfig:
    """Checked settings of a compression run."""

    codec: str = "int8"
    profile: str = "balanced"
    group_size: int = 0
    dims: int | None = None
    extra: dict = field(default_factory=dict)
    #: When the configuration was made, in UTC (ISO 8601).
    created_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat(timespec="seconds"))

    def __post_init__(self) -> None:
        if self.codec not in codecs.CODECS:
            raise ValueError(f"unknown codec {self.codec!r}")
        if self.profile not in select.PROFILES:
            raise ValueError(f"unknown profile {self.profile!r}")
        if self.group_size < 0:
            raise ValueError("group_size must not be negative")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> RunConfig:
        return RunConfig(**json.loads(spark.read.text(path).first()["value"]))


def save_profiles(spark: SparkSession, path: str) -> None:
    select.profiles_table(spark).write.mode("overwrite").json(path)


def load_profiles(spark: SparkSession, path: str) -> None:
    """Add the profiles of a file to the known ones."""
    for r in spark.read.json(path).collect():
        select.add_profile(select.Profile(r["name"], int(r["bits"]), float(r["range_factor"]), float(r["percentile"]), float(r["least_cosine"])))


def run_pipeline(spark: SparkSession, vectors: DataFrame, out: str, codec: str = "int8", lists: int = 0, queries: DataFrame | None = None, k: int = 10, probes: int = 8) -> DataFrame | None:
    """File to file: encode and store the vectors, build and store an inverted file, answer the queries.

    ``lists`` 0 searches exactly.  Answers come back, and are written to ``out/results``.
    """
    from lodestar.sources.files import write_results_json

    save_dataset(vectors, f"{out}/codes", codec)
    db = load_dataset(spark, f"{out}/codes").select("id", "vec")
    if lists:
        centroids = training.ivf_train(db, lists)
        save_ivf(search.assign(db, centroids), centroids, f"{out}/index")
    if queries is None:
        return None
    if lists:
        rows, centroids = load_ivf(spark, f"{out}/index")
        found = search.ivf_search(queries, rows, centroids, k, probes)
    else:
        found = search.knn(queries, db, k)
    write_results_json(found, f"{out}/results")
    return found
