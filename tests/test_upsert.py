"""Streams with duplicates, late rows, deletions and restarts give the batch result."""

import os

import numpy as np
from pyspark.sql import functions as F

from lodestar.operators.store import last_per_id
from lodestar.streaming.upsert import StreamedEmbeddings, StreamedTable

SCHEMA = "id long, value string, order bigint, deleted boolean"
FILES = [
    [(1, "a", 1, False), (2, "b", 1, False), (2, "b", 1, False), (3, "c", 5, False), (None, "n", 1, False), (9, "n", None, False)],
    [(1, "a2", 2, False), (3, "late", 4, False), (4, "d", 1, True), (2, "b", 1, False)],
    [(4, "d2", 2, False), (1, None, 3, True), (3, "c6", 6, None), (5, "e", 1, False), (5, "e2", 2, False)],
]


def test_upserts(spark, tmp_path):
    put = lambda rows, n: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    table = StreamedTable(spark, str(tmp_path / "t"), SCHEMA)
    assert table.rows().count() == 0
    put(FILES[0], 0)
    table.follow(stream(), str(tmp_path / "at"), once=True).awaitTermination()
    put(FILES[1], 1)
    put(FILES[2], 2)
    table.follow(stream(), str(tmp_path / "at"), once=True).awaitTermination()
    every = spark.createDataFrame([r for f in FILES for r in f], SCHEMA).where("id is not null and order is not null")
    want = last_per_id(every, "order").where(~F.coalesce("deleted", F.lit(False))).drop("deleted")
    assert sorted(table.rows().collect()) == sorted(want.collect()) and want.count() == 4
    logged = spark.read.parquet(f"{tmp_path}/t/log")
    assert logged.where("value = 'late'").count() == 0 and logged.where("id = 2").count() == 1
    table.apply(spark.createDataFrame(FILES[2], SCHEMA), 2)  # replayed
    table.apply(spark.createDataFrame(FILES[1], SCHEMA), 99)  # all of it late
    assert sorted(table.rows().collect()) == sorted(want.collect())


def test_streamed_embeddings_ask_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def embed(texts):
        with open(calls / str(os.getpid()), "a") as f:
            f.writelines(t + "\n" for t in texts)
        return np.array([[len(t), 1.0] for t in texts])

    put = lambda texts, n: spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = lambda: spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    kept = StreamedEmbeddings(spark, str(tmp_path / "e"), embed, "p", "m", 2)
    put(["a", "bb", "a", None], 0)
    kept.follow(stream(), str(tmp_path / "at"), once=True).awaitTermination()
    put(["bb", "ccc"], 1)
    kept.follow(stream(), str(tmp_path / "at"), once=True).awaitTermination()
    again = spark.createDataFrame([("bb",), ("ccc",)], "text string")
    kept.apply(again, 1)  # replayed
    asked = sorted(x for f in calls.iterdir() for x in f.read_text().split("\n") if x)
    assert asked == ["a", "bb", "ccc"] and kept.entries().count() == 3
    out = {r["text"]: r["vec"] for r in kept.embedded(spark.createDataFrame([("a",), ("zz",), (None,)], "text string")).collect()}
    assert out["zz"] is None and out[None] is None and abs(out["a"][0] - np.sqrt(0.5)) < 1e-6
