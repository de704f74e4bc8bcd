"""Files, streams and the embedding cache."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import codecs
from lodestar.sources import cache, files
from lodestar.streaming import encode

MAGIC = b"TESTCNT\x00"


def test_jsonl_with_csv_lines(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"id": "a", "vector": [1, 2]}\n\nb,3,4.5\nnonsense\n{"id": "c"}\n')
    rows = {r["id"]: r["vec"] for r in files.read_jsonl(spark, str(tmp_path / "in.jsonl")).collect()}
    assert rows == {"a": [1.0, 2.0], "b": [3.0, 4.5]}


def test_corpus_and_configs(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"doc": 1, "body": "x"}\n')
    assert files.read_corpus(spark, str(tmp_path / "c.jsonl"), "doc", "body").first()["text"] == "x"
    (tmp_path / "config.json").write_text(json.dumps({"architectures": ["BertModel"], "model_type": "bert"}, indent=1))
    assert files.read_model_configs(spark, str(tmp_path / "config.json")).first()["architectures"] == ["BertModel"]


def test_stored_codes(spark, tmp_path):
    df = files.gaussian(spark, 20, 8)
    coded = codecs.encode(df, "int8").select("id", "code.codes", "code.scale")
    stored = files.to_stored(coded, "int8", 8)
    stored.write.parquet(str(tmp_path / "s"))
    back = files.from_stored(spark.read.parquet(str(tmp_path / "s")))
    want = {str(r["id"]): (r["codes"], r["scale"]) for r in coded.collect()}
    assert {r["id"]: (r["codes"], r["scale"]) for r in back.collect()} == want
    assert files.validate(back).first()["valid"]
    assert not files.validate(back.unionByName(back)).first()["valid"]
    assert files.inspect(spark, str(tmp_path / "s")).agg(F.sum("rows")).first()[0] == 20
    assert files.from_ipc(spark, files.to_ipc(back)).count() == 20


@pytest.mark.parametrize("compression", ["none", "zstd", "zlib"])
def test_containers(spark, tmp_path, compression):
    codes, scales = np.arange(-6, 6, dtype=np.int8).reshape(3, 4), np.array([1, 2, 3], np.float32)
    raw = files.container_bytes(codes, scales, MAGIC, b"{}", compression)
    (tmp_path / "a.bin").write_bytes(raw)
    rows = files.read_containers(spark, str(tmp_path / "a.bin"), MAGIC).orderBy("row").collect()
    assert [r["codes"] for r in rows] == codes.tolist() and [r["scale"] for r in rows] == [1, 2, 3]
    with pytest.raises(ValueError):
        files.parse_container(raw, b"OTHERMG\x00")
    with pytest.raises(ValueError):
        files.parse_container(raw[:-1] + bytes([raw[-1] ^ 1]), MAGIC)


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "a.npz", quantized=np.ones((2, 4), np.int8), scales=np.array([1, 2], np.float32), storage_format_version=2)
    assert files.read_npz(spark, str(tmp_path / "a.npz")).count() == 2


def test_results_json(spark, tmp_path):
    found = spark.createDataFrame([(0, 5, 0.9, 1), (0, 7, 0.8, 2)], "query_id int, id int, score double, rank int")
    files.write_results_json(found, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).first()["results"][1]["id"] == 7


def test_cache(spark):
    calls = []
    embed = lambda texts: np.array([[len(t), 1.0] for t in texts])
    texts = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b"), (4, None)], "id int, text string")
    out, table = cache.embed(texts, None, embed, "p", "m", 2)
    assert out.count() == 4 and cache.stats(table).first()["entries"] == 2 and not calls
    again, table = cache.embed(texts, table.cache(), embed, "p", "m", 2)
    assert table.count() == 2 and again.where("vec is not null").count() == 3


def test_stream_equals_batch(spark, tmp_path):
    df = files.gaussian(spark, 50, 8)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = encode.encoded(spark, str(tmp_path / "in"), "id long, vec array<float>", "int8", 1)
    encode.run(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    key = lambda d: sorted((r["id"], tuple(r["code"]["codes"])) for r in d.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(codecs.encode(df, "int8"))


def test_observed(spark):
    df = codecs.decode(codecs.encode(files.gaussian(spark, 10, 8), "int8"), "int8")
    out, seen = encode.observed(df, "decode")
    out.collect()
    assert seen.get["rows"] == 10 and seen.get["mean_cosine"] > 0.99


def test_toy(spark):
    assert files.toy(spark).count() == 3


def test_ivf_codebook_and_datasets(spark, tmp_path):
    from lodestar.operators import search, training
    from lodestar.sources import index

    df = files.gaussian(spark, 120, 16).cache()
    lists = training.ivf_train(df, 4, 4)
    index.save_ivf(search.assign(df, lists), lists, str(tmp_path / "ivf"))
    rows, cents = index.load_ivf(spark, str(tmp_path / "ivf"))
    q = df.limit(3).select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    near = search.ivf_search(q, rows, cents, 1, 1)
    assert all(r["id"] == r["query_id"] for r in near.collect())
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list_id" in plan
    book = training.pq_train(df, 4, 8, 2)
    index.save_codebook(spark, book, str(tmp_path / "cb"), np.eye(16))
    got, turn = index.load_codebook(spark, str(tmp_path / "cb"), True)
    assert np.allclose(got, book) and np.allclose(turn, np.eye(16))
    for codec in (None, "int8", "nf4", "binary"):
        index.save_dataset(df, str(tmp_path / "ds"), codec)
        assert index.load_dataset(spark, str(tmp_path / "ds")).where(F.size("vec") == 16).count() == 120
    found = index.run_pipeline(spark, df, str(tmp_path / "run"), "int8", 4, q, 2, 4)
    assert found.count() == 6 and spark.read.json(str(tmp_path / "run" / "results")).count() == 3
    assert index.with_ids(df.select("vec")).select("id").distinct().count() == 120


def test_transport_config_profiles(spark, tmp_path):
    import base64

    from lodestar.operators import select
    from lodestar.sources import index

    coded = spark.createDataFrame([(1, [1, -1, 127, -127, 0], 0.5)], "id long, codes array<tinyint>, scale float")
    r = index.transport(coded, "base64").first()
    assert np.frombuffer(base64.b64decode(r["codes"]), np.int8).tolist() == [1, -1, 127, -127, 0] and json.loads(r["scale"]) == {"scale": 0.5}
    assert index.transport(coded, "ints").first()["codes"] == [1, -1, 127, -127, 0]
    index.RunConfig("nf4", "fast", extra={"a": 1}).save(spark, str(tmp_path / "cfg"))
    assert index.RunConfig.load(spark, str(tmp_path / "cfg")).codec == "nf4"
    with pytest.raises(ValueError):
        index.RunConfig("nothing")
    select.add_profile(select.Profile("own", 8, 0.9, 99.0, 0.9))
    index.save_profiles(spark, str(tmp_path / "p"))
    select.remove_profile("own")
    index.load_profiles(spark, str(tmp_path / "p"))
    assert "own" in select.PROFILES
    select.remove_profile("own")


def test_text_store(spark, tmp_path):
    from lodestar.operators import retriever, select

    embed = lambda df: select.embed_tokens(df, 64)
    texts = spark.createDataFrame([("a", "red apple pie", {"k": "x"}), ("b", "green apple tart", {"k": "y"}), ("c", "steam engine", {})], "id string, text string, metadata map<string,string>")
    q = spark.createDataFrame([(0, "apple pie"), (1, "engine")], "query_id int, text string")
    s = retriever.TextStore(None, embed).add(texts)
    best = {r["query_id"]: r["id"] for r in s.search(q, 1).collect()}
    assert best == {0: "a", 1: "c"}
    assert {r["id"] for r in s.search(q, 3, [("k", "==", "y")]).collect()} == {"b"}
    assert s.search_mmr(q, 2).count() == 4 and s.search_hybrid(q, 2, 0.5).where("rank = 1 and query_id = 1").first()["id"] == "c"
    assert s.search_many(q, 1).count() == 1 and s.stats().first()["documents"] == 3
    s.save(str(tmp_path / "store"))
    again = s.load(str(tmp_path / "store")).delete(spark.createDataFrame([("a",)], "id string"))
    assert again.rows.count() == 2 and again.add(texts.limit(1)).rows.count() == 3 and again.delete().rows.count() == 0
    bad = lambda *_: 1 / 0
    assert retriever.rrf_retrieve([lambda qs, k: s.search(qs, k), bad], q, 2).count() == 4
    assert "mean" in retriever.report(retriever.self_search(files.toy(spark), files.toy(spark), files.toy(spark)))


def test_upgrade(spark, tmp_path):
    np.savez(tmp_path / "a.npz", quantized=np.ones((3, 4), np.int8), scales=np.ones(3, np.float32))
    assert files.upgrade(spark, str(tmp_path / "a.npz"), str(tmp_path / "t"), dry_run=True).first()["rows"] == 3 and not (tmp_path / "t").exists()
    files.upgrade(spark, str(tmp_path / "a.npz"), str(tmp_path / "t"))
    assert files.validate(spark.read.parquet(str(tmp_path / "t"))).first()["valid"]


def test_commands(spark, tmp_path):
    from lodestar.__main__ import main

    (tmp_path / "v.jsonl").write_text("".join(json.dumps({"id": f"v{i}", "vector": [float(i + 1), 1.0, -float(i)]}) + "\n" for i in range(9)))
    assert main(["compress", str(tmp_path / "v.jsonl"), str(tmp_path / "s"), "--codec", "int8"]) == 0
    assert main(["validate", str(tmp_path / "s")]) == 0 and main(["inspect", str(tmp_path / "s")]) == 0 and main(["audit", str(tmp_path / "v.jsonl")]) == 0
    assert main(["search", str(tmp_path / "s"), str(tmp_path / "v.jsonl"), str(tmp_path / "r"), "-k", "1"]) == 0
    rows = spark.read.json(str(tmp_path / "r")).collect()
    assert len(rows) == 9 and all(r["results"][0]["id"] == r["query_id"] for r in rows)


def test_cache_asks_once_for_each_text(spark, tmp_path):
    """However often the results are read, and by either table."""
    import os

    def embed(texts):
        for t in texts:
            with open(f"{tmp_path}/{os.getpid()}", "a") as f:
                f.write(t + "\n")
        return np.ones((len(texts), 2))

    texts = spark.createDataFrame([(i, f"text {i % 10}") for i in range(30)] + [(99, None)], "id int, text string")
    out, table = cache.embed(texts, None, embed, "p", "m", 2)
    assert out.where("vec is not null").count() == 30 and table.count() == 10 and out.where("vec is null").count() == 1 and table.count() == 10
    more, table = cache.embed(texts.unionByName(spark.createDataFrame([(100, "new")], "id int, text string")), table, embed, "p", "m", 2)
    assert more.count() == 32 and table.count() == 11 and more.count() == 32
    asked = sorted(x for f in tmp_path.iterdir() for x in f.read_text().split("\n") if x)
    assert asked == sorted(["new", *(f"text {i}" for i in range(10))])
