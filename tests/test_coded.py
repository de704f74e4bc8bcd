"""Trained codecs: codes as tables, and search on codes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import coded, codecs, training
from lodestar.operators.facade import Compressor

RNG = np.random.default_rng(8)
X = (RNG.normal(size=(300, 24)) + 2 * RNG.normal(size=(6, 24))[RNG.integers(0, 6, 300)]).astype(np.float32)


def made(name):
    if name == "rq":
        books = tuple(RNG.normal(size=(4, 16, 6)) * s for s in (2.0, 1.0, 0.5))
        return coded.residual(training.ResidualCodebook(books, 22))  # padded from 22
    if name == "opq":
        turn, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(24, 24)))
        return coded.rotated(turn, np.random.default_rng(2).normal(size=(6, 16, 4)).astype(np.float32))
    if name == "pq":
        return coded.rotated(None, np.random.default_rng(2).normal(size=(6, 16, 4)).astype(np.float32))
    if name == "nf4-mixed":
        return coded.mixed(24, [3, 9, 20])
    rng = np.random.default_rng(3)
    return coded.autoencoder(training.Autoencoder([rng.normal(size=s) for s in ((24, 10), (10, 5), (5, 10), (10, 24))], 4.0))


@pytest.fixture(scope="module")
def rows(spark):
    odd = [(1000, None), (1001, []), (1002, [1.0, 2.0]), (1003, [float("nan")] * 24), (1004, [0.0] * 24)]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(X)] + odd, "id long, vec array<float>").repartition(3).cache()


@pytest.mark.parametrize("name", ["rq", "opq", "pq", "nf4-mixed", "autoencoder"])
def test_scores_on_codes_equal_scores_of_decoded_vectors(spark, rows, name):
    codec = made(name)
    df = rows.withColumn("vec", F.slice("vec", 1, codec.dims)) if codec.dims < 24 else rows
    table = coded.encode(df, codec)
    assert table.where("code is null").count() == 4 and table.columns == ["id", "vec", "code"]
    back = coded.decode(table, codec).where("code is not null").select("id", "decoded").collect()
    y = {r["id"]: np.array(r["decoded"], np.float64) for r in back}
    assert all(len(v) == codec.dims for v in y.values()) and coded.decode(table, codec).where("decoded is null").count() == 4
    norms = {r["id"]: r["n"] for r in table.where("code is not null").select("id", F.element_at("code.more", -1).alias("n")).collect()}
    assert all(abs(norms[i] - v @ v) < 1e-3 * (1 + v @ v) for i, v in y.items())
    q = X[:4, : codec.dims].astype(np.float64)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(8, None), (9, [1.0])], "query_id int, query array<double>")
    cosine = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) if a.any() and b.any() else 0.0
    for metric, f in (("dot", lambda a, b: a @ b), ("l2", lambda a, b: -np.linalg.norm(a - b)), ("cosine", cosine)):
        found = coded.topk(queries, table, codec, 7, metric).collect()
        assert len(found) == 28
        for r in found:
            assert abs(r["score"] - f(y[r["id"]], q[r["query_id"]])) < 1e-4
        for i in range(4):
            want = sorted((f(v, q[i]) for v in y.values()), reverse=True)[:7]
            assert np.allclose([r["score"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == i], want, atol=1e-4)
    assert coded.topk(queries, table, codec, 7, where=F.lit(False)).count() == 0


@pytest.mark.parametrize("profile", ["rq-4", "opq-4", "nf4-mixed", "autoencoder-6"])
def test_compressor_has_codes_for_trained_profiles(spark, rows, profile):
    tool = Compressor(profile, k=16)
    stored = tool.compress(rows)
    assert "vec" not in stored.columns and stored.where("code is null").count() == 4
    whole = {r["id"]: r["decoded"] for r in tool.roundtrip(rows).collect()}
    back = {r["id"]: r["vec"] for r in tool.decompress(stored).collect()}
    assert back == whole
    queries = rows.where("id < 5").select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    hits = tool.search(queries, stored, 10).groupBy("query_id").agg(F.collect_list("id").alias("ids")).collect()
    assert len(hits) == 5 and sum(r["query_id"] in r["ids"] for r in hits) >= (1 if profile.startswith("auto") else 4)
    assert tool.codec().ratio() > 1


def test_many_queries_meet_codes_in_blocks(spark, rows, monkeypatch):
    from lodestar.operators import scan

    codec = made("opq")
    table = coded.encode(rows, codec)
    queries = rows.where("id < 20").select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    want = sorted(coded.topk(queries, table, codec, 3, "l2").collect())
    monkeypatch.setattr(scan, "QUERY_ROWS", 7)
    got = sorted(coded.topk(queries, table, codec, 3, "l2").collect())
    assert [(r["query_id"], r["id"]) for r in got] == [(r["query_id"], r["id"]) for r in want]


def test_distance_of_a_query_and_a_code(spark, rows):
    """Every plain codec has a distance and bits; the distance is that of the decoded vector."""
    from lodestar.functions import vec as V

    df = rows.where("id < 20").withColumn("q", F.reverse("vec"))
    for name, codec in codecs.CODECS.items():
        table = codecs.decode(codecs.encode(df, name), name)
        gap = table.select(codec.dist_to_query(F.col("q"), F.col("code")).alias("d"), (1 - V.cosine(F.col("q"), F.col("decoded"))).alias("e")).collect()
        assert all(abs(r["d"] - r["e"]) < 1e-6 for r in gap), name
        assert codec.bits_per_dim(64) == pytest.approx(32 / codec.ratio(64))
