"""Operators against NumPy and against what must always hold."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.functions import vec as V
from lodestar.operators import arrow, bm25, codecs, quality, ranking, scan, search, select, store, training


@pytest.fixture(scope="module")
def gauss(spark):
    x = np.random.default_rng(0).standard_normal((200, 64)).astype(np.float32)
    x[3] = 0
    return x, spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<float>").cache()


def column(df, name, order="id"):
    return np.array([r[name] for r in df.orderBy(order).select(name).collect()])


def cosines(a, b):
    n = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    return np.divide((a * b).sum(1), n, out=np.ones(len(a)), where=n > 0)


def test_int8_equals_numpy(gauss):
    x, df = gauss
    scale = np.where(np.abs(x).max(1) == 0, np.float32(1), np.abs(x).max(1) / np.float32(127)).astype(np.float32)
    want = np.clip(np.rint(x / scale[:, None]), -127, 127)
    assert (column(df.select("id", codecs.int8(F.col("vec"))["codes"].alias("c")), "c") == want).all()


def test_nf4_equals_numpy(gauss):
    x, df = gauss
    scale = np.abs(x).max(1, keepdims=True)
    want = np.searchsorted(np.array(codecs.nf4_thresholds(), np.float32), x / np.where(scale == 0, np.float32(1), scale))
    assert (column(df.select("id", codecs.nf4(F.col("vec"))["codes"].alias("c")), "c") == want).all()


@pytest.mark.parametrize("name,least", [("int8", 0.999), ("int8_grouped", 0.999), ("int8_adaptive", 0.97), ("int4", 0.97), ("nf4", 0.985), ("sq3", 0.9), ("sq2", 0.7), ("int2", 0.6), ("binary", 0.75)])
def test_roundtrip(gauss, name, least):
    x, df = gauss
    y = column(codecs.decode(codecs.encode(df, name), name), "decoded")
    live = np.arange(len(x)) != 3
    assert y.shape == x.shape and cosines(x[live], y[live]).mean() > least


def test_odd_dimensions(spark):
    df = spark.createDataFrame([(1, [0.5, -1.0, 0.25])], "id long, vec array<float>")
    for name in codecs.CODECS:
        assert len(codecs.decode(codecs.encode(df, name), name).first()["decoded"]) == 3


def test_empty_zero_and_null_vectors(spark):
    df = spark.createDataFrame([(1, []), (2, [0.0, 0.0]), (3, None)], "id long, vec array<float>")
    for name in codecs.CODECS:
        rows = {r["id"]: r["decoded"] for r in codecs.decode(codecs.encode(df.where("size(vec) <> 0 or vec is null"), name), name).collect()}
        assert len(rows[2]) == 2 and (name in ("binary", "sq2", "sq3") or rows[2] == [0.0, 0.0])
    per = {r["id"]: r["cosine"] for r in quality.per_vector(df.withColumn("decoded", F.col("vec"))).collect()}
    assert per[2] == 0


def test_pack_and_unpack(spark):
    df = spark.createDataFrame([(1, [3, 0, 1, 2, 3, 3, 1])], "id long, c array<int>")
    for bits, top in ((2, 4), (4, 16)):
        back = df.select(codecs.unpacked(codecs.packed(F.col("c"), bits), bits, 7).alias("u")).first()["u"]
        assert back == [3, 0, 1, 2, 3, 3, 1] and max(back) < top


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-100, 100, width=32), min_size=2, max_size=12))
def test_scalar_codecs_stay_in_range(spark, values):
    df = spark.createDataFrame([(1, values)], "id long, vec array<float>")
    v = F.col("vec")
    r = df.select(codecs.int8(v)["codes"].alias("a"), codecs.nf4(v)["codes"].alias("b"), codecs.sq(v, 2)["codes"].alias("c"), codecs.sq(v, 3)["codes"].alias("d")).first()
    assert all(-127 <= x <= 127 for x in r["a"]) and all(0 <= x <= 15 for x in r["b"]) and all(0 <= x <= 3 for x in r["c"]) and all(0 <= x <= 7 for x in r["d"])


def test_bf16_and_mixed():
    x = np.random.default_rng(1).standard_normal((50, 32)).astype(np.float32)
    assert np.abs(training.bf16_restore(training.bf16(x)) / x - 1).max() < 1 / 128
    assert cosines(x, training.nf4_mixed(x, [0, 5])).mean() > 0.985


def test_minmax(gauss):
    x, df = gauss
    m = codecs.minmax(df)
    back = column(m.select("id", codecs.minmax_decode(F.col("codes"), F.col("lows"), F.col("highs")).alias("y")), "y")
    assert np.abs(back - x).max() <= (x.max(0) - x.min(0)).max() / 255


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2", "l1", "hamming"])
def test_knn_is_exact(gauss, metric):
    x, df = gauss
    q = df.where("id in (0, 7, 50)").select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    got = {(r["query_id"], r["rank"]): r["id"] for r in search.knn(q, df, 5, metric).collect()}
    for i in (0, 7, 50):
        s = scan.scorer(metric)(x.astype(float), x[i : i + 1].astype(float))[:, 0]
        assert [got[i, r] for r in range(1, 6)] == np.lexsort((np.arange(len(x)), -s))[:5].tolist()


def test_knn_edges(gauss, spark):
    _, df = gauss
    q = df.limit(2).select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    assert search.knn(q, df, 1000).count() == 2 * df.count()
    assert search.knn(q.limit(0), df, 3).count() == 0
    ties = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)] + [(9, None), (10, [None, 1.0])], "id long, vec array<float>")
    one = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query array<float>")
    assert [r["id"] for r in search.knn(one, ties, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_knn_blocks_and_ties(gauss, spark, monkeypatch):
    """Blocks of queries against parts of rows give what one multiplication gives, in every search."""
    _, df = gauss
    q = df.where("id < 9").select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    lists, book = training.ivf_train(df, 4, 3), training.pq_train(df, 16, 8, 2)
    index = search.pq_encode(search.assign(df, lists), book)
    half = df.where("id % 3 = 0")

    def rows():
        found = [search.knn(q, df, 4, include_self=False), search.ivf_search(q, index, lists, 4, 2), search.adc_topk(q, index, book, 4), search.ivf_pq_search(q, index, lists, book, 4, 2), search.hamming_topk(q, df, 4), search.all_scores(q, half), search.score_ends(q, df), search.score_sums(q, df)]
        return [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f.collect()) for f in found]

    whole = rows()
    assert all(len(r) for r in whole)
    monkeypatch.setattr(scan, "QUERY_ROWS", 2)
    monkeypatch.setattr(scan, "QUERY_NUMBERS", 200)
    monkeypatch.setattr(scan, "PART_ROWS", 50)
    monkeypatch.setattr(scan, "SCORED_ROWS", 16)
    assert rows() == whole
    same = spark.range(500).select("id", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("vec"))
    one = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query array<float>")
    assert [r["id"] for r in search.knn(one, same, 3).orderBy("rank").collect()] == [0, 1, 2]
    monkeypatch.setattr(search, "CENTROID_NUMBERS", 10)
    assert sorted(search.assign(df, lists).select("id", "list_id").collect()) == sorted(index.select("id", "list_id").collect())


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2", "l1", "hamming"])
@pytest.mark.parametrize("blocks", [False, True])
def test_knn_beside_odd_rows(spark, metric, blocks, monkeypatch):
    """Non-finite rows hide no neighbour, and every length of vectors is searched."""
    if blocks:
        monkeypatch.setattr(scan, "QUERY_ROWS", 1)
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((60, 6)), rng.standard_normal((25, 9))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, v.tolist()) for i, v in enumerate(y)]
    odd = [(200, [float("nan")] * 6), (201, [float("inf")] + [1.0] * 5), (202, None), (203, []), (204, [None] * 6), (205, [float("nan")] + [1.0] * 8)]
    df = spark.createDataFrame(rows + odd, "id long, vec array<double>").repartition(3)
    q = spark.createDataFrame([(1, rows[0][1]), (2, rows[70][1]), (3, [float("nan")] * 6), (4, [1.0]), (5, None)], "query_id long, query array<double>")
    got = {}
    for r in search.knn(q, df, 4, metric).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    want = lambda m, v, first: (first + np.lexsort((np.arange(len(m)), -scan.scorer(metric)(m, v[None])[:, 0]))[:4]).tolist()
    assert got == {1: want(x, x[0], 0), 2: want(y, y[10], 100)}


def test_hybrid_without_ranking_all(gauss, spark):
    """Candidates are enough: the same as fusing two whole lists."""
    _, df = gauss
    q = df.where("id < 3").select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    for keep in ("id % 5 = query_id", "id < 10", "id >= 0", "id = 1 and query_id = 1"):
        sparse = df.select("id").crossJoin(q.select("query_id")).where(keep).select("query_id", "id", ((F.col("id") * 7 % 11) + 0.5).alias("score"))
        for alpha in (0.0, 0.3, 1.0):
            rows = lambda d: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in d.collect())
            assert rows(ranking.hybrid_search(q, df, sparse, 5, alpha)) == rows(ranking.hybrid(search.all_scores(q, df), sparse, 5, alpha)), (keep, alpha)


def test_full_probe_is_exact(gauss):
    _, df = gauss
    lists = training.ivf_train(df, 8, 5)
    q = df.where("id in (1, 2)").select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    index = search.assign(df, lists)
    ids = lambda d: [(r["query_id"], r["id"]) for r in d.orderBy("query_id", "rank").collect()]
    assert ids(search.ivf_search(q, index, lists, 5, 8)) == ids(search.knn(q, df, 5))


def test_product_codes(gauss):
    x, df = gauss
    book = training.pq_train(df, 16, 32, 8)
    y = training.pq_restore(training.pq_assign(x.astype(float), book), book)
    live = np.arange(len(x)) != 3
    assert book.shape == (16, 32, 4) and cosines(x[live], y[live]).mean() > 0.75
    coded = search.pq_encode(df, book)
    assert (column(coded, "codes") == training.pq_assign(x.astype(float), book)).all()
    expression = df.select("id", search.pq_codes(F.col("vec"), book.tolist()).alias("c"))
    assert (column(expression, "c") == training.pq_assign(x.astype(float), book)).all()
    near = search.adc_topk(df.limit(1).select(F.col("id").alias("query_id"), F.col("vec").alias("query")), coded, book, 5).orderBy("rank").collect()
    assert [r["distance"] for r in near] == sorted(r["distance"] for r in near)


def test_residual_passes_improve(gauss):
    x, df = gauss
    means = []
    for passes in (1, 3):
        model = training.rq_train(df, passes, 10, 32, 5)  # 64 dimensions aren't a multiple of 10
        means.append(cosines(x, model.decode(model.encode(x.astype(float))))[4:].mean())
    assert means[0] > 0.5 and means[1] > means[0] + 0.1


def test_rotation_is_orthogonal(gauss):
    _, df = gauss
    rotation, _ = training.opq_train(df, 8, 16, 2)
    assert np.allclose(rotation @ rotation.T, np.eye(64), atol=1e-8)


def test_pca(gauss):
    x, df = gauss
    mean, parts = training.pca(df, 2)
    c = np.cov(x.astype(float).T, bias=True)
    assert np.allclose(mean, x.mean(0), atol=1e-5) and np.allclose(np.abs(parts @ np.linalg.eigh(c)[1][:, ::-1][:, :2]), np.eye(2), atol=1e-3)


def test_rrf(spark):
    one = spark.createDataFrame([(0, "a", 0), (0, "b", 1), (0, "a", 2)], "query_id int, id string, rank int")
    two = spark.createDataFrame([(0, "b", 0)], "query_id int, id string, rank int")
    got = {r["id"]: r["score"] for r in ranking.rrf([one, two]).collect()}
    assert got == {"a": pytest.approx(1 / 61), "b": pytest.approx(1 / 62 + 1 / 61)}


def test_hybrid_golden(spark):
    rows = [("doc_a", "the quick brown fox jumps", [1.0, 0.0, 0.0]), ("doc_b", "machine learning neural networks", [0.0, 1.0, 0.0]), ("doc_c", "quick fox machine learning", [0.5, 0.5, 0.0]), ("doc_d", "unrelated completely different text", [0.0, 0.0, 1.0])]
    docs = spark.createDataFrame(rows, "id string, text string, vec array<float>")
    q = spark.createDataFrame([(0, "machine learning", [1.0, 0.0, 0.0])], "query_id int, text string, query array<float>")
    dense = docs.crossJoin(q.select("query_id", "query")).select("query_id", "id", V.cosine(F.col("query"), F.col("vec")).alias("score"))
    sparse = bm25.score(bm25.build(docs), q.select("query_id", "text"))
    first = lambda a: ranking.hybrid(dense, sparse, 4, a).orderBy("rank").first()["id"]
    assert first(1.0) == "doc_a" and first(0.0) in ("doc_b", "doc_c") and first(7.0) == "doc_a"
    scores = [r["score"] for r in ranking.hybrid(dense, sparse, 4, 0.5).collect()]
    assert all(0 <= s <= 1 for s in scores)


def test_bm25_docs_example(spark):
    docs = spark.createDataFrame([("a", "the quick brown fox"), ("b", "the lazy dog"), ("c", "fox over the dog")], "id string, text string")
    q = spark.createDataFrame([(0, "Fox dog!"), (1, ""), (2, "zebra")], "query_id int, text string")
    got = bm25.search(bm25.build(docs), q, 2).orderBy("rank").collect()
    assert [r["query_id"] for r in got] == [0, 0] and got[0]["id"] == "c"


def test_mmr(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 2, [0.99, 0.01]), (0, 3, [0.6, 0.8])]
    near = spark.createDataFrame(rows, "query_id int, id int, vec array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, query array<float>")
    pick = lambda b: [r["id"] for r in ranking.mmr(q, near, 3, b).orderBy("rank").collect()]
    assert pick(1.0) == [1, 2, 3] and pick(0.3)[:2] == [1, 3]


def test_rerank_unknown_ids(spark):
    cand = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.8), (0, 99, 0.95)], "query_id int, id int, score double")
    st_ = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, vec array<float>")
    q = spark.createDataFrame([(0, [0.0, 1.0])], "query_id int, query array<float>")
    assert [r["id"] for r in ranking.cosine_rerank(q, cand, st_, 5).orderBy("rank").collect()] == [2, 1]
    assert {r["id"] for r in ranking.rrf_rerank(q, cand, st_, 5).collect()} == {1, 2, 99}


def test_store_policies(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "y")], "id int, v string")
    got = lambda p: sorted((r["id"], r["v"]) for r in store.write(old, new, p).collect())
    assert got("skip") == [(1, "a"), (2, "b"), (3, "y")] and got("overwrite") == [(1, "a"), (2, "x"), (3, "y")]
    with pytest.raises(ValueError):
        got("fail")
    with pytest.raises(KeyError):
        store.fetch(old, spark.createDataFrame([(9,)], "id int"))
    assert store.alive(old, store.tombstone(None, new)).count() == 1


def test_renumbering_in_cells(spark, monkeypatch):
    monkeypatch.setattr(store, "CELL_ROWS", 30)
    dead = spark.range(0, 500, 3)
    rows = store.compact(spark.range(500), dead, renumber=True).orderBy("id").collect()
    assert [r["new_id"] for r in rows] == list(range(len(rows)))
    named = spark.range(500).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"))
    rows = store.compact(named, named.limit(0), renumber=True).collect()
    assert sorted(r["new_id"] for r in rows) == list(range(500))


def test_filters(spark):
    df = spark.createDataFrame([(1, {"k": "a"}), (2, {"k": "b"}), (3, {})], "id int, m map<string,string>")
    ids = lambda *c: sorted(r["id"] for r in df.where(search.metadata_filter(list(c), "m")).collect())
    assert ids(("k", "==", "a")) == [1] and ids(("k", "!=", "a")) == [2, 3] and ids(("k", "==", None)) == [3]
    with pytest.raises(ValueError):
        ids(("k", ">", "a"))


def test_text_functions(spark):
    df = spark.createDataFrame([('  "Fox!" the -dog- ...',)], "t string")
    assert df.select(X.tokens(F.col("t")).alias("x")).first()["x"] == ["fox", "the", "dog"]
    assert df.select(X.parse_vector(F.lit("1, x,2.5")).alias("x")).first()["x"] == [1.0, 2.5]


def test_metrics_of_equal_vectors(gauss):
    _, df = gauss
    m = quality.metrics(df.where("id <> 3").withColumn("decoded", F.col("vec"))).first()
    assert m["mse"] == 0 and m["snr_db"] == float("inf") and m["ssim"] == pytest.approx(1) and m["grade"].startswith("A+")


def test_selection(gauss, spark):
    _, df = gauss
    live = df.where("id <> 3")
    assert select.auto_select(live, 0.999, 3.0).first()["mode"] in ("pq_96", "pq_48", "int8")
    assert select.auto_select(live, family="gte").first()["mode"] == "int8"
    assert select.grid_search(live).count() == 25
    cfg = spark.createDataFrame([(["BertModel"],), (["Qwen2Model"],), (None,), (["Other"],)], "architectures array<string>")
    assert [r["method"] for r in select.families(cfg).collect()] == ["nf4", "int8", "auto", "auto"]
    with pytest.raises(ValueError):
        select.Profile("bad", 9, 1.0, 100.0, 0.9)


@pytest.mark.parametrize("name", ["int8", "nf4", "sq2", "sq3"])
def test_arrow_codecs_equal_expressions(gauss, name):
    from lodestar.operators import arrow

    _, df = gauss
    slow, fast = codecs.decode(codecs.encode(df, name), name), arrow.decode(arrow.encode(df, name), name)
    for c in ("code.codes", "code.scale", "decoded"):
        assert (column(slow.select("id", F.col(c).alias("c")), "c") == column(fast.select("id", F.col(c).alias("c")), "c")).all()


def test_ann_index(spark, tmp_path):
    from lodestar.operators.ann import AnnIndex
    from lodestar.sources.files import gaussian

    df = gaussian(spark, 500, 16).cache()
    index = AnnIndex.build(df, 16)
    q = df.where("id < 5").select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    first = lambda i: {r["query_id"]: r["id"] for r in i.search(q, 1).collect()}
    assert first(index) == {i: i for i in range(5)}
    gone = index.delete(df.where("id = 2"))
    assert first(gone)[2] != 2 and gone.stats().first()["deleted"] == 1 and gone.compact().stats().first()["total"] == 499
    assert first(gone.add(df.where("id = 2")))[2] == 2
    assert index.recall_estimate(20, 5, 500).first()["recall"] > 0.9
    assert {r["id"] % 2 for r in index.search(q, 3, where=F.col("id") % 2 == 1).collect()} == {1}
    assert index.search_for_recall(q, 5, 0.5).count() == 5
    gone.save(str(tmp_path / "i"))
    assert AnnIndex.load(spark, str(tmp_path / "i")).stats().first()["total"] == 499


@pytest.mark.parametrize("rows", [500, 2500, 6000])
def test_ann_recall_at_every_size(spark, rows):
    """All rows with ids divisible by 50 against exact search."""
    from lodestar.operators.ann import AnnIndex
    from lodestar.sources.files import gaussian

    df = gaussian(spark, rows, 16).cache()
    index = AnnIndex.build(df, 16)
    q = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    truth = search.knn(q, df.select("id", "vec"), 10)
    assert q.count() == rows // 50
    assert quality.recall_estimate(quality.recall(truth, index.search(q), 10), 10).first()["recall"] >= 0.9
    assert index.probes(10) < 16 and index.delete(df.where("id % 50 = 0")).probes(10) == 16
    assert index.probes(10, F.col("id") < 0) == 16


@pytest.mark.parametrize("profile,least", [("int8", 0.999), ("nf4-mixed", 0.98), ("pq-16", 0.75), ("opq-16", 0.7), ("rq-16", 0.95), ("autoencoder-32", 0.3)])
def test_compressor(gauss, profile, least):
    from lodestar.operators.facade import Compressor

    _, df = gauss
    live = df.where("id <> 3")
    c = Compressor(profile, k=32)
    assert quality.mean_cosine(c.roundtrip(live)).first()[0] > least and c.ratio() > 1
    back = c.decompress(c.compress(live)).select("id", F.col("vec").alias("decoded"))
    assert quality.mean_cosine(live.join(back, "id")).first()[0] > least
    with pytest.raises(ValueError):
        Compressor("nothing").fit(live)


def test_training_beside_odd_rows(gauss, spark):
    """Rows that aren't finite vectors of the most common length change nothing; none at all is an error."""
    _, df = gauss
    odd = spark.createDataFrame([(9001, None), (9002, []), (9003, [float("nan")] * 64), (9004, [1.0, 2.0]), (9005, [None] * 64)], "id long, vec array<float>")
    mixed = df.select("id", "vec").unionByName(odd)
    assert np.allclose(training.kmeans(mixed, 5, 3), training.kmeans(df, 5, 3))
    assert np.allclose(training.pq_train(mixed, 16, 8, 2), training.pq_train(df, 16, 8, 2))
    assert np.allclose(training.pca(mixed, 2)[1], training.pca(df, 2)[1])
    book = training.pq_train(df, 16, 8, 2)
    assert search.pq_encode(mixed, book).where("codes is null").count() == 5
    assert training.mapped(mixed, lambda x: x).where("decoded is null").count() == 5
    assert search.adc_topk(df.where("id = 1").select(F.col("id").alias("query_id"), F.col("vec").alias("query")), search.pq_encode(mixed, book), book, 10_000).count() == df.count()
    for train in (lambda d: training.kmeans(d, 3), lambda d: training.pq_train(d, 2), lambda d: training.pca(d), lambda d: training.autoencoder_train(d, 4)):
        with pytest.raises(ValueError, match="vector"):
            train(odd.where("vec is null"))


def test_as_many_centroids_as_asked_for(spark, monkeypatch):
    monkeypatch.setattr(training, "START_ROWS", 16)
    df = spark.range(400).select("id", F.array(*[F.rand(i).cast("float") for i in range(4)]).alias("vec"))
    assert len(training.kmeans(df, 100, 1)) == 100


def test_nf4_halves_go_either_way(spark):
    half = codecs.nf4_thresholds()[9]
    r = spark.createDataFrame([([1.0, half],)], "v array<float>").select(codecs.nf4(F.col("v"))["codes"].alias("down"), codecs.nf4(F.col("v"), halves_up=True)["codes"].alias("up")).first()
    assert (r["down"][1], r["up"][1]) == (9, 10)


def test_trained_codes_keep_their_promises(gauss):
    """Bounds that trained forms must reach: residual passes, an own nearest neighbour under full probing, clusters that hold every row."""
    x, df = gauss
    lists = training.ivf_train(df, 8, 5)
    q = df.where("id between 10 and 19").select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    own = search.ivf_search(q, search.assign(df, lists), lists, 1, 8).collect()
    assert all(r["query_id"] == r["id"] for r in own) and len(own) == 10
    assert training.clusters(df, training.kmeans(df, 6, 4)).count() == len(x)


ODD = [(0, [1.0, 2.0]), (1, None), (2, [3.0, 4.0, 5.0, 6.0]), (3, []), (4, [None, -2.0, 0.5]), (5, [0.0, 0.0]), (6, [7.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [None]), (10, [1.0, 2.0])]


@pytest.mark.parametrize("name", ["int8", "nf4", "sq2", "sq3"])
def test_arrow_codecs_on_odd_rows(spark, name):
    """Null, empty, mixed and non-finite vectors in one batch give the rows of the expressions."""
    from lodestar.operators import arrow

    df = spark.createDataFrame(ODD, "id int, vec array<float>").coalesce(1)
    slow, fast = (m.decode(m.encode(df, name), name).select("id", "code", "decoded").orderBy("id").collect() for m in (codecs, arrow))
    assert [str(r) for r in slow] == [str(r) for r in fast]
    assert slow[1]["code"]["codes"] is None and slow[1]["decoded"] is None and slow[4]["code"]["codes"][0] is None and slow[4]["decoded"][0] is None
    assert arrow.decode(spark.createDataFrame([(1, None)], "id int, code struct<codes:array<tinyint>,scale:float>"), name).first()["decoded"] is None


def test_minmax_on_odd_rows(spark):
    df = spark.createDataFrame(ODD, "id int, vec array<float>").repartition(3)
    table = codecs.minmax_table(df).first()
    assert table["lows"] == [0.0, 0.0, 5.0, 6.0] and table["highs"] == [7.0, 4.0, 5.0, 6.0]
    codes = {r["id"]: r["codes"] for r in codecs.minmax(df).collect()}
    assert codes[1] is None and codes[3] == [] and codes[0] == [36, 128] and len(codes[2]) == 4
    none = codecs.minmax_table(df.where("id = 1")).first()
    assert none["lows"] == [] and none["highs"] == []


def test_l2_at_large_norms(spark):
    """Distances that products would lose to cancellation."""
    rng = np.random.default_rng(5)
    x = 3e7 / np.sqrt(8) + rng.uniform(0.1, 1, size=(200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = search.knn(df.where("id < 5").select(F.col("id").alias("query_id"), F.col("vec").alias("query")), df, 5, "l2").collect()
    exact = np.sqrt(((x[:5, None] - x[None]) ** 2).sum(2))
    for q in range(5):
        mine = sorted((r["rank"], r["id"], r["score"]) for r in got if r["query_id"] == q)
        assert [i for _, i, _ in mine] == np.argsort(exact[q], kind="stable")[:5].tolist()
        assert np.allclose([-s for _, _, s in mine], np.sort(exact[q])[:5], rtol=1e-9)


def test_dimension_is_not_that_of_the_first_row(spark):
    from lodestar.operators.facade import Compressor

    rng = np.random.default_rng(2)
    rows = [(0, None), (1, [1.0])] + [(i, rng.normal(size=8).astype(float).tolist()) for i in range(2, 60)]
    df = spark.createDataFrame(rows, "id long, vec array<float>").coalesce(1)
    assert Compressor("nf4-mixed").fit(df).dims == 8
    assert select.auto_select(df, 0.5, 1.5).first()["mode"]


def test_products_with_many_centroids_are_sliced(spark, gauss, monkeypatch):
    from lodestar.operators import scan, training

    x, df = gauss
    cents = training.ivf_train(df, 7, 3)
    whole = search.assign(df, cents).select("id", "list_id").collect()
    near = training.clusters(df, x[:9].astype(float)).collect()
    monkeypatch.setattr(scan, "PRODUCTS", 20)
    assert list(map(len, (x[s] for s in scan.row_slices(x, 7))))[0] == 2
    assert sorted(search.assign(df, cents).select("id", "list_id").collect()) == sorted(whole)
    assert sorted(training.clusters(df, x[:9].astype(float)).collect()) == sorted(near)


def test_tokens_at_unicode_white_space(spark):
    """All of Unicode's white space separates words, in the twin too."""
    import duckdb

    from lodestar.functions.text import tokens
    from lodestar.plans.catalog import _TOK

    text = "a b　c d e\u0085F.  (g) h i j\x0bk\x0cl​m"
    want = ["a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "l​m"]
    assert spark.createDataFrame([(text,)], "text string").select(tokens(F.col("text")).alias("t")).first()["t"] == want
    assert duckdb.sql(f"SELECT {_TOK} AS t FROM (SELECT $t AS text)", params={"t": text}).fetchall() == [(want,)]


def test_many_centroids(spark, monkeypatch):
    """k-means|| starts near what a sample gives, and a tree of centroids is close to exact assignment."""
    from lodestar.operators import scan, training

    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 8)) * 10
    x = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [1.0])], "id long, vec array<float>").repartition(4).cache()
    cost = lambda c: ((x - c[training.nearest(x.astype(float), c)]) ** 2).sum() / len(x)
    plain = training.kmeans(df, 40, 8)
    monkeypatch.setattr(training, "SAMPLED_STARTS", 10)
    over = training.kmeans(df, 40, 8)
    assert over.shape == (40, 8) and cost(over) < 1.5 * cost(plain) + 1
    monkeypatch.setattr(scan, "PRODUCTS", 5000)  # several blocks
    tree = training.tree_train(df, 300, 5)
    assert 250 <= len(tree.fine) <= 350 and tree.starts[-1] == len(tree.fine)
    near = {r["id"]: r["list_id"] for r in tree.assign(df).select("id", "list_id").collect()}
    assert len(near) == 4000
    exact = training.nearest(x.astype(float), tree.fine)
    assert np.mean([near[i] == exact[i] for i in range(4000)]) > 0.95
    assert cost(tree.fine) < 0.8 * cost(plain)
    index = tree.assign(df)
    q = df.where("id < 20").select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    found = search.ivf_search(q, index, tree.centroids(df), 5, 20)
    truth = search.knn(q, df, 5)
    assert truth.join(found, ["query_id", "id"]).count() >= 0.5 * truth.count()
    tiny = training.tree_train(df.where("id < 3"), 50, 2)
    assert len(tiny.fine) <= 3 and tiny.assign(df).count() == 4000


def test_token_embedding_counts_repeats(spark):
    """A token that stands hundreds of times counts each time; null and empty texts are zeros."""
    df = spark.createDataFrame([(1, "fox " * 300 + "dog"), (2, None), (3, "fox"), (4, "dog")], "id long, text string")
    v = {r["id"]: np.array(r["vec"]) for r in select.embed_tokens(df, 70).collect()}
    want = 300 * v[3] + v[4]
    assert np.allclose(v[1], want / np.linalg.norm(want), atol=1e-6) and not v[2].any() and len(v[1]) == 70


@pytest.mark.parametrize("held", [1, 16])
def test_scores_at_once_are_bounded(spark, held, monkeypatch):
    """Many queries meet a batch of rows a block of scores at a time, in tasks that hold them all and in a grid."""
    x = np.random.default_rng(9).standard_normal((4_000, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").coalesce(1)
    q = df.where("id < 1500").select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    monkeypatch.setattr(scan, "HELD_BLOCKS", held, raising=False)
    cosine = scan.scorer("cosine")

    def bounded(rows, queries):
        if len(rows) * len(queries) > 1_000_000:
            raise ValueError("too many scores at once")
        return cosine(rows, queries)

    found = search.top_k(scan.pairs(q, df, scan.best(1), "query_id long, id long, score double", bounded), 1)
    assert found.count() == 1500 and found.where("query_id <> id").count() == 0


def test_groups_of_all_scores_are_bounded(spark, monkeypatch):
    """Where all scores are kept, a group of a grid has no more rows than are scored at once."""
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(300)], "id long, vec array<double>")
    q = df.select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    for name, value in (("QUERY_ROWS", 50), ("HELD_BLOCKS", 1), ("SCORED_ROWS", 40)):
        monkeypatch.setattr(scan, name, value, raising=False)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        tasks = search.all_scores(q, df).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in tasks) == 300 * 300
    assert len(tasks) > 6  # 6 blocks of queries meet 8 parts of rows, not one


@pytest.mark.parametrize("name", sorted(arrow.ENCODERS))
def test_cosines_over_arrow(spark, name):
    """As the expressions give them, on odd rows too; adapter matrices use them."""
    df = spark.createDataFrame([*ODD, (20, [1.0, float("nan")]), (21, [0.5, -0.25, None]), (22, [3.0, -1.0, 0.125, 7.0])], "id int, vec array<float>")
    slow = codecs.decode(codecs.encode(df, name), name).select("id", V.cosine(F.col("vec"), F.col("decoded")).alias("cosine"))
    fast = arrow.roundtrip_cosine(df, name)
    rows = lambda found: [(r["id"], str(round(r["cosine"], 12))) for r in found.orderBy("id").collect()]
    assert rows(fast) == rows(slow)
    whole = select.lora(df.selectExpr("'m' AS module", "'A' AS matrix", "id AS row_id", "vec").where("id >= 22"), name)
    assert "MapInArrow" in whole._jdf.queryExecution().toString()
