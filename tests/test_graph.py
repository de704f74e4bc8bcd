"""Proximity graph against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import graph, search
from lodestar.operators.graph import GraphIndex


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 24)) * 2
    x = centres[rng.integers(0, 8, 1200)] + rng.normal(size=(1200, 24))
    x[1100:1150] = x[0]  # copies
    rows = [(i, v.astype(float).tolist(), i % 3) for i, v in enumerate(x.astype(np.float32))]
    return spark.createDataFrame(rows + [(5000, None, 0), (5001, [1.0], 0), (5002, [float("nan")] * 24, 0)], "id long, vec array<float>, label int").repartition(3).cache()


@pytest.fixture(scope="module")
def index(clustered):
    old = graph.BLOCK_ROWS, graph.ENTRY_ROWS, graph.CENTRES
    graph.BLOCK_ROWS, graph.ENTRY_ROWS, graph.CENTRES = 128, 20, 50  # several blocks, layers and groups
    yield GraphIndex.build(clustered, m=12)
    graph.BLOCK_ROWS, graph.ENTRY_ROWS, graph.CENTRES = old


def asking(df, every=20):
    return df.where(f"id % {every} = 0 and id < 5000").select(F.col("id").alias("query_id"), F.col("vec").alias("query"))


def recall(found, truth):
    """Share of exact results found; a row as near as the last one counts, as copies tie."""
    last, hits = {}, {}
    for r in truth.collect():
        last[r["query_id"]] = min(last.get(r["query_id"], np.inf), r["score"])
    for r in found.collect():
        hits[r["query_id"]] = hits.get(r["query_id"], 0) + (r["score"] >= last[r["query_id"]] - 1e-9)
    return sum(hits.values()) / truth.count()


def test_graph_layers(index):
    rows = {r["layer"]: r for r in index.stats().collect()}
    assert len(rows) >= 2 and rows[0]["nodes"] == 1200 and all(r["orphans"] == 0 for r in rows.values())
    assert rows[0]["max_degree"] <= 24 + 10 and rows[1]["nodes"] < 200
    assert index.edges.where("src = dst").count() == 0 and index.edges.groupBy("layer", "src", "dst").count().where("count > 1").count() == 0


def test_graph_search(spark, clustered, index, tmp_path):
    q = asking(clustered)
    truth = search.knn(q, clustered, 10)
    found = index.search(q, 10).cache()
    assert recall(found, truth) >= 0.95
    exact = {(r["query_id"], r["id"]): r["score"] for r in search.knn(q, clustered, 2000).collect()}
    assert all(abs(r["score"] - exact[r["query_id"], r["id"]]) < 1e-6 for r in found.collect())
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [0.0] * 24), (4, [float("nan")] * 24)], "query_id int, query array<float>")
    assert {r["query_id"] for r in index.search(odd, 3).collect()} == {3}
    index.save(str(tmp_path / "g"))
    assert sorted(GraphIndex.load(spark, str(tmp_path / "g")).search(q, 10).collect()) == sorted(found.collect())


def test_graph_filter_is_whole(clustered, index):
    q = asking(clustered, 60)
    for where in (F.col("label") == 1, F.col("id") < 15):
        truth = search.knn(q, clustered, 10, where=where)
        found = index.search(q, 10, where=where)
        assert found.count() == truth.count() and recall(found, truth) >= 0.95
    assert index.search(q, 10, where=F.lit(False)).count() == 0


def test_graph_changes(spark, clustered, index):
    """Deleted rows lead on but aren't found; compaction repairs; new and replaced rows are found."""
    gone = clustered.where("id % 4 = 0 and id < 5000").select("id")
    fewer = index.delete(gone)
    q, left = asking(clustered), clustered.join(gone, "id", "left_anti")
    truth = search.knn(q, left, 10)
    found = fewer.search(q, 10)
    assert found.join(gone, "id", "left_semi").count() == 0 and recall(found, truth) >= 0.95
    assert fewer.totals().first()["alive"] == 900
    packed = fewer.compact()
    assert packed.totals().first()["total"] == 900 and recall(packed.search(q, 10), truth) >= 0.95
    assert packed.edges.join(gone, F.col("dst") == F.col("id"), "left_semi").count() == 0 and all(r["orphans"] == 0 for r in packed.stats().collect())
    rng = np.random.default_rng(9)
    new = spark.createDataFrame([(i, (rng.normal(size=24) * 3).tolist(), 0) for i in [*range(9000, 9060), 1, 4]], "id long, vec array<float>, label int")
    more = fewer.add(new)
    now = new.unionByName(left.join(new, "id", "left_anti"))
    asked = new.select(F.col("id").alias("query_id"), F.col("vec").alias("query")).unionByName(q)
    assert recall(more.search(asked, 10), search.knn(asked, now, 10)) >= 0.95
    first = more.search(asked, 1).where("query_id >= 9000 or query_id in (1, 4)")
    assert first.where("query_id <> id").count() == 0


@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_graph_metrics(clustered, metric):
    index = GraphIndex.build(clustered.where("id < 700"), m=12, metric=metric)
    q = asking(clustered, 30)
    assert recall(index.search(q, 5), search.knn(q, clustered.where("id < 700"), 5, metric)) >= 0.9


def test_graph_of_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vec array<float>")
    q = df.select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    index = GraphIndex.build(df)
    assert [r["id"] for r in index.search(q, 5).orderBy("query_id", "rank").collect()] == [1, 2, 2, 1]
    assert GraphIndex.build(df.where("id = 1")).search(q, 5).count() == 2
    with pytest.raises(ValueError):
        GraphIndex.build(df.limit(0))
    with pytest.raises(ValueError):
        GraphIndex.build(df, metric="hamming").search(q, 1)


def test_blocks_find_most_neighbours(spark, monkeypatch):
    """Before any descent, the edges of many blocks hold most of the true neighbours; blocks cut by three sets of planes held fewer."""
    for name, value in (("BLOCK_ROWS", 128), ("ENTRY_ROWS", 20)):
        monkeypatch.setattr(graph, name, value)
    x = np.random.default_rng(6).normal(size=(3000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(float))], "id long, vec array<float>").repartition(3).cache()
    edges = GraphIndex.build(df, m=10, rounds=0).edges.where("layer = 0")
    truth = search.knn(asking(df), df, 11).where("query_id <> id").select(F.col("query_id").alias("src"), F.col("id").alias("dst"))
    assert edges.join(truth, ["src", "dst"], "left_semi").count() >= 0.75 * truth.count()


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_parts_score_like_pairs(spark, clustered, metric):
    """Pairs that meet parts of rows get the scores of pairs that carry both vectors, for ids of any kind."""
    rows = clustered.where("id < 300").select(F.concat(F.lit("r"), "id").alias("id"), "vec", (F.col("id") % 2 == 0).alias("_ok"))
    asked = asking(clustered.where("id < 300"), 30).select(F.concat(F.lit("q"), "query_id").alias("query_id"), "query")
    pairs = rows.where("_ok").select("id").crossJoin(asked.select("query_id")).select("query_id", "id")
    got = graph.score_parts(pairs, graph.packed(rows), 30_000, *graph.held_queries(asked), metric)
    want = graph.score_pairs(pairs.join(rows, "id").join(asked, "query_id").withColumnsRenamed({"query": "a", "vec": "b"}), metric, ["query_id", "id", "_ok"])
    got, want = ({(r["query_id"], r["id"], r["_ok"]): r["score"] for r in df.collect()} for df in (got, want))
    assert len(got) == 1500 and got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-9


def test_lists_keep_the_best_edges(spark):
    """An edge counts once and is known if any list knows it; ties go to smaller ids."""
    rows = [("a", ["b", "c"], [0.5, 0.9], False), ("a", ["c", "e", "d"], [0.9, 0.5, 0.7], True), ("b", ["a"], [0.5], True), ("c", [], [], True)]
    lists = spark.createDataFrame(rows, "src string, dst array<string>, score array<double>, fresh boolean")
    out = {r["src"]: (r["dst"], r["score"], r["fresh"]) for r in graph.best_lists(lists, 3, 3).collect()}
    assert out == {"a": (["c", "d", "b"], [0.9, 0.7, 0.5], [False, True, False]), "b": (["a"], [0.5], [True])}
