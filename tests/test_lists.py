"""Inverted files with summaries: exact search by bounds, and filters that rule lists out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import lists, search, training
from lodestar.operators.ann import AnnIndex


@pytest.fixture(scope="module")
def built(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(16, 12)) * 4
    group = rng.integers(0, 16, 1600)
    x = (centres[group] + rng.normal(size=(1600, 12))).astype(np.float32)
    rows = [(i, v.tolist(), int(g), f"t{g // 4}" if g % 5 else None) for i, (v, g) in enumerate(zip(x, group))]
    rows += [(2000, [0.0] * 12, 99, None), (2001, [0.0] * 12, 99, "t0"), (2002, x[0].tolist(), 99, "t1")]
    df = spark.createDataFrame(rows, "id long, vec array<float>, label int, tag string").cache()
    cents = training.ivf_train(df, 16, 8).cache()
    return df, search.assign(df, cents).cache(), cents


def asking(spark, df):
    few = df.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").cast("array<double>").alias("query"))
    odd = [(9000, [0.0] * 12), (9001, None), (9002, [1.0]), (9003, [float("nan")] * 12), (9004, [-1.0] * 12)]
    return few.unionByName(spark.createDataFrame(odd, "query_id long, query array<double>"))


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


def test_bounds_hold_for_every_row(spark, built):
    df, index, cents = built
    q = asking(spark, df).where("query_id < 9000")
    each = search.all_scores(q, index).join(index.select("id", "list_id"), "id")
    over = each.join(lists.bounds(q, cents, lists.rings(index, cents)), ["query_id", "list_id"])
    assert over.count() == each.count() and over.where("score > bound").count() == 0


def test_exact_search_reads_fewer_rows(spark, built):
    df, index, cents = built
    q = asking(spark, df)
    for k in (1, 10, 150):
        found, visited = lists.top(q, index, cents, k)
        assert rows(found) == rows(search.knn(q, df, k))
        if k == 10:
            read = visited.join(index, "list_id").groupBy("query_id").count().agg(F.avg("count")).first()[0]
            assert read < 0.5 * index.count()
    even = F.col("id") % 2 == 0
    assert rows(lists.exact(q, index, cents, 10, even)) == rows(search.knn(q, df, 10, where=even))
    assert rows(lists.exact(q, index, cents, 10, F.lit(False))) == []
    assert rows(AnnIndex(index, cents).delete(df.where("id < 100").select("id")).search_exact(q, 5)) == rows(search.knn(q, df.where("id >= 100"), 5))


def test_filters_rule_lists_out(spark, built, tmp_path):
    df, index, cents = built
    summary = lists.summaries(index, ["label", "tag", "id"]).cache()
    q = asking(spark, df)
    path = str(tmp_path / "index")
    index.repartition("list_id").write.partitionBy("list_id").parquet(path)
    stored = spark.read.parquet(path)
    conditions = [[("label", "==", 3)], [("tag", "==", "t2"), ("label", "!=", 9)], [("tag", "==", None)], [("tag", "!=", None)], [("tag", "!=", "t1")], [("label", "==", 12345)], [("id", "==", 2002)], [("label", "==", 99), ("tag", "!=", "t0")], [("label", "==", 3.5)]]
    for c in conditions:
        want = search.ivf_search(q, stored, cents, 5, 4, where=search.metadata_filter(c))
        got = lists.filtered_search(q, stored, cents, 5, 4, c, summary)
        assert rows(got) == rows(want), c
        true = {r["list_id"] for r in index.where(search.metadata_filter(c)).select("list_id").distinct().collect()}
        assert true <= {r["list_id"] for r in lists.possible(summary, c).collect()}
    few = {r["list_id"] for r in lists.possible(summary, [("label", "==", 3)]).collect()}
    assert 0 < len(few) <= 4
    text = lists.filtered_search(q, stored, cents, 5, 4, [("label", "==", 3)], summary)._jdf.queryExecution().executedPlan().toString()
    asked = set(int(x) for x in text.split("PartitionFilters: [")[1].split("]")[0].replace(")", " ").replace(",", " ").replace("=", " ").split() if x.isdigit())
    assert asked <= few  # only those partitions are read
    with pytest.raises(ValueError):
        lists.possible(summary, [("label", "<", 3)])
