"""What the plans must look like for the operators to hold at scale."""

from pyspark.sql import functions as F

from lodestar.operators import bm25, codecs, search, store
from lodestar.plans import catalog
from lodestar.session import vectors


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_is_limited_before_the_shuffle(spark, sf_dir):
    text = plan(search.knn(catalog.asked(spark, sf_dir), vectors(spark, sf_dir), 10))
    assert text.count("WindowGroupLimit") == 2


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(search.knn(catalog.asked(spark, sf_dir), vectors(spark, sf_dir), 5, where=search.metadata_filter([("label", "==", 3)])))
    assert "EqualNullSafe(label,3)" in text
    only = plan(vectors(spark, sf_dir).select(codecs.int8(F.col("vec"))))
    assert "ReadSchema: struct<embedding:array<float>>" in only


def test_encoding_has_no_shuffle(spark, sf_dir):
    for name in codecs.CODECS:
        assert "Exchange" not in plan(codecs.decode(codecs.encode(vectors(spark, sf_dir), name), name))


def test_texts_are_not_shuffled_for_bm25(spark, sf_dir):
    """What is scored is the staged table of counted words; the only exchange carries at most k rows per query and task."""
    text = plan(bm25.search(bm25.build(catalog.corpus(spark, sf_dir)), catalog.text_queries(spark, sf_dir), 10))
    assert "documents.parquet" not in text and text.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in text


def test_deletes_are_anti_joins(spark):
    a, b = spark.range(10), spark.range(3)
    assert "LeftAnti" in plan(store.delete(a, b)) and "LeftAnti" in plan(store.write(a, b, "overwrite"))
