"""Every query with a twin gives the rows that DuckDB gives on the same files."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestar.plans import catalog

TABLES = "documents embeddings benchmark labels events conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(tuple, frame.where(frame.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_twin(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(catalog.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLE_SQL.keys()))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_fetch_by_id_of_any_size(spark, tmp_path):
    ids = [-7, 0, 7, 8, 9_999_997, 10_000_004, 7 << 40]
    spark.createDataFrame([(i, [1.0], 3) for i in ids], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalog.QUERIES["fetch_by_id"](spark, str(tmp_path)).collect()
    assert sorted(r["id"] for r in got) == [i for i in ids if i % 7 == 0]


@pytest.fixture(scope="module")
def normal_dir(spark, tmp_path_factory):
    """So many vectors that products with 255 come to a half in one precision only."""
    at = tmp_path_factory.mktemp("normal")
    x = np.random.default_rng(3).standard_normal((12_000, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x)), "label": np.zeros(len(x), np.int32)}), at / "embeddings.parquet")
    return str(at)


def twin_rows(spark, at, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet'")
    got, want = catalog.QUERIES[name](spark, at).toPandas(), con.sql(catalog.ORACLE_SQL[name]).df()
    return rows(got, sorted(want.columns)), rows(want, sorted(want.columns))


def test_minmax_codes_of_many_vectors(spark, normal_dir):
    got, want = twin_rows(spark, normal_dir, "minmax_u8")
    assert got == want


def test_minmax_topk_of_many_vectors(spark, normal_dir):
    got, want = twin_rows(spark, normal_dir, "minmax_topk")
    assert got == want
