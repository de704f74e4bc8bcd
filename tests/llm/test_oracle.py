"""Queries with a DuckDB twin give its rows."""

import duckdb
import pytest

from lodestar.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns) and [want[c].dtype.kind for c in columns] == [got[c].dtype.kind for c in columns]
    rows = lambda f: sorted(map(tuple, f[columns].astype(object).values.tolist()))
    assert rows(got) == rows(want)
