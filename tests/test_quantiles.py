"""Exact quantiles against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import quantiles

AT = [0.0, 0.01, 0.05, 0.25, 0.5, 0.9, 0.95, 0.999, 1.0]
RNG = np.random.default_rng(3)
SHAPES = {
    "normal": RNG.normal(size=3000), "ties": RNG.integers(0, 4, 3000).astype(float), "one": np.full(500, 2.5), "tail": np.exp(RNG.normal(size=3000) * 30),
    "few": np.array([3.0, 1.0]), "single": np.array([7.0]), "hot": np.concatenate([np.zeros(2000), RNG.normal(size=999)]), "infinite": np.concatenate([RNG.normal(size=50), [np.inf, -np.inf] * 10]),
}


@pytest.mark.parametrize("sorted_rows", [20_000, 20])
def test_quantiles(spark, monkeypatch, sorted_rows):
    """Of every shape, in few or many rounds, linear and discrete."""
    monkeypatch.setattr(quantiles, "SORTED", sorted_rows)
    monkeypatch.setattr(quantiles, "CELLS", 16)
    df = spark.createDataFrame([(g, float(v)) for g, x in SHAPES.items() for v in x] + [("few", None), (None, 4.0), ("none", None)], "g string, x double").repartition(4)
    for linear, method in ((True, "linear"), (False, "inverted_cdf")):
        got = {(r["g"], r["fraction"]): r["value"] for r in quantiles.exact(df, F.col("x"), AT, ["g"], linear).collect()}
        assert {g for g, _ in got} == {*SHAPES, None}
        for g, x in [*SHAPES.items(), (None, np.array([4.0]))]:
            if g == "infinite" and linear:
                continue
            want = np.quantile(x, AT, method=method)
            assert np.allclose([got[g, p] for p in AT], want, rtol=1e-12, atol=0), (g, linear)


def test_quantiles_without_groups(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SORTED", 50)
    x = RNG.normal(size=2000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = [r["value"] for r in quantiles.exact(df, -F.col("x"), [0.1, 0.5]).orderBy("fraction").collect()]
    assert np.allclose(got, np.quantile(-x, [0.1, 0.5]), rtol=1e-12)
    assert quantiles.exact(df.limit(0), F.col("x"), [0.5]).collect() == []
    odd = spark.createDataFrame([(float("nan"),)] * 100 + [(1.0,), (2.0,)] * 40, "x double")
    got = [r["value"] for r in quantiles.exact(odd, F.col("x"), [0.2, 0.9], linear=False).orderBy("fraction").collect()]
    assert got[0] == 1.0 and np.isnan(got[1])
