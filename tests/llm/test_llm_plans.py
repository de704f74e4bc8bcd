"""Native operators run no Python; none has a cross join of its rows."""

from lodestar.llm import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_plans(spark, sf_dir):
    for name in ("op6_secret_scan", "op8_sharding", "op10_chat_formatting"):
        text = plan(queries.QUERIES[name](spark, sf_dir))
        assert not any(x in text for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))


def test_quality_shuffles_no_text(spark, sf_dir):
    assert "Exchange hashpartitioning" not in plan(queries.QUERIES["op2_quality_rules"](spark, sf_dir))


def test_packing_shuffles_no_ids(spark, sf_dir):
    assert "Exchange hashpartitioning" not in plan(queries.QUERIES["op1_best_fit_packing"](spark, sf_dir))
