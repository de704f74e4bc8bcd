"""Queries by name and their DuckDB twins.

Query vectors are all rows with ids divisible by 50, and text queries all rows of
``benchmark``; documents and vectors that share an id go together in hybrid queries, as do
item i and vector 50 * i.  Numbers are rounded to six places, codes are
joined to strings; BM25 sums are rounded before they rank, as copies tie only up to the
order of summation.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import vec as V
from lodestar.functions.text import SPACE, content_tokens, robertson_idf, tokens
from lodestar.operators import arrow, bm25, coded, codecs, graph, lists, postings, quality, quantiles, ranking, retriever, search, select, store, training
from lodestar.session import table, vectors
from lodestar.staging import root
from lodestar.streaming.corpus import MaintainedCorpus
from lodestar.streaming.encode import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables of one query."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def joined(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda x: x.cast("string")), ",")


def listed(codes: Column, *more: Column):
    return lambda df: df.select(F.col("id").alias("vec_id"), joined(codes).alias("codes"), *more)


# SQL pieces -----------------------------------------------------------------------------

_D = "list_transform({0}, lambda x: CAST(x AS DOUBLE))"
_COS = "list_cosine_similarity(" + _D.format("{0}") + ", " + _D.format("{1}") + ")"
_Q = "q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 50 = 0)"


def cos(a: str, b: str) -> str:
    return _COS.replace("{0}", a).replace("{1}", b)


def dbl(a: str) -> str:
    return _D.format(a)


def topk_sql(scored: str, k: int, order: str = "score DESC", keep: str = "query_id, id, round(score, 6) AS score, rank") -> str:
    return f"ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}, id) AS INTEGER) AS rank FROM ({scored})) SELECT {keep} FROM ranked WHERE rank <= {k}"


_MAX = "m AS (SELECT vec_id, embedding AS v, list_max(list_transform(embedding, lambda x: abs(x))) AS m FROM embeddings)"


def ratio_sql(x: str, s: str) -> str:
    return f"CAST(CAST({x} AS DOUBLE) / CAST({s} AS DOUBLE) AS FLOAT)"


def int8_sql(factor: float = 1.0, source: str = "m", name: str = "e") -> str:
    return f"""{name} AS (SELECT *, list_transform(v, lambda x: CAST(greatest(-127, least(127, round_even(CAST({ratio_sql("x", "s")} AS DOUBLE), 0))) AS INTEGER)) AS codes
        FROM (SELECT *, CAST(CASE WHEN m = 0 THEN 1.0 ELSE CAST(m AS DOUBLE) / {127.0 * factor} END AS FLOAT) AS s FROM {source}))"""


_INT8 = f"{_MAX}, {int8_sql()}"
_DEC = "d AS (SELECT vec_id, v, list_transform(codes, lambda c: CAST(CAST(c AS FLOAT) * s AS FLOAT)) AS y FROM e)"
_CODES = "array_to_string(codes, ',') AS codes"

# Search -----------------------------------------------------------------------------------


@query(f"WITH {_Q}, " + topk_sql(f"SELECT query_id, vec_id AS id, {cos('query', 'embedding')} AS score FROM q, embeddings", 10))
def knn_cosine_topk(spark, sf_dir):
    return search.knn(asked(spark, sf_dir), vectors(spark, sf_dir), 10).select("query_id", "id", r6("score").alias("score"), "rank")


@query(f"WITH {_Q}, " + topk_sql(f"SELECT query_id, vec_id AS id, -list_distance({dbl('query')}, {dbl('embedding')}) AS score FROM q, embeddings WHERE vec_id <> query_id", 10))
def knn_l2_topk(spark, sf_dir):
    return search.knn(asked(spark, sf_dir), vectors(spark, sf_dir), 10, "l2", include_self=False).select("query_id", "id", r6("score").alias("score"), "rank")


@query(f"WITH {_Q}, " + topk_sql(f"SELECT query_id, vec_id AS id, -list_sum(list_transform(range(1, 65), lambda i: abs(CAST(query[i] AS DOUBLE) - embedding[i]))) AS score FROM q, embeddings", 5))
def knn_l1_topk(spark, sf_dir):
    return search.knn(asked(spark, sf_dir), vectors(spark, sf_dir), 5, "l1").select("query_id", "id", r6("score").alias("score"), "rank")


@query(f"WITH {_Q}, " + topk_sql(f"SELECT query_id, vec_id AS id, {cos('query', 'embedding')} AS score FROM q, embeddings", 10))
def knn_join_10q(spark, sf_dir):
    return search.knn_expression(asked(spark, sf_dir), vectors(spark, sf_dir), 10).select("query_id", "id", r6("score").alias("score"), "rank")


_SCORED_INT8 = f"SELECT query_id, vec_id AS id, {cos('query', 'y')} AS score FROM q, d"


@query(f"WITH {_Q}, {_INT8}, {_DEC}, " + topk_sql(_SCORED_INT8, 10))
def int8_topk(spark, sf_dir):
    db = arrow.decode(arrow.encode(vectors(spark, sf_dir), "int8"), "int8", out="vec")
    return search.knn(asked(spark, sf_dir), db, 10).select("query_id", "id", r6("score").alias("score"), "rank")


@query(f"WITH {_Q}, {_INT8}, " + topk_sql(f"SELECT query_id, vec_id AS id, {cos('query', 'codes')} AS score FROM q, e", 3))
def int8_code_cosine(spark, sf_dir):
    db = vectors(spark, sf_dir).select("id", codecs.int8(F.col("vec"))["codes"].alias("vec"))
    return search.knn(asked(spark, sf_dir), db, 3).select("query_id", "id", r6("score").alias("score"), "rank")


_BITS = "list_transform({0}, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"
_HAMMING = f"SELECT query_id, vec_id AS id, CAST(list_sum(list_transform(range(1, 65), lambda i: abs({_BITS.format('query')}[i] - {_BITS.format('embedding')}[i]))) AS INTEGER) AS distance, query, embedding FROM q, embeddings"


@query(f"WITH {_Q}, " + topk_sql(_HAMMING, 10, "distance", "query_id, id, distance, rank"))
def hamming_topk(spark, sf_dir):
    return search.hamming_topk(asked(spark, sf_dir), vectors(spark, sf_dir), 10).select("query_id", "id", "distance", "rank")


@query(f"WITH {_Q}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM ({_HAMMING})), " + topk_sql(f"SELECT query_id, id, {cos('query', 'embedding')} AS score FROM h WHERE r <= 50", 10))
def binary_then_cosine_rerank(spark, sf_dir):
    return search.two_stage(asked(spark, sf_dir), vectors(spark, sf_dir), 10, 50).select("query_id", "id", r6("score").alias("score"), "rank")


@query(f"WITH {_Q}, " + topk_sql(f"SELECT query_id, vec_id AS id, {cos('query', 'embedding')} AS score FROM q, embeddings JOIN documents ON doc_id = vec_id WHERE lang = 'en'", 5))
def filtered_knn(spark, sf_dir):
    db = vectors(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    return search.knn(asked(spark, sf_dir), db, 5, where=search.metadata_filter([("lang", "==", "en")])).select("query_id", "id", r6("score").alias("score"), "rank")


@query(f"WITH {_Q}, " + topk_sql(f"SELECT query_id, vec_id AS id, {cos('query', 'embedding')} AS score FROM q, embeddings WHERE label IS DISTINCT FROM 3 AND label IS DISTINCT FROM 4", 5))
def filter_ne(spark, sf_dir):
    return search.knn(asked(spark, sf_dir), vectors(spark, sf_dir), 5, where=search.metadata_filter([("label", "!=", 3), ("label", "!=", 4)])).select("query_id", "id", r6("score").alias("score"), "rank")


@query(f"WITH {_Q}, t AS (" + f"SELECT * FROM (SELECT query_id, vec_id AS id, label, row_number() OVER (PARTITION BY query_id ORDER BY {cos('query', 'embedding')} DESC, vec_id) AS rank FROM q, embeddings WHERE vec_id <> query_id) WHERE rank <= 10) SELECT query_id, round(avg(CASE WHEN t.label = e.label THEN 1.0 ELSE 0.0 END), 6) AS label_recall FROM t JOIN embeddings e ON e.vec_id = query_id GROUP BY query_id")
def label_recall(spark, sf_dir):
    db = vectors(spark, sf_dir)
    found = search.knn(asked(spark, sf_dir), db, 10, include_self=False).join(db.select("id", "label"), "id")
    own = db.select(F.col("id").alias("query_id"), F.col("label").alias("own"))
    return found.join(own, "query_id").groupBy("query_id").agg(r6(F.avg(F.when(F.col("label") == F.col("own"), 1.0).otherwise(0.0))).alias("label_recall"))


_PAIRS = "SELECT a.vec_id, a.embedding AS v, b.embedding AS w FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


@query(f"SELECT vec_id, round({cos('v', 'w')}, 6) AS cosine, round(list_dot_product({dbl('v')}, {dbl('w')}), 6) AS dot, round(list_distance({dbl('v')}, {dbl('w')}), 6) AS l2, round(list_sum(list_transform(range(1, 65), lambda i: abs(CAST(v[i] AS DOUBLE) - w[i]))), 6) AS l1 FROM ({_PAIRS})")
def vector_functions(spark, sf_dir):
    db = vectors(spark, sf_dir)
    other = db.select((F.col("id") - 1).alias("id"), F.col("vec").alias("w"))
    v, w = F.col("vec"), F.col("w")
    return db.join(other, "id").select(F.col("id").alias("vec_id"), r6(V.cosine(v, w)).alias("cosine"), r6(V.dot(v, w)).alias("dot"), r6(V.l2(v, w)).alias("l2"), r6(V.l1(v, w)).alias("l1"))


@query(f"SELECT vec_id, round(sqrt(list_sum(list_transform(n, lambda x: x * x))), 4) AS norm, round(CAST(n[1] AS DOUBLE), 5) AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) / sqrt(list_dot_product({dbl('embedding')}, {dbl('embedding')})) AS FLOAT)) AS n FROM embeddings)")
def normalized_vectors(spark, sf_dir):
    n = vectors(spark, sf_dir).select("id", V.normalized(F.col("vec")).alias("n"))
    return n.select(F.col("id").alias("vec_id"), F.round(V.norm(F.col("n")), 4).alias("norm"), F.round(F.col("n")[0].cast("double"), 5).alias("first"))


# Codecs ------------------------------------------------------------------------------------


@query(f"WITH {_INT8} SELECT vec_id, {_CODES}, round(CAST(s AS DOUBLE), 6) AS scale FROM e")
def int8_encode(spark, sf_dir):
    return codecs.encode(vectors(spark, sf_dir), "int8").transform(listed(F.col("code.codes"), r6("code.scale").alias("scale")))


@query(f"WITH {_INT8}, {_DEC} SELECT vec_id, round({cos('v', 'y')}, 6) AS cosine FROM d")
def int8_roundtrip(spark, sf_dir):
    return decoded(spark, sf_dir, "int8").select(F.col("id").alias("vec_id"), r6(V.cosine(F.col("vec"), F.col("decoded"))).alias("cosine"))


@query(f"WITH m AS (SELECT vec_id, g, embedding[g * 16 + 1:g * 16 + 16] AS v, list_max(list_transform(embedding[g * 16 + 1:g * 16 + 16], lambda x: abs(x))) AS m FROM embeddings, range(4) t(g)), {int8_sql()} SELECT vec_id, string_agg(array_to_string(codes, ','), ',' ORDER BY g) AS codes, round(sum(CAST(s AS DOUBLE)), 6) AS scales FROM e GROUP BY vec_id")
def int8_grouped(spark, sf_dir):
    return codecs.encode(vectors(spark, sf_dir), "int8_grouped").transform(listed(F.col("code.codes"), r6(V.total(F.col("code.scales"))).alias("scales")))


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(greatest(-127, least(127, round(CAST(x AS DOUBLE) * 127, 0))) AS INTEGER)), ',') AS codes FROM embeddings")
def int8_normalized(spark, sf_dir):
    return codecs.encode(vectors(spark, sf_dir), "int8_normalized").transform(listed(F.col("code.codes")))


_BOUND = "CASE WHEN mad = 0 THEN m ELSE 3.0 * mad END"


@query(f"""WITH a AS (SELECT vec_id, embedding AS v, list_median({dbl('embedding')}) AS med FROM embeddings),
b AS (SELECT *, list_median(list_transform(v, lambda x: abs(CAST(x AS DOUBLE) - med))) AS mad, list_max(list_transform(v, lambda x: abs(CAST(x AS DOUBLE)))) AS m FROM a),
c AS (SELECT vec_id, list_transform(v, lambda x: CAST(greatest(-({_BOUND}), least({_BOUND}, CAST(x AS DOUBLE))) AS FLOAT)) AS v FROM b),
m AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) AS m FROM c), {int8_sql()} SELECT vec_id, {_CODES}, round(CAST(s AS DOUBLE), 6) AS scale FROM e""")
def int8_adaptive_mad(spark, sf_dir):
    return codecs.encode(vectors(spark, sf_dir), "int8_adaptive").transform(listed(F.col("code.codes"), r6("code.scale").alias("scale")))


@query(f"WITH {_MAX} SELECT vec_id, array_to_string(list_transform(v, lambda x: CAST(greatest(-127, least(127, round(CAST({ratio_sql('x', 'm')} AS FLOAT) * CAST(127 AS FLOAT), 0))) AS INTEGER)), ',') AS codes, round(CAST(m AS DOUBLE), 6) AS scale FROM m")
def int8_max_scale(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", codecs.int8_max_scale(F.col("vec")).alias("code"))
    return v.transform(listed(F.col("code.codes"), r6("code.scale").alias("scale")))


@query(f"WITH {_MAX} SELECT vec_id, array_to_string(list_transform(v, lambda x: CAST(greatest(-7, least(7, round_even(CAST({ratio_sql('x', 'CAST(CAST(m AS DOUBLE) / 7 AS FLOAT)')} AS DOUBLE), 0))) AS INTEGER)), ',') AS codes FROM m")
def int4_encode(spark, sf_dir):
    return codecs.encode(vectors(spark, sf_dir), "int4").transform(listed(F.col("code.codes")))


@query(f"""WITH g AS (SELECT vec_id, g, embedding[g * 32 + 1:g * 32 + 32] AS v FROM embeddings, range(2) t(g)),
z AS (SELECT *, CAST(list_reduce({dbl('v')}, lambda a, b: a + b) / 32 AS FLOAT) AS zero FROM g),
w AS (SELECT vec_id, g, zero, list_transform(v, lambda x: CAST(CAST(x AS DOUBLE) - CAST(zero AS DOUBLE) AS FLOAT)) AS v FROM z),
m AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) AS m FROM w)
SELECT vec_id, string_agg(array_to_string(list_transform(v, lambda x: 1 + CAST(greatest(-1, least(1, round_even(CAST({ratio_sql('x', 'm')} AS DOUBLE), 0))) AS INTEGER)), ','), ',' ORDER BY g) AS codes FROM m GROUP BY vec_id""")
def int2_encode(spark, sf_dir):
    return codecs.encode(vectors(spark, sf_dir), "int2").transform(listed(F.col("code.codes")))


def _levels_sql() -> str:
    return "[" + ", ".join(f"CAST({x!r} AS FLOAT)" for x in codecs.nf4_thresholds()) + "]"


_NF4 = f"{_MAX}, e AS (SELECT vec_id, v, m, list_transform(v, lambda x: len(list_filter({_levels_sql()}, lambda t: t < {ratio_sql('x', 'm')}))) AS codes FROM m)"


@query(f"WITH {_NF4} SELECT vec_id, {_CODES}, round(CAST(m AS DOUBLE), 6) AS scale FROM e")
def nf4_encode(spark, sf_dir):
    return codecs.encode(vectors(spark, sf_dir), "nf4").transform(listed(F.col("code.codes"), r6("code.scale").alias("scale")))


_NF4_LEVELS = "[" + ", ".join(f"CAST({x} AS FLOAT)" for x in codecs.NF4_LEVELS) + "]"


@query(f"WITH {_NF4}, d AS (SELECT vec_id, v, list_transform(codes, lambda c: {_NF4_LEVELS}[c + 1] * m) AS y FROM e) SELECT vec_id, round({cos('v', 'y')}, 6) AS cosine FROM d")
def nf4_roundtrip(spark, sf_dir):
    return decoded(spark, sf_dir, "nf4").select(F.col("id").alias("vec_id"), r6(V.cosine(F.col("vec"), F.col("decoded"))).alias("cosine"))


@query("SELECT vec_id, array_to_string(list_transform(range(8), lambda b: list_sum(list_transform(range(8), lambda i: CASE WHEN embedding[b * 8 + i + 1] > 0 THEN CAST(pow(2, i) AS INTEGER) ELSE 0 END))::INTEGER), ',') AS codes FROM embeddings")
def binary_encode(spark, sf_dir):
    bits = F.transform("vec", lambda x: F.when(x > 0, 1).otherwise(0))
    return vectors(spark, sf_dir).select("id", codecs.packed(bits, 1).alias("codes")).transform(listed(F.col("codes")))


@query("SELECT vec_id, prefix, CAST(len(list_filter(embedding[1:prefix], lambda x: x > 0)) AS INTEGER) AS ones FROM embeddings, (VALUES (8), (16), (32), (64)) t(prefix)")
def matryoshka_binary(spark, sf_dir):
    m = vectors(spark, sf_dir).select("id", F.explode(codecs.matryoshka(F.col("vec"), [8, 16, 32, 64])).alias("m"))
    ones = F.aggregate(F.transform("m.words", lambda w: F.bit_count(w)), F.lit(0), lambda a, x: a + x)
    return m.select(F.col("id").alias("vec_id"), "m.prefix", ones.alias("ones"))


def _sq_sql(bits: int) -> str:
    half = 1 << (bits - 1)
    return f"WITH {_MAX} SELECT vec_id, array_to_string(list_transform(v, lambda x: CAST(greatest(0, least({2 * half - 1}, floor((CAST(greatest(-1.0, least(1.0, CAST(CAST(x AS DOUBLE) * CAST(CAST(1.0 / CAST(m AS DOUBLE) AS FLOAT) AS DOUBLE) AS FLOAT))) AS DOUBLE) + 1) * {half}))) AS INTEGER)), ',') AS codes FROM m"


@query(_sq_sql(2))
def sq2_encode(spark, sf_dir):
    return codecs.encode(vectors(spark, sf_dir), "sq2").transform(listed(F.col("code.codes")))


@query(_sq_sql(3))
def sq3_encode(spark, sf_dir):
    return codecs.encode(vectors(spark, sf_dir), "sq3").transform(listed(F.col("code.codes")))


_LONG = "long AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS dim FROM embeddings)"


@query(f"WITH {_LONG}, t AS (SELECT dim, min(x) AS low, max(x) AS high FROM long GROUP BY dim) SELECT vec_id, string_agg(CAST(CAST(round(greatest(0.0, least(1.0, CAST((CAST(x AS DOUBLE) - low) / (CAST(high AS DOUBLE) - low) AS FLOAT))) * 255, 0) AS INTEGER) AS VARCHAR), ',' ORDER BY dim) AS codes FROM long JOIN t USING (dim) GROUP BY vec_id")
def minmax_u8(spark, sf_dir):
    return codecs.minmax(vectors(spark, sf_dir)).transform(listed(F.col("codes")))


@query(f"WITH {_LONG} SELECT CAST(dim AS INTEGER) AS dim, round(CAST(min(x) AS DOUBLE), 6) AS low, round(CAST(max(x) AS DOUBLE), 6) AS high FROM long GROUP BY dim")
def dim_minmax(spark, sf_dir):
    t = codecs.minmax_table(vectors(spark, sf_dir)).select(F.posexplode(F.arrays_zip("lows", "highs")).alias("dim", "r"))
    return t.select("dim", r6("r.lows").alias("low"), r6("r.highs").alias("high"))


def decoded(spark: SparkSession, sf_dir: str, codec: str) -> DataFrame:
    return codecs.decode(codecs.encode(vectors(spark, sf_dir), codec), codec)


# Fidelity --------------------------------------------------------------------------------------

_ERR = f"{_INT8}, {_DEC}, x AS (SELECT vec_id, v, y, list_transform(range(1, 65), lambda i: CAST(v[i] AS DOUBLE) - CAST(y[i] AS DOUBLE)) AS er, {cos('v', 'y')} AS c FROM d), el AS (SELECT unnest(er) AS e, unnest(v) AS s FROM x)"


@query(f"""WITH {_ERR}, a AS (SELECT avg(abs(e)) AS mae, avg(e * e) AS mse, avg(CAST(s AS DOUBLE) * s) AS power, max(s) AS peak, quantile_cont(abs(e), [0.25, 0.5, 0.75, 0.95, 0.99, 0.999]) AS p FROM el),
b AS (SELECT avg(c) AS mean_cosine, min(c) AS min_cosine, max(c) AS max_cosine FROM x)
SELECT round(mae, 6) AS mae, round(mse, 8) AS mse, round(sqrt(mse), 6) AS rmse, round(mean_cosine, 6) AS mean_cosine, round(min_cosine, 6) AS min_cosine, round(max_cosine, 6) AS max_cosine, round(p[1], 6) AS p25, round(p[2], 6) AS p50, round(p[3], 6) AS p75, round(p[4], 6) AS p95, round(p[5], 6) AS p99, round(p[6], 6) AS p99_9,
round(10 * log10(power / mse), 4) AS snr_db, round(20 * log10(peak / sqrt(mse)), 4) AS psnr_db, 'A+ (Excellent)' AS grade FROM a, b""")
def quality_metrics(spark, sf_dir):
    m = quality.metrics(decoded(spark, sf_dir, "int8"), accuracy=None)
    return m.select(r6("mae").alias("mae"), F.round("mse", 8).alias("mse"), *[r6(c).alias(c) for c in ("rmse", "mean_cosine", "min_cosine", "max_cosine", "p25", "p50", "p75", "p95", "p99", "p99_9")], F.round("snr_db", 4).alias("snr_db"), F.round("psnr_db", 4).alias("psnr_db"), "grade")


@query(f"""WITH {_ERR}, mo AS (SELECT vec_id, list_avg({dbl('v')}) AS ma, list_avg({dbl('y')}) AS mb, list_dot_product({dbl('v')}, {dbl('v')}) / 64 AS aa, list_dot_product({dbl('y')}, {dbl('y')}) / 64 AS bb, list_dot_product({dbl('v')}, {dbl('y')}) / 64 AS ab FROM x)
SELECT vec_id, round((2 * ma * mb + 1e-4) * (2 * (ab - ma * mb) + 9e-4) / ((ma * ma + mb * mb + 1e-4) * (aa - ma * ma + bb - mb * mb + 9e-4)), 6) AS ssim FROM mo""")
def vector_ssim(spark, sf_dir):
    return quality.per_vector(decoded(spark, sf_dir, "int8")).select(F.col("id").alias("vec_id"), r6("ssim").alias("ssim"))


def _grade_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} >= {least} THEN '{name}'" for least, name in quality.GRADES) + " ELSE 'D (Unacceptable)' END"


@query(f"WITH {_NF4}, d AS (SELECT vec_id, {cos('v', f'list_transform(codes, lambda c: {_NF4_LEVELS}[c + 1] * m)')} AS c FROM e) SELECT vec_id, {_grade_sql('c')} AS grade, c >= 0.995 AS passes FROM d")
def quality_grade(spark, sf_dir):
    c = V.cosine(F.col("vec"), F.col("decoded"))
    return decoded(spark, sf_dir, "nf4").select(F.col("id").alias("vec_id"), quality.grade(c).alias("grade"), quality.passes(c).alias("passes"))


@query(f"WITH {_ERR}, r AS (SELECT c, sqrt(list_dot_product(er, er)) AS l2, sqrt(list_dot_product({dbl('v')}, {dbl('v')})) AS n FROM x) SELECT count(*) AS n, round(avg(c), 6) AS mean_cosine, round(min(c), 6) AS min_cosine, round(quantile_cont(c, 0.05), 6) AS p5_cosine, round(avg(l2), 6) AS mean_l2, round(avg(l2 / n), 6) AS mean_relative FROM r")
def audit_summary(spark, sf_dir):
    a = quality.audit(decoded(spark, sf_dir, "int8"), accuracy=None)
    return a.select("n", *[r6(c).alias(c) for c in a.columns[1:]])


@query(f"WITH {_ERR} SELECT vec_id AS id, round(c, 6) AS cosine, round(sqrt(list_dot_product(er, er)), 6) AS l2_error FROM x ORDER BY c, vec_id LIMIT 10")
def audit_worst_k(spark, sf_dir):
    return quality.worst(decoded(spark, sf_dir, "int8"), 10).select("id", r6("cosine").alias("cosine"), r6("l2_error").alias("l2_error"))


def _recall_sql(found: str, extra: str) -> str:
    truth = f"t AS (SELECT * FROM (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY {cos('query', 'embedding')} DESC, vec_id) AS rank FROM q, embeddings) WHERE rank <= 10)"
    return f"WITH {_Q}{extra}, {truth}, f AS (SELECT * FROM ({found}) WHERE rank <= 10) SELECT t.query_id, round(count(f.id) / 10.0, 6) AS recall FROM t LEFT JOIN f ON f.query_id = t.query_id AND f.id = t.id GROUP BY t.query_id"


@query(_recall_sql(f"SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY {cos('query', 'y')} DESC, vec_id) AS rank FROM q, d", f", {_INT8}, {_DEC}"))
def recall_at_k_int8(spark, sf_dir):
    q, db = asked(spark, sf_dir), vectors(spark, sf_dir)
    r = quality.recall(search.knn(q, db, 10), search.knn(q, arrow.decode(arrow.encode(db, "int8"), "int8", out="vec"), 10), 10)
    return r.select("query_id", r6("recall").alias("recall"))


@query(_recall_sql(f"SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM ({_HAMMING})", ""))
def recall_at_k_binary(spark, sf_dir):
    q, db = asked(spark, sf_dir), vectors(spark, sf_dir)
    r = quality.recall(search.knn(q, db, 10), search.hamming_topk(q, db, 10), 10)
    return r.select("query_id", r6("recall").alias("recall"))


@query(f"WITH r AS ({_recall_sql(f'SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM ({_HAMMING})', '')}), p AS (SELECT avg(recall) AS p, count(*) * 10 AS n, 1.959963984540054 AS z FROM r) SELECT round(p, 6) AS recall, n, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM p")
def recall_estimate(spark, sf_dir):
    q, db = asked(spark, sf_dir), vectors(spark, sf_dir)
    e = quality.recall_estimate(quality.recall(search.knn(q, db, 10), search.hamming_topk(q, db, 10), 10), 10)
    return e.select(r6("recall").alias("recall"), "n", r6("low").alias("low"), r6("high").alias("high"))


_CENTRED = f"{_LONG}, c AS (SELECT dim, CAST(x AS DOUBLE) AS x, avg(CAST(x AS DOUBLE)) OVER (PARTITION BY dim) AS mu FROM long), k AS (SELECT dim, avg((x - mu) ** 2) AS v, avg((x - mu) ** 4) AS f FROM c GROUP BY dim)"


@query(f"WITH {_CENTRED} SELECT CAST(dim AS INTEGER) AS dim, round(v, 6) AS variance, round(f / (v * v) - 3, 5) AS kurtosis FROM k")
def dim_kurtosis(spark, sf_dir):
    return quality.dimension_moments(vectors(spark, sf_dir)).select("dim", r6("variance").alias("variance"), F.round("kurtosis", 5).alias("kurtosis"))


@query(f"WITH {_CENTRED} SELECT CAST(dim AS INTEGER) AS dim, round(v, 6) AS variance FROM k ORDER BY v DESC, dim LIMIT 16")
def outlier_dims(spark, sf_dir):
    return quality.outlier_dimensions(vectors(spark, sf_dir), 16).select("dim", r6("variance").alias("variance"))


def _profiles_sql() -> str:
    parts = []
    for n in ("fast", "balanced", "quality", "ultra"):
        p = select.PROFILES[n]
        s = "list_sort(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))))"
        at = 63 * (p.percentile / 100)
        low = int(at)
        bound = f"({s}[{low + 1}] + ({s}[{min(low + 2, 64)}] - {s}[{low + 1}]) * {at - low!r})" if p.percentile < 100 else "1e30"
        most = 127 if p.bits == 8 else 7
        parts.append(f"SELECT '{n}' AS name, {p.range_factor} AS f, {most} AS most, {p.least_cosine} AS least, vec_id, embedding AS v, list_transform(embedding, lambda x: CAST(greatest(-({bound}), least({bound}, CAST(x AS DOUBLE))) AS FLOAT)) AS w FROM embeddings")
    union = " UNION ALL ".join(parts)
    return f"""WITH c AS ({union}), m AS (SELECT *, CAST(CAST(list_max(list_transform(w, lambda x: abs(x))) AS DOUBLE) / (127.0 * f) AS FLOAT) AS s FROM c),
d AS (SELECT name, least, v, list_transform(w, lambda x: CAST(greatest(-most, least(most, round_even(CAST({ratio_sql('x', 's')} AS DOUBLE), 0))) * CAST(s AS DOUBLE) AS FLOAT)) AS y FROM m)
SELECT name, round(avg({cos('v', 'y')}), 6) AS mean_cosine, round(avg(list_sum(list_transform(range(1, 65), lambda i: abs(CAST(v[i] AS DOUBLE) - y[i]))) / 64), 6) AS mae, avg({cos('v', 'y')}) >= max(least) AS passes FROM d GROUP BY name"""


@query(_profiles_sql().replace("least(most,", "LEAST(most,"))
def int8_profiles_compare(spark, sf_dir):
    return select.compare_profiles(vectors(spark, sf_dir)).select("name", r6("mean_cosine").alias("mean_cosine"), r6("mae").alias("mae"), "passes")


@query()
def profile_grid_search(spark, sf_dir):
    return select.grid_search(vectors(spark, sf_dir))


@query()
def auto_quantize(spark, sf_dir):
    return select.auto_select(vectors(spark, sf_dir))


@query("SELECT * FROM (VALUES ('fast', 1.0), ('balanced', 0.95), ('quality', 0.9)) p(name, factor)".replace("SELECT *", f"SELECT name, round(avg({cos('v', 'y')}), 6) AS mean_cosine FROM (SELECT name, v, list_transform(v, lambda x: CAST(CAST(greatest(-127, least(127, round_even(CAST({ratio_sql('x', 's')} AS DOUBLE), 0))) AS FLOAT) * s AS FLOAT)) AS y FROM (SELECT name, embedding AS v, CAST(CAST(list_max(list_transform(embedding, lambda x: abs(x))) AS DOUBLE) / (127.0 * factor) AS FLOAT) AS s", 1) + ", embeddings)) GROUP BY name")
def int8_range_factors(spark, sf_dir):
    one = [F.struct(F.lit(n).alias("name"), codecs.int8_decode(codecs.int8(F.col("vec"), f)).alias("decoded")) for n, f in select.RANGE_FACTORS.items()]
    rows = vectors(spark, sf_dir).select("vec", F.explode(F.array(*one)).alias("p"))
    return rows.groupBy(F.col("p.name").alias("name")).agg(r6(F.avg(V.cosine(F.col("vec"), F.col("p.decoded")))).alias("mean_cosine"))


# Text, hybrid, fusion -----------------------------------------------------------------------------

_TOK = f"list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '{SPACE}'), lambda w: regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')), lambda w: w <> '')"
_BM = f"""words AS (SELECT doc_id AS id, {_TOK} AS w FROM documents), dl AS (SELECT id, len(w) AS length FROM words),
tf AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest(w) AS term FROM words) GROUP BY ALL),
tot AS (SELECT count(*) AS docs, avg(length) AS mean_length FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
terms AS (SELECT term, df, ln((docs - df + 0.5) / (df + 0.5) + 1) AS idf FROM df, tot)"""
_BMQ = f"bq AS (SELECT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark), asked AS (SELECT query_id, term, count(*) AS times FROM bq GROUP BY ALL), hits AS (SELECT query_id, tf.id, sum(times * idf * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * length / greatest(mean_length, 1.0)))) AS score FROM tf JOIN asked USING (term) JOIN terms USING (term) JOIN dl ON dl.id = tf.id, tot GROUP BY ALL)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"SELECT doc_id, len({_TOK}) AS n_tokens, md5(array_to_string({_TOK}, ' ')) AS tokens_md5 FROM documents")
def tokenize_documents(spark, sf_dir):
    return corpus(spark, sf_dir).select(F.col("id").alias("doc_id"), tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(f"SELECT doc_id, len(list_filter({_TOK}, lambda w: w NOT IN ('the', 'and', 'of', 'to'))) AS n_tokens FROM documents")
def content_token_counts(spark, sf_dir):
    return corpus(spark, sf_dir).select(F.col("id").alias("doc_id"), F.size(content_tokens(F.col("text"), ["the", "and", "of", "to"])).cast("long").alias("n_tokens"))


@query(f"WITH {_BM} SELECT docs AS documents, round(mean_length, 6) AS mean_length, (SELECT count(*) FROM df) AS terms, (SELECT CAST(sum(n) AS BIGINT) FROM tf) AS tokens FROM tot")
def bm25_stats(spark, sf_dir):
    i = bm25.build(corpus(spark, sf_dir))
    return i.totals.crossJoin(i.tf.agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("tokens"))).select("documents", r6("mean_length").alias("mean_length"), "terms", "tokens")


@query(f"WITH {_BM} SELECT term, df, round(idf, 6) AS idf FROM terms")
def idf_terms(spark, sf_dir):
    return bm25.build(corpus(spark, sf_dir)).terms.select("term", "df", r6("idf").alias("idf"))


@query(f"WITH {_BM}, {_BMQ}, " + topk_sql("SELECT query_id, id, round(score, 9) AS score FROM hits", 10))
def bm25_topk(spark, sf_dir):
    found = bm25.search(bm25.build(corpus(spark, sf_dir)), text_queries(spark, sf_dir), 10, digits=9)
    return found.select("query_id", "id", r6("score").alias("score"), "rank")


@query(f"WITH {_BM}, {_BMQ}, " + topk_sql("SELECT query_id, id, round(score, 9) AS score FROM hits", 10))
def bm25_postings_topk(spark, sf_dir):
    """As ``bm25_topk``, from a stored index in blocks of like impact."""
    index = postings.PostingIndex.build(corpus(spark, sf_dir), scratch(spark, "postings"))
    return index.search(text_queries(spark, sf_dir), 10, digits=9).select("query_id", "id", r6("score").alias("score"), "rank")


_LIVE = "documents AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN reverse(text) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)"


@query(f"WITH {_LIVE.replace('documents AS', 'live AS')}, {_BM.replace('FROM documents', 'FROM live')} SELECT term, df, round(idf, 6) AS idf FROM terms")
def maintained_terms(spark, sf_dir):
    """Document frequencies after two batches of additions, one of changes and deletions, and a replay of the second."""
    kept = MaintainedCorpus(spark, scratch(spark, "corpus"))
    docs = corpus(spark, sf_dir)
    for batch, part in ((0, 0), (1, 1), (1, 1)):
        kept.apply(docs.where(F.pmod("id", F.lit(2)) == part), batch)
    changed = docs.where("id % 11 = 0 OR id % 7 = 0").select("id", F.reverse("text").alias("text"), (F.col("id") % 7 == 0).alias("deleted"))
    kept.apply(changed, 2)
    return kept.terms().crossJoin(F.broadcast(kept.totals())).select("term", "df", r6(robertson_idf(F.col("df"), F.col("documents"))).alias("idf"))  # one row of totals


_DENSE = f"dense AS (SELECT query_id, vec_id AS id, {cos('query', 'embedding')} AS score FROM q, embeddings JOIN documents ON doc_id = vec_id)"
_SPARSE = "sparse AS (SELECT 50 * query_id AS query_id, id, round(score, 9) AS score FROM hits)"


def with_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of documents."""
    return vectors(spark, sf_dir).join(corpus(spark, sf_dir).select("id"), "id", "left_semi")


def sparse_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = bm25.score(bm25.build(corpus(spark, sf_dir)), text_queries(spark, sf_dir), with_documents(spark, sf_dir))
    return hits.select((50 * F.col("query_id")).alias("query_id"), "id", F.round("score", 9).alias("score"))


def sparse_best(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k best documents of each text query, for the vector that goes with it."""
    found = bm25.search(bm25.build(corpus(spark, sf_dir)), text_queries(spark, sf_dir), k, digits=9)
    return found.select((50 * F.col("query_id")).alias("query_id"), "id", "score", "rank")


@query(f"""WITH {_Q}, {_BM}, {_BMQ}, {_DENSE}, {_SPARSE}, b AS (SELECT d.query_id, d.id, d.score AS d, coalesce(s.score, 0) AS s FROM dense d LEFT JOIN sparse s ON s.query_id = d.query_id AND s.id = d.id),
n AS (SELECT query_id, min(d) AS d0, max(d) AS d1, min(s) AS s0, max(s) AS s1 FROM b GROUP BY query_id), """ + topk_sql("SELECT query_id, id, 0.7 * CASE WHEN d1 > d0 THEN (d - d0) / (d1 - d0) ELSE 0 END + 0.3 * CASE WHEN s1 > s0 THEN (s - s0) / (s1 - s0) ELSE 0 END AS score FROM b JOIN n USING (query_id)", 10))
def hybrid_search(spark, sf_dir):
    return ranking.hybrid_search(asked(spark, sf_dir), with_documents(spark, sf_dir), sparse_hits(spark, sf_dir), 10, 0.7).select("query_id", "id", r6("score").alias("score"), "rank")


_LISTS = "dr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM dense), sr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM sparse)"


@query(f"WITH {_Q}, {_BM}, {_BMQ}, {_DENSE}, {_SPARSE}, {_LISTS}, u AS (SELECT query_id, id, 1.0 / (60 + rank + 1) AS s FROM dr WHERE rank < 50 UNION ALL SELECT query_id, id, 1.0 / (60 + rank + 1) AS s FROM sr WHERE rank < 50), " + topk_sql("SELECT query_id, id, sum(CAST(s AS DOUBLE)) AS score FROM u GROUP BY ALL", 10))
def rrf_fusion(spark, sf_dir):
    found = [search.knn(asked(spark, sf_dir), with_documents(spark, sf_dir), 50), sparse_best(spark, sf_dir, 50)]
    lists = [x.select("query_id", "id", (F.col("rank") - 1).alias("rank")) for x in found]
    return ranking.rrf_top_k(lists, 10).select("query_id", "id", r6("score").alias("score"), "rank")


_CAND = "cand AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS r FROM sparse) WHERE r < 30)"


def _candidates(spark, sf_dir):
    return sparse_best(spark, sf_dir, 30)


@query(f"WITH {_Q}, {_BM}, {_BMQ}, {_SPARSE}, {_CAND}, " + topk_sql(f"SELECT c.query_id, c.id, {cos('query', 'embedding')} AS score FROM cand c JOIN embeddings ON vec_id = c.id JOIN q ON q.query_id = c.query_id", 10))
def cosine_rerank(spark, sf_dir):
    return ranking.cosine_rerank(asked(spark, sf_dir), _candidates(spark, sf_dir), vectors(spark, sf_dir), 10).select("query_id", "id", r6("score").alias("score"), "rank")


@query(f"""WITH {_Q}, {_BM}, {_BMQ}, {_SPARSE}, {_CAND}, k AS (SELECT c.query_id, c.id, r, CASE WHEN embedding IS NOT NULL THEN {cos('query', 'embedding')} END AS cs, count(*) OVER (PARTITION BY c.query_id) AS n FROM cand c JOIN q ON q.query_id = c.query_id LEFT JOIN embeddings ON vec_id = c.id),
o AS (SELECT query_id, id, r, CASE WHEN cs IS NULL THEN n ELSE row_number() OVER (PARTITION BY query_id ORDER BY cs DESC NULLS LAST, id) - 1 END AS r2 FROM k), """ + topk_sql("SELECT query_id, id, CAST(1 AS DOUBLE) / (61 + r) + CAST(1 AS DOUBLE) / (61 + r2) AS score FROM o", 10))
def rrf_rerank(spark, sf_dir):
    return ranking.rrf_rerank(asked(spark, sf_dir), _candidates(spark, sf_dir), vectors(spark, sf_dir), 10).select("query_id", "id", r6("score").alias("score"), "rank")


@query(f"WITH {_Q} SELECT vec_id AS id, round(sum({cos('query', 'embedding')}), 6) AS score FROM q, embeddings GROUP BY vec_id")
def multi_query_score(spark, sf_dir):
    return search.score_sums(asked(spark, sf_dir), vectors(spark, sf_dir)).select("id", r6("score").alias("score"))


@query(f"""WITH RECURSIVE {_Q}, near AS (SELECT * FROM (SELECT query_id, vec_id AS id, embedding AS v, {cos('query', 'embedding')} AS rel, row_number() OVER (PARTITION BY query_id ORDER BY {cos('query', 'embedding')} DESC, vec_id) AS r FROM q, embeddings) WHERE r <= 20),
lists AS (SELECT query_id, list(id ORDER BY r) AS ids, list(rel ORDER BY r) AS rels, list(v ORDER BY r) AS vs FROM near GROUP BY query_id),
sims AS (SELECT query_id, ids, rels, list_transform(vs, lambda a: list_transform(vs, lambda b: {cos('a', 'b')})) AS sim FROM lists),
steps AS (SELECT query_id, ids, rels, sim, 1 AS rank, [1] AS chosen FROM sims UNION ALL
    SELECT query_id, ids, rels, sim, rank + 1, list_append(chosen, list_position(val, list_max(val))) FROM (SELECT *, list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN list_contains(chosen, i) THEN -1e9 ELSE round(0.5 * rels[i] - 0.5 * list_max(list_transform(chosen, lambda c: sim[i][c])), 12) END) AS val FROM steps WHERE rank < 5))
SELECT query_id, ids[chosen[rank]] AS id, CAST(rank AS INTEGER) AS rank FROM steps""")
def mmr_select(spark, sf_dir):
    q, db = asked(spark, sf_dir), vectors(spark, sf_dir)
    near = search.knn(q, db, 20).join(db.select("id", "vec"), "id")
    return ranking.mmr(q, near, 5)


@query()
def embed_tokens(spark, sf_dir):
    e = select.embed_tokens(corpus(spark, sf_dir), 128)
    return e.select("id", F.size("vec").alias("dims"), r6(V.norm(F.col("vec"))).alias("norm"), r6(F.col("vec")[0]).alias("first"))


# Mutation ------------------------------------------------------------------------------------------------

_OLD, _NEW = "vec_id % 3 <> 0", "vec_id % 2 = 0"


def _changes(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", "label")
    return v.where("id % 3 <> 0"), v.where("id % 2 = 0").withColumn("label", F.col("label") + 100)


@query(f"SELECT vec_id AS id, CAST(label AS INTEGER) AS label FROM embeddings WHERE {_OLD} UNION ALL SELECT vec_id, CAST(label + 100 AS INTEGER) FROM embeddings WHERE {_NEW} AND NOT ({_OLD})")
def upsert_skip(spark, sf_dir):
    return store.write(*_changes(spark, sf_dir), "skip")


@query(f"SELECT vec_id AS id, CAST(label AS INTEGER) AS label FROM embeddings WHERE {_OLD} AND NOT ({_NEW}) UNION ALL SELECT vec_id, CAST(label + 100 AS INTEGER) FROM embeddings WHERE {_NEW}")
def upsert_overwrite(spark, sf_dir):
    return store.write(*_changes(spark, sf_dir), "overwrite")


@query(f"SELECT CASE WHEN {_OLD} THEN 'update' ELSE 'insert' END AS action, count(*) AS n FROM embeddings WHERE {_NEW} GROUP BY 1")
def upsert_counts(spark, sf_dir):
    return store.write_counts(*_changes(spark, sf_dir))


@query("SELECT vec_id AS id, label FROM embeddings WHERE label <> 3")
def delete_by_id(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", "label")
    return store.delete(v, v.where("label = 3"))


@query("SELECT vec_id AS id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS new_id FROM embeddings WHERE vec_id % 5 <> 0")
def compact(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id")
    return store.compact(v, store.tombstone(None, v.where("id % 5 = 0")), renumber=True).select("id", F.col("new_id").cast("long").alias("new_id"))


@query("SELECT count(*) AS total, count(*) - count(*) FILTER (WHERE vec_id % 5 = 0) AS alive, count(*) FILTER (WHERE vec_id % 5 = 0) AS deleted, 64 AS dims, round(256 / 68.0, 6) AS ratio FROM embeddings")
def store_stats(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id")
    return store.stats(v, store.tombstone(None, v.where("id % 5 = 0")), 64, codecs.CODECS["int8"].bytes(64)).select("total", "alive", "deleted", "dims", r6("ratio").alias("ratio"))


@query("SELECT e.vec_id AS id, e.label FROM embeddings e WHERE vec_id % 7 = 0")
def fetch_by_id(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", "label")
    return search.by_ids(v, v.where("id % 7 = 0"))


# Trained operators, here with chosen rows as centroids where SQL is to agree ------------------------------------------------

_BOOK = "cb AS (SELECT m, CAST(row_number() OVER (PARTITION BY m ORDER BY vec_id) - 1 AS INTEGER) AS k, embedding[m * 8 + 1:m * 8 + 8] AS c FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 16), range(8) t(m))"


def fixed_book(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """Codebook (8, 16, 8) of the first 16 rows' parts."""
    rows = vectors(spark, sf_dir).orderBy("id").limit(16).collect()
    return np.array([r["vec"] for r in rows], np.float32).reshape(16, 8, 8).transpose(1, 0, 2)


_PART = "list_transform(range(1, 9), lambda i: {0}[m * 8 + i])"
_DISTS = f"ds AS (SELECT vec_id, cb.m, k, list_sum(list_transform(range(1, 9), lambda i: (CAST(embedding[cb.m * 8 + i] AS DOUBLE) - CAST(c[i] AS DOUBLE)) ** 2)) AS d, c FROM embeddings, cb), pc AS (SELECT vec_id, m, arg_min(k, (d, k)) AS k, arg_min(c, (d, k)) AS c FROM ds GROUP BY vec_id, m)"


@query(f"WITH {_BOOK}, {_DISTS} SELECT vec_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY m) AS codes FROM pc GROUP BY vec_id")
def pq_encode_fixed(spark, sf_dir):
    book = fixed_book(spark, sf_dir)
    return vectors(spark, sf_dir).select("id", search.pq_codes(F.col("vec"), book.tolist()).alias("codes")).transform(listed(F.col("codes")))


@query(f"WITH {_Q}, {_BOOK}, {_DISTS}, " + topk_sql("SELECT query_id, vec_id AS id, sum(list_sum(list_transform(range(1, 9), lambda i: (CAST(query[m * 8 + i] AS DOUBLE) - CAST(c[i] AS DOUBLE)) ** 2))) AS distance FROM q, pc GROUP BY ALL", 10, "round(distance, 9)", "query_id, id, round(distance, 6) AS distance, rank"))
def pq_adc_topk(spark, sf_dir):
    book = fixed_book(spark, sf_dir)
    coded = search.pq_encode(vectors(spark, sf_dir), book)
    return search.adc_topk(asked(spark, sf_dir), coded, book, 10).select("query_id", "id", r6("distance").alias("distance"), "rank")


_BOOK2 = "cb2 AS (SELECT m, CAST(row_number() OVER (PARTITION BY m ORDER BY vec_id) - 1 AS INTEGER) AS k, list_transform(embedding[m * 8 + 1:m * 8 + 8], lambda x: CAST(x AS DOUBLE) / 2) AS c FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 16 OFFSET 16), range(8) t(m))"
_RESIDUAL = f"""{_BOOK}, {_BOOK2}, {_DISTS},
rs AS (SELECT vec_id, m, k, c, list_transform(range(1, 9), lambda i: CAST(embedding[m * 8 + i] AS DOUBLE) - CAST(c[i] AS DOUBLE)) AS r FROM pc JOIN embeddings USING (vec_id)),
d2 AS (SELECT vec_id, rs.m, cb2.k, list_sum(list_transform(range(1, 9), lambda i: (r[i] - cb2.c[i]) ** 2)) AS d, cb2.c FROM rs JOIN cb2 ON rs.m = cb2.m),
p2 AS (SELECT vec_id, m, arg_min(k, (d, k)) AS k2, arg_min(c, (d, k)) AS c2 FROM d2 GROUP BY vec_id, m),
rq AS (SELECT rs.vec_id, rs.m, k, k2, list_transform(range(1, 9), lambda i: CAST(c[i] AS DOUBLE) + c2[i]) AS y FROM rs JOIN p2 ON p2.vec_id = rs.vec_id AND p2.m = rs.m)"""


def fixed_residual(spark: SparkSession, sf_dir: str) -> training.ResidualCodebook:
    """Two passes: the parts of the first 16 rows, and half the parts of the next 16."""
    rows = vectors(spark, sf_dir).orderBy("id").limit(32).collect()
    second = np.array([r["vec"] for r in rows[16:]], np.float64).reshape(16, 8, 8).transpose(1, 0, 2) / 2
    return training.ResidualCodebook((fixed_book(spark, sf_dir), second), 64)


@query(f"WITH {_RESIDUAL} SELECT vec_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY m) || ',' || string_agg(CAST(k2 AS VARCHAR), ',' ORDER BY m) AS codes, round(sum(list_sum(list_transform(y, lambda x: x * x))), 6) AS norm FROM rq GROUP BY vec_id")
def rq_encode_fixed(spark, sf_dir):
    made = coded.encode(vectors(spark, sf_dir), coded.residual(fixed_residual(spark, sf_dir)))
    return made.transform(listed(F.col("code.codes"), r6(F.col("code.more")[0]).alias("norm")))


@query(f"WITH {_Q}, {_RESIDUAL}, " + topk_sql("SELECT query_id, vec_id AS id, sqrt(sum(list_sum(list_transform(range(1, 9), lambda i: (CAST(query[m * 8 + i] AS DOUBLE) - y[i]) ** 2)))) AS distance FROM q, rq GROUP BY ALL", 10, "round(distance, 9)", "query_id, id, round(distance, 6) AS distance, rank"))
def rq_adc_topk(spark, sf_dir):
    """Search on residual codes with additive tables and stored norms."""
    codec = coded.residual(fixed_residual(spark, sf_dir))
    found = coded.topk(asked(spark, sf_dir), coded.encode(vectors(spark, sf_dir), codec), codec, 10, "l2")
    return found.select("query_id", "id", r6(-F.col("score")).alias("distance"), "rank")


_CENT = "ce AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS list_id, embedding AS centroid FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 8)), asg AS (SELECT vec_id, embedding, arg_min(list_id, (-s, list_id)) AS list_id FROM (SELECT vec_id, embedding, list_id, list_dot_product(" + dbl("embedding") + ", " + dbl("centroid") + ") AS s FROM embeddings, ce) GROUP BY ALL), pr AS (SELECT query_id, query, list_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, list_id) AS probe FROM (SELECT query_id, query, list_id, list_dot_product(" + dbl("query") + ", " + dbl("centroid") + ") AS s FROM q, ce))"


def fixed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).orderBy("id").limit(8).collect()
    return spark.createDataFrame([(i, [float(x) for x in r["vec"]]) for i, r in enumerate(rows)], "list_id int, centroid array<double>")


@query(f"WITH {_Q}, {_CENT} SELECT vec_id, list_id FROM asg")
def ivf_assign(spark, sf_dir):
    return search.assign(vectors(spark, sf_dir), fixed_lists(spark, sf_dir)).select(F.col("id").alias("vec_id"), "list_id")


@query(f"WITH {_Q}, {_CENT}, " + topk_sql(f"SELECT query_id, vec_id AS id, {cos('query', 'embedding')} AS score FROM asg JOIN pr USING (list_id) WHERE probe <= 3", 10))
def ivf_search(spark, sf_dir):
    lists = fixed_lists(spark, sf_dir)
    return search.ivf_search(asked(spark, sf_dir), search.assign(vectors(spark, sf_dir), lists), lists, 10, 3).select("query_id", "id", r6("score").alias("score"), "rank")


@query(f"WITH {_Q}, {_CENT}, " + topk_sql(f"SELECT query_id, vec_id AS id, {cos('query', 'embedding')} AS score FROM asg JOIN pr USING (list_id) WHERE probe <= 3 AND vec_id % 2 = 0", 5))
def ivf_search_filtered(spark, sf_dir):
    lists = fixed_lists(spark, sf_dir)
    return search.ivf_search(asked(spark, sf_dir), search.assign(vectors(spark, sf_dir), lists), lists, 5, 3, where=F.col("id") % 2 == 0).select("query_id", "id", r6("score").alias("score"), "rank")


@query(ORACLE_SQL["knn_cosine_topk"])
def ivf_exact_topk(spark, sf_dir):
    """Exact search over an inverted file, by bounds on its lists."""
    cents = fixed_lists(spark, sf_dir)
    index = search.assign(vectors(spark, sf_dir), cents)
    return lists.exact(asked(spark, sf_dir), index, cents, 10).select("query_id", "id", r6("score").alias("score"), "rank")


@query(f"WITH {_Q}, {_CENT}, " + topk_sql(f"SELECT query_id, vec_id AS id, {cos('query', 'embedding')} AS score FROM asg JOIN pr USING (list_id) JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) WHERE probe <= 3 AND label = 3", 5))
def ivf_search_summaries(spark, sf_dir):
    """Filtered search that reads no list whose summary rules the filter out."""
    cents = fixed_lists(spark, sf_dir)
    index = search.assign(vectors(spark, sf_dir), cents)
    found = lists.filtered_search(asked(spark, sf_dir), index, cents, 5, 3, [("label", "==", 3)], lists.summaries(index, ["label"]))
    return found.select("query_id", "id", r6("score").alias("score"), "rank")


@query(f"WITH {_Q}, {_CENT}, ex AS (SELECT * FROM (SELECT query_id, probe, row_number() OVER (PARTITION BY query_id ORDER BY {cos('query', 'embedding')} DESC, vec_id) AS r FROM asg JOIN pr USING (list_id)) WHERE r <= 10), rc AS (SELECT query_id, n, count(*) FILTER (WHERE probe <= n) / 10.0 AS recall FROM ex, (VALUES (1), (2), (4), (8)) t(n) GROUP BY ALL) SELECT query_id, min(n) AS n_probe, round(arg_min(recall, n), 6) AS recall FROM rc WHERE recall >= 0.9 GROUP BY query_id")
def ivf_probe_for_recall(spark, sf_dir):
    lists = fixed_lists(spark, sf_dir)
    return search.probes_for_recall(asked(spark, sf_dir), search.assign(vectors(spark, sf_dir), lists), lists, 10, 0.9).select("query_id", "n_probe", r6("recall").alias("recall"))


@query()
def pq_train(spark, sf_dir):
    v = vectors(spark, sf_dir)
    book = training.pq_train(v, 16, 64, 6)
    return quality.mean_cosine(training.mapped(v, lambda x: training.pq_restore(training.pq_assign(x, book), book))).select(F.round("mean_cosine", 3).alias("mean_cosine"))


@query()
def opq_train(spark, sf_dir):
    v = vectors(spark, sf_dir)
    rotation, book = training.opq_train(v, 16, 64, 3)
    return quality.mean_cosine(training.mapped(v, lambda x: training.pq_restore(training.pq_assign(x @ rotation, book), book) @ rotation.T)).select(F.round("mean_cosine", 3).alias("mean_cosine"))


@query()
def rq_train(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return select.residual_cosine(v, training.rq_train(v, 3, 16, 64)).select(F.round("mean_cosine", 3).alias("mean_cosine"))


@query()
def ivf_train(spark, sf_dir):
    from lodestar.operators.ann import AnnIndex

    v = vectors(spark, sf_dir)
    lists = training.ivf_train(v, 16)
    rows = search.assign(v, lists)
    found = search.ivf_search(asked(spark, sf_dir), rows, lists, 10, AnnIndex(rows, lists).probes(10))
    return quality.recall(search.knn(asked(spark, sf_dir), v, 10), found, 10)


@query(f"WITH {_Q}, {_CENT}, {_BOOK}, {_DISTS}, " + topk_sql("SELECT query_id, vec_id AS id, sum(list_sum(list_transform(range(1, 9), lambda i: (CAST(query[m * 8 + i] AS DOUBLE) - CAST(c[i] AS DOUBLE)) ** 2))) AS distance FROM pc JOIN asg USING (vec_id) JOIN pr USING (list_id) WHERE probe <= 3 GROUP BY query_id, vec_id", 10, "round(distance, 9)", "query_id, id, round(distance, 6) AS distance, rank"))
def ivf_pq_search(spark, sf_dir):
    lists, book = fixed_lists(spark, sf_dir), fixed_book(spark, sf_dir)
    index = search.pq_encode(search.assign(vectors(spark, sf_dir), lists), book).select("id", "list_id", "codes")
    return search.ivf_pq_search(asked(spark, sf_dir), index, lists, book, 10, 3).select("query_id", "id", r6("distance").alias("distance"), "rank")


@query()
def ivf_pq_trained(spark, sf_dir):
    v = vectors(spark, sf_dir)
    lists, book = training.ivf_train(v, 16), training.pq_train(v, 32, 64, 6)
    index = search.pq_encode(search.assign(v, lists), book).select("id", "list_id", "codes")
    return search.ivf_pq_search(asked(spark, sf_dir), index, lists, book, 10, 8).select("query_id", "id", r6("distance").alias("distance"), "rank")


@query()
def kmeans_clusters(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return training.clusters(v, training.kmeans(v, 10)).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query()
def pca_2d(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return training.pca_project(v, *training.pca(v, 2)).select(F.col("id").alias("vec_id"), F.round(F.col("projected")[0].cast("double"), 4).alias("x"), F.round(F.col("projected")[1].cast("double"), 4).alias("y"))


@query()
def autoencoder(spark, sf_dir):
    v = vectors(spark, sf_dir)
    model = training.autoencoder_train(v, 32)
    return quality.mean_cosine(training.mapped(v, lambda x: model.decode(model.encode(x)))).select(F.round("mean_cosine", 2).alias("mean_cosine"))


def _rounded_sql(x: str, bits: int, least: int = -1000) -> str:
    """Nearest number with ``bits`` binary digits after the first, halves to even; none finer than 2 ** least."""
    ulp = f"pow(2.0, greatest(floor(log2(abs(CAST({x} AS DOUBLE)))) - {bits}, {least}))"
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE round_even(CAST({x} AS DOUBLE) / {ulp}, 0) * {ulp} END"


@query(f"SELECT vec_id, round({cos('embedding', 'list_transform(embedding, lambda x: ' + _rounded_sql('x', 7) + ')')}, 6) AS cosine FROM embeddings")
def bf16_roundtrip(spark, sf_dir):
    rows = training.mapped(vectors(spark, sf_dir), lambda x: training.bf16_restore(training.bf16(x)))
    return rows.select(F.col("id").alias("vec_id"), r6(V.cosine(F.col("vec"), F.col("decoded"))).alias("cosine"))


@query(f"""WITH {_CENTRED}, o AS (SELECT list(dim) AS top FROM (SELECT dim FROM k ORDER BY v DESC, dim LIMIT 16)),
m AS (SELECT vec_id, embedding AS v, top, list_max(list_transform(range(64), lambda i: CASE WHEN list_contains(top, i) THEN 0 ELSE abs(embedding[i + 1]) END)) AS m FROM embeddings, o),
d AS (SELECT vec_id, v, list_transform(range(64), lambda i: CASE WHEN list_contains(top, i) THEN {_rounded_sql('v[i + 1]', 10, -24)}
    ELSE CAST({_NF4_LEVELS}[1 + len(list_filter({_levels_sql()}, lambda t: t < CAST(v[i + 1] / m AS FLOAT)))] * m AS FLOAT) END) AS y FROM m)
SELECT vec_id, round({cos('v', 'y')}, 6) AS cosine FROM d""")
def nf4_mixed_roundtrip(spark, sf_dir):
    v = vectors(spark, sf_dir)
    top = [r["dim"] for r in quality.outlier_dimensions(v, 16).collect()]
    return training.mapped(v, lambda x: training.nf4_mixed(x, top)).select(F.col("id").alias("vec_id"), r6(V.cosine(F.col("vec"), F.col("decoded"))).alias("cosine"))


_MIXED = f"""{_CENTRED}, o AS (SELECT list(dim) AS top FROM (SELECT dim FROM k ORDER BY v DESC, dim LIMIT 16)),
mx AS (SELECT vec_id, embedding AS v, top, list_max(list_transform(range(64), lambda i: CASE WHEN list_contains(top, i) THEN 0 ELSE abs(embedding[i + 1]) END)) AS m FROM embeddings, o)"""


@query(f"""WITH {_MIXED} SELECT vec_id, array_to_string(list_transform(list_filter(range(64), lambda i: NOT list_contains(top, i)), lambda i: len(list_filter({_levels_sql()}, lambda t: t < CAST(v[i + 1] / m AS FLOAT)))), ',') AS codes,
round(CAST(m AS DOUBLE), 6) AS scale, round(list_sum(list_transform(list_filter(range(64), lambda i: list_contains(top, i)), lambda i: {_rounded_sql('v[i + 1]', 10, -24)})), 6) AS outlier_sum FROM mx""")
def nf4_mixed_encode(spark, sf_dir):
    """4-bit codes, scale, and the sum of the outlier dimensions in half precision."""
    v = vectors(spark, sf_dir)
    codec = coded.mixed(64, [r["dim"] for r in quality.outlier_dimensions(v, 16).collect()])
    made = coded.encode(v, codec)
    return made.transform(listed(F.col("code.codes"), r6(F.col("code.more")[0]).alias("scale"), r6(F.aggregate(F.slice("code.more", 2, 16), F.lit(0.0), lambda a, x: a + x)).alias("outlier_sum")))


@query(f"WITH {_NF4} SELECT 'm' || (vec_id % 4) AS module, CASE WHEN vec_id % 8 < 4 THEN 'A' ELSE 'B' END AS matrix, count(*) AS rows, round(avg({cos('v', f'list_transform(codes, lambda c: {_NF4_LEVELS}[c + 1] * m)')}), 6) AS mean_cosine FROM e GROUP BY ALL")
def lora_pairs(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.concat(F.lit("m"), (F.col("id") % 4).cast("string")).alias("module"), F.when(F.col("id") % 8 < 4, "A").otherwise("B").alias("matrix"), F.col("id").alias("row_id"), "vec")
    return select.lora(rows).select("module", "matrix", "rows", r6("mean_cosine").alias("mean_cosine"))


@query("SELECT name, round(CAST(ratio AS DOUBLE), 6) AS ratio FROM (VALUES " + ", ".join(f"('{n}', {c.ratio(64)!r})" for n, c in codecs.CODECS.items()) + ") t(name, ratio)")
def codec_ratios(spark, sf_dir):
    return spark.createDataFrame([(n, float(c.ratio(64))) for n, c in codecs.CODECS.items()], "name string, ratio double").select("name", r6("ratio").alias("ratio"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_windowed(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


# Sweeps, stored forms, self-search --------------------------------------------------------------------------


@query(f"WITH {_Q} SELECT query_id, vec_id AS id, round({cos('query', 'embedding')}, 6) AS score FROM q, embeddings")
def cosine_matrix(spark, sf_dir):
    return retriever.cosine_matrix(asked(spark, sf_dir), vectors(spark, sf_dir)).select("query_id", "id", r6("score").alias("score"))


@query(f"WITH p AS (SELECT dims, embedding[1:dims] AS v FROM embeddings, (VALUES (8), (16), (32), (64)) t(dims)), m AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) AS m FROM p), {int8_sql()}, d AS (SELECT dims, v, list_transform(codes, lambda c: CAST(CAST(c AS FLOAT) * s AS FLOAT)) AS y FROM e) SELECT dims, round(avg({cos('v', 'y')}), 6) AS mean_cosine FROM d GROUP BY dims")
def quality_by_dims(spark, sf_dir):
    return retriever.by_dimensions(vectors(spark, sf_dir), "int8", [8, 16, 32, 64]).select("dims", r6("mean_cosine").alias("mean_cosine"))


@query("SELECT event_type, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    found = quantiles.exact(table(spark, sf_dir, "events"), F.col("value"), [0.5, 0.95, 0.99], ["event_type"], linear=False)
    rank = lambda p: F.round(F.max(F.when(F.col("fraction") == p, F.col("value"))), 6)
    return found.groupBy("event_type").agg(rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"))


_U8 = f"{_LONG}, t AS (SELECT dim, CAST(min(x) AS DOUBLE) AS low, CAST(max(x) AS DOUBLE) AS high FROM long GROUP BY dim), d AS (SELECT vec_id, list(CAST(low + round(greatest(0.0, least(1.0, CAST((CAST(x AS DOUBLE) - low) / (high - low) AS FLOAT))) * 255, 0) / 255.0 * (high - low) AS FLOAT) ORDER BY dim) AS y FROM long JOIN t USING (dim) GROUP BY vec_id)"


def u8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.minmax(vectors(spark, sf_dir)).select("id", codecs.minmax_decode(F.col("codes"), F.col("lows"), F.col("highs")).alias("vec"))


@query(f"WITH {_Q}, {_U8}, " + topk_sql(f"SELECT query_id, vec_id AS id, {cos('query', 'y')} AS score FROM q, d", 5))
def minmax_topk(spark, sf_dir):
    return search.knn(asked(spark, sf_dir), u8_decoded(spark, sf_dir), 5).select("query_id", "id", r6("score").alias("score"), "rank")


@query(f"WITH {_Q}, {_U8}, b AS (SELECT query_id, max({cos('query', 'y')}) AS c FROM q, d GROUP BY query_id) SELECT round(avg(c), 6) AS mean, round(min(c), 6) AS least, round(max(c), 6) AS most FROM b")
def self_search_u8(spark, sf_dir):
    sample = asked(spark, sf_dir).select(F.col("query_id").alias("id"))
    s = retriever.self_search(vectors(spark, sf_dir), u8_decoded(spark, sf_dir), sample)
    return s.select(r6("mean").alias("mean"), r6("least").alias("least"), r6("most").alias("most"))


@query(f"WITH {_ERR} SELECT round(avg(c), 6) AS mean_cosine FROM x")
def mean_cosine(spark, sf_dir):
    return quality.mean_cosine(decoded(spark, sf_dir, "int8")).select(r6("mean_cosine").alias("mean_cosine"))


@query(f"WITH {_ERR} SELECT round(avg(greatest(-1, least(1, c))), 6) AS fidelity FROM x")
def cosine_fidelity(spark, sf_dir):
    return quality.fidelity(decoded(spark, sf_dir, "int8")).select(r6("fidelity").alias("fidelity"))


@query("SELECT e.vec_id AS id, CASE WHEN q.c >= 0.9999 THEN 'int8' WHEN q.c >= 0.98 AND q.r <= 8 THEN 'nf4' WHEN q.r <= 16 THEN 'pq' ELSE 'rq' END AS format FROM embeddings e, LATERAL (SELECT 0.95 + (e.vec_id % 6) * 0.01 AS c, (e.vec_id % 20) AS r) q")
def format_choice(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return v.select("id", select.format_by_targets(F.lit(0.95).cast("decimal(10,2)") + (F.col("id") % 6) * F.lit(0.01).cast("decimal(10,2)"), F.col("id") % 20).alias("format"))


@query("SELECT vec_id AS id, sha256('local:hash:' || label) AS key FROM embeddings")
def embedding_cache_keys(spark, sf_dir):
    from lodestar.functions.text import cache_key

    return vectors(spark, sf_dir).select("id", cache_key(F.lit("local"), F.lit("hash"), F.col("label").cast("string")).alias("key"))


@query(f"WITH {_Q}, {_CENT}, f AS (SELECT query_id, count(*) AS rows FROM asg JOIN pr USING (list_id) WHERE probe <= 2 GROUP BY query_id) SELECT * FROM f")
def ivf_probed_rows(spark, sf_dir):
    lists = fixed_lists(spark, sf_dir)
    index = search.assign(vectors(spark, sf_dir), lists)
    return index.join(search.probes(asked(spark, sf_dir), lists, 2), "list_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("rows"))


@query()
def graph_search(spark, sf_dir):
    """Ten nearest of every query vector by the proximity graph."""
    index = graph.GraphIndex.build(vectors(spark, sf_dir))
    return index.search(asked(spark, sf_dir), 10).select("query_id", "id", r6("score").alias("score"), "rank")


@query()
def graph_recall(spark, sf_dir):
    """Recall of the graph against exact search, with its 95 % interval, and the graph's shape by layer."""
    index = graph.GraphIndex.build(vectors(spark, sf_dir))
    return index.stats().crossJoin(F.broadcast(index.recall_estimate(asked(spark, sf_dir))))  # one row of recall


@query()
def ann_search(spark, sf_dir):
    from lodestar.operators.ann import AnnIndex

    v = vectors(spark, sf_dir)
    return AnnIndex.build(v, 16).search(asked(spark, sf_dir), 10, 64).select("query_id", "id", r6("score").alias("score"), "rank")


@query()
def ann_recall(spark, sf_dir):
    from lodestar.operators.ann import AnnIndex

    return AnnIndex.build(vectors(spark, sf_dir), 16).recall_estimate(20, 10, 128)


@query("SELECT vec_id, " + ", ".join(f"CASE WHEN embedding[{i}] IS NULL THEN 0 ELSE 1 END AS d{i}" for i in (1, 64)) + ", 64 AS dims FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0")
def valid_vectors(spark, sf_dir):
    from lodestar.session import valid

    one = lambda i: F.when(F.col("vec")[i].isNull(), 0).otherwise(1)
    return valid(vectors(spark, sf_dir), 64).select(F.col("id").alias("vec_id"), one(0).alias("d1"), one(63).alias("d64"), F.size("vec").alias("dims"))
