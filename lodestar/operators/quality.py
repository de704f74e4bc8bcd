"""Fidelity of decoded vectors: metrics, audits, recall.

Inputs have one row per vector: ``(id, vec, decoded)``.  Per-row numbers are
expressions; everything over the table is one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import vec as V
from lodestar.operators import quantiles

#: Lowest mean cosine of each grade (fixed values).
GRADES = ((0.999, "A+ (Excellent)"), (0.995, "A (Very Good)"), (0.99, "B+ (Good)"), (0.985, "B (Acceptable)"), (0.98, "C+ (Fair)"), (0.97, "C (Poor)"))

PERCENTILES = (25, 50, 75, 95, 99, 99.9)


def grade(cosine: Column) -> Column:
    out = F.lit("D (Unacceptable)")
    for least, name in reversed(GRADES):
        out = F.when(cosine >= least, name).otherwise(out)
    return out


def passes(cosine: Column, least: float = 0.995) -> Column:
    return cosine >= least


def ssim(a: Column, b: Column) -> Column:
    """Structural similarity of two vectors, with constants 1e-4 and 9e-4."""
    ma, mb, n = V.mean(a), V.mean(b), F.when(F.size(a) > 0, F.size(a))
    va, vb = V.dot(a, a) / n - ma * ma, V.dot(b, b) / n - mb * mb
    cov = V.dot(a, b) / n - ma * mb
    return (2 * ma * mb + 1e-4) * (2 * cov + 9e-4) / ((ma * ma + mb * mb + 1e-4) * (va + vb + 9e-4))


def per_vector(df: DataFrame) -> DataFrame:
    """id with cosine, L2 error, error relative to the norm, and the sums that the metrics need."""
    a, b = F.col("vec"), F.col("decoded")
    errors = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return (
        df.select("id", "vec", "decoded", errors.alias("errors"))
        .select(
            "id", V.cosine(a, b).alias("cosine"), V.norm(F.col("errors")).alias("l2_error"), V.norm(a).alias("norm"), "errors", ssim(a, b).alias("ssim"),
            F.size("vec").alias("dims"), V.dot(a, a).alias("signal"), F.array_max("vec").cast("double").alias("top"),
        )
        .withColumn("relative_error", F.when(F.col("norm") > 0, F.col("l2_error") / F.col("norm")).otherwise(0.0))
    )


def _percentiles(df: DataFrame, c: Column, at: list[float], accuracy: int | None) -> DataFrame:
    """One row with an array ``p``: exact percentiles, linear between ranks, or those of a sketch of fixed size."""
    if accuracy is not None:
        return df.agg(F.percentile_approx(c, F.array(*[F.lit(p) for p in at]), F.lit(accuracy)).alias("p"))
    found = quantiles.exact(df, c, at).agg(F.array_sort(F.collect_list(F.struct("fraction", "value"))).alias("q"))  # a row per fraction
    return found.select(F.transform("q", lambda r: r["value"]).alias("p"))


def metrics(df: DataFrame, ratio: float | None = None, accuracy: int | None = 10_000) -> DataFrame:
    """One row: errors, cosines, error percentiles, SNR, PSNR, SSIM, ratio.

    Percentiles come from a mergeable sketch whose ranks are within 1 / ``accuracy``.  With
    None they are exact and linear between ranks, by counting ranges (``quantiles``), which reads the rows a few times.
    """
    rows = per_vector(df)
    each = rows.select(F.explode("errors").alias("e"))
    size = F.sum("dims")
    whole = rows.agg(
        (F.sum(V.total(F.transform("errors", lambda e: F.abs(e)))) / size).alias("mae"), (F.sum(F.col("l2_error") * F.col("l2_error")) / size).alias("mse"),
        F.avg("cosine").alias("mean_cosine"), F.min("cosine").alias("min_cosine"), F.max("cosine").alias("max_cosine"), F.avg("ssim").alias("ssim"),
        (F.sum("signal") / size).alias("power"), F.max("top").alias("peak"), (size * 4 / (size + 4 * F.count(F.lit(1)))).alias("estimated"),
    )
    tail = _percentiles(each, F.abs("e"), [p / 100 for p in PERCENTILES], accuracy)
    inf = F.lit(float("inf"))
    return whole.crossJoin(tail).select(
        "mae", "mse", F.sqrt("mse").alias("rmse"), "mean_cosine", "min_cosine", "max_cosine", *[F.get("p", F.lit(i)).alias(f"p{str(p).replace('.', '_')}") for i, p in enumerate(PERCENTILES)],
        F.when(F.col("mse") == 0, inf).otherwise(10 * F.log10(F.col("power") / F.col("mse"))).alias("snr_db"), F.when(F.col("mse") == 0, inf).otherwise(20 * F.log10(F.col("peak") / F.sqrt("mse"))).alias("psnr_db"),
        "ssim", F.coalesce(F.lit(ratio), F.col("estimated")).alias("ratio"), grade(F.col("mean_cosine")).alias("grade"),
    )


def mean_cosine(df: DataFrame) -> DataFrame:
    """One row: mean cosine, where two zero vectors count 1 and one zero vector 0."""
    a, b = V.norm(F.col("vec")), V.norm(F.col("decoded"))
    one = F.when((a == 0) & (b == 0), 1.0).otherwise(V.cosine(F.col("vec"), F.col("decoded")))
    return df.agg(F.avg(one).alias("mean_cosine"))


def fidelity(df: DataFrame) -> DataFrame:
    """One row: mean cosine of the rows without zero vectors, held within -1 and 1."""
    a, b = V.norm(F.col("vec")), V.norm(F.col("decoded"))
    return df.where((a > 0) & (b > 0)).agg(F.avg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.cosine(F.col("vec"), F.col("decoded"))))).alias("fidelity"))


def audit(df: DataFrame, accuracy: int | None = 10_000) -> DataFrame:
    """One row: vectors, mean, least and 5th-percentile cosine, mean L2 and relative error; ``accuracy`` as in ``metrics``."""
    rows = per_vector(df)
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("cosine").alias("mean_cosine"), F.min("cosine").alias("min_cosine"), F.avg("l2_error").alias("mean_l2"), F.avg("relative_error").alias("mean_relative"))
    low = _percentiles(rows, F.col("cosine"), [0.05], accuracy)
    return whole.crossJoin(low).select("n", "mean_cosine", "min_cosine", F.get("p", F.lit(0)).alias("p5_cosine"), "mean_l2", "mean_relative")  # one row each


def worst(df: DataFrame, k: int) -> DataFrame:
    """The k rows with the lowest cosine."""
    return per_vector(df).select("id", "cosine", "l2_error", "relative_error").orderBy("cosine", "id").limit(k)


def recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``(query_id, recall)``: how many of the true k (query_id, id, rank) were found among the first k."""
    right = found.where(F.col("rank") <= k).select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    return truth.where(F.col("rank") <= k).join(right, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") / k).alias("recall"))


def sampled(df: DataFrame, one_in: int, seed: int = 42) -> DataFrame:
    """Rows by a hash of the id: the same rows whatever the partitioning."""
    return df.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(one_in)) == 0)


def recall_estimate(per_query: DataFrame, k: int) -> DataFrame:
    """One row: recall over all queries and its 95 % Wilson interval."""
    n = F.count(F.lit(1)) * k
    whole = per_query.agg(F.avg("recall").alias("recall"), n.alias("n"))
    return whole.select("recall", "n", V.wilson(F.col("recall") * F.col("n"), F.col("n")).alias("i")).select("recall", "n", "i.low", "i.high")


def dimension_moments(df: DataFrame) -> DataFrame:
    """``(dim, mean, variance, kurtosis)`` with population moments; kurtosis is excess."""
    long = df.select(F.posexplode("vec").alias("dim", "y")).select("dim", F.col("y").cast("double").alias("x"))
    return long.groupBy("dim").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("variance"), F.kurtosis("x").alias("kurtosis"))


def outlier_dimensions(df: DataFrame, k: int) -> DataFrame:
    """The k dimensions with the largest variance."""
    return dimension_moments(df).orderBy(F.desc("variance"), "dim").limit(k)
