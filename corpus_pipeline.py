"""Corpus pipeline: quality rules, near-duplicates, repeated passages, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``documents`` and work on what the stage before kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import jaccard, packing, quality, secrets, substring
from lodestar.llm.queries import RANKS, TOKENIZER
from lodestar.llm.scratch import sized, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised verdict keeps.

    Null and empty texts have too few words and go; repeated rows are judged alike, and all stay or go.
    """
    return quality.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group with five-word shingles of Jaccard 0.8 or more.

    Rows are told apart by id and text, so texts that share an id stay if they aren't alike.
    Rows equal in both are one document, of which the row with the smallest other columns
    stays.  Rows with a null id, and texts that are null or without words, are in no group.
    """
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_row"))
    known = stage(rows.where("doc_id is not null").select("doc_id", "_row"), "pipeline-rows")
    groups = stage(jaccard.similar_groups(rows.where("doc_id is not null").select("_row", "text"), id_col="_row").select("_row", "component_id").distinct(), "pipeline-groups")
    many = stage(groups.groupBy("component_id").count().where("count > 1").select("component_id"), "pipeline-many")
    alike = stage(groups.join(sized(many), "component_id"), "pipeline-alike")
    ids = stage(known.join(sized(alike), "_row").distinct(), "pipeline-ids")
    first = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("first")).select("first._row")
    dropped = stage(alike.select("_row").join(first, "_row", "left_anti"), "pipeline-dropped")
    left = rows.join(sized(dropped), "_row", "left_anti")
    repeated = stage(known.groupBy("_row").count().where("count > 1").select("_row"), "pipeline-repeated")
    if not repeated.limit(1).count():
        return left.select(*COLUMNS)
    once = left.join(sized(repeated), "_row", "left_semi").groupBy("_row").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return left.join(sized(repeated), "_row", "left_anti").select(*COLUMNS).unionByName(once)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of 50-word runs that an earlier document has too.

    Null and empty texts stay as they are; rows of one id, repeated or not, are not each
    other's references; a text that is cut to nothing stays as an empty one.
    """
    return _measured(substring.remove_duplicates(docs.select(*COLUMNS)))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret masked; null texts stay null, and repeated rows are masked alike."""
    found = secrets.scan(docs.select(*COLUMNS))
    return _measured(found.withColumn("text", secrets.redact(F.col("text"), F.col("secrets"))))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: a row per piece, with its ids and place.

    A null or empty text is its end token alone; repeated rows are packed each.
    """
    return packing.pack(docs, TOKENIZER, RANKS)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Stages 1 to 5 hold iterative and learned steps that SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
