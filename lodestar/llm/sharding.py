"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair gets a hash in (0, 1); the shard with the smallest
``-ln(hash) / weight`` wins.  A shard's scores don't depend on the other shards,
so a new shard takes only the rows it wins and no row moves between old ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.ranks import gapless
from lodestar.llm.scratch import stage

_STEPS = float(1 << 53)


def score(key: Column, shard: int, weight: float) -> Column:
    """Exponential race time of one shard: a 53-bit uniform hash, made to follow the weight."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(_STEPS)
    return -F.log(uniform) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard of ``key``; ties go to the lower number."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a weight above 0")
    return F.array_min(F.array(*[F.struct(score(key, i, w).alias("t"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]))


def assign(df: DataFrame, key: str, weights: Sequence[float], grow_by: float | None = None) -> DataFrame:
    """Add ``shard`` and, with the weight of one more shard, ``grown_shard``.

    Works on any columns: names already taken are replaced.  A null key is a key
    like any other, so all rows with null keys share a shard.  Rows with equal keys
    always share a shard, and an empty table stays empty.
    """
    won = df.withColumn("_won", rendezvous(F.col(key), weights))
    out = won.withColumn("shard", F.col("_won.shard"))
    if grow_by is not None:
        n = len(weights)
        out = out.withColumn("grown_shard", F.when(score(F.col(key), n, grow_by) < F.col("_won.t"), n).otherwise(F.col("_won.shard")))
    return out.drop("_won")


def shard_documents(df: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sharding plan of a document table: key, size, checksum, shard, slot, grown shard.

    Size is the UTF-8 length of the text (null: 0) plus 16.  Slots number a shard's
    rows without gaps; a shard is split into hash cells to number them, so no task
    holds a whole shard.  Repeated rows each get a slot of their own.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = assign(
        df.select(F.col(key), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32")),
        key, [1.0] * shards, grow_by=1.0,
    )
    rows = stage(rows, "shards")
    return gapless(rows, "shard", F.xxhash64(key, "text_crc32"), [F.col(key), F.col("text_crc32")], "slot", rows.count())
