"""Importance resampling towards a target distribution, with word tries.

Features are runs of 1 to n consecutive words.  Each task grows a trie of words: a node
is a run, its parent the run without the last word.  A node holds the CRC-32 of its run,
which continues its parent's, and how often the run was seen; at the end the counts
of all nodes go to the buckets of their CRC.  Bucket totals of all tasks are added by
Spark, for the raw and the target texts, and give each bucket a gain.  A second pass over
the raw texts walks such tries with the bucket's gain attached to each node.

A task folds its trie into bucket totals, or forgets it, once it has ``NODES`` nodes, so its
memory doesn't grow with the vocabulary.  All that reaches the driver are the bucket
totals, whose number is a parameter.

Drawing the highest scores ranks rows by a range partitioning: places inside a range
are counted where it is sorted, and the sizes of the ranges give the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.alnum import with_context
from lodestar.llm.scratch import stage
from lodestar.llm.words import slices

#: Nodes of a task's trie.
NODES = 400_000


class _Roots(dict):
    """word -> node of the run of this word alone; a word that is asked for gets a node."""

    def __init__(self, crc: list[int]):
        self.crc = crc

    def __missing__(self, word: bytes) -> int:
        self[word] = node = len(self.crc)
        self.crc.append(zlib.crc32(word))
        return node


class _Children(dict):
    """(node, word) -> node of the run with one word more, whose CRC goes on from its parent's."""

    def __init__(self, crc: list[int]):
        self.crc = crc

    def __missing__(self, key: tuple[int, bytes]) -> int:
        self[key] = node = len(self.crc)
        self.crc.append(zlib.crc32(b" " + key[1], self.crc[key[0]]))
        return node


class Trie:
    """Nodes are numbered as they come; ``crc`` has the CRC state of each."""

    def __init__(self, n: int):
        self.n = n
        self.clear()

    def clear(self) -> None:
        self.crc: list[int] = []
        self.roots, self.children = _Roots(self.crc), _Children(self.crc)

    def walk(self, words: list[bytes], old: int = 0) -> list[np.ndarray]:
        """Nodes of the runs of 1 to n words that end after the first ``old`` words, by length."""
        nodes, out = map(self.roots.__getitem__, words), []
        for length in range(1, self.n + 1):  # runs that start at word 0, 1, 2 ...
            if length > 1:
                nodes = map(self.children.__getitem__, zip(nodes, words[length - 1 :]))
            if length < self.n:
                nodes = list(nodes)
            out.append(np.fromiter(nodes, np.int64, max(0, len(words) - length + 1))[max(0, old - length + 1) :])
        return out


class _Values:
    """An array with a number for each node of a trie; new nodes get theirs when it is asked for."""

    def __init__(self, trie: Trie, of_crc):
        self.trie, self.of_crc = trie, of_crc
        self.known, self.values = 0, np.zeros(1024, np.int64)

    def array(self) -> np.ndarray:
        crc = self.trie.crc
        if len(crc) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros(max(len(crc), len(self.values)), np.int64)])
        self.values[self.known : len(crc)] = self.of_crc(np.array(crc[self.known :], np.int64))
        self.known = len(crc)
        return self.values

    def clear(self) -> None:
        self.trie.clear()
        self.known = 0


def _count(n: int, buckets: int):
    """texts -> (bucket, times): how often a task's texts hold runs of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, totals = Trie(n), np.zeros(buckets, np.int64)
        counts = _Values(trie, np.zeros_like)

        def fold() -> None:
            np.add.at(totals, np.array(trie.crc, np.int64) % buckets, counts.array()[: len(trie.crc)])
            counts.clear()

        for batch in slices(batches):
            for raw in batch.column(0).to_pylist():
                for words, old in with_context(raw or b"", n - 1):
                    for nodes in trie.walk(words, old):
                        np.add.at(counts.array(), nodes, 1)
                    if len(trie.crc) >= NODES:
                        fold()
        fold()
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], ["bucket", "times"])

    return run


def bucket_totals(texts: DataFrame, text: str = "text", n: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How often the texts hold runs of 1 to n words of each bucket; null texts hold none."""
    raw = texts.select(F.col(text).cast("binary").alias("raw"))
    rows = raw.mapInArrow(_count(n, buckets), "bucket long, times long").groupBy("bucket").agg(F.sum("times").alias("times")).collect()  # at most ``buckets``
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["times"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(how much likelier a bucket is in the target)), each bucket seen once more than it was."""
    s, t, n = raw.astype(np.float64), target.astype(np.float64), len(raw)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weigh(n: int, gain: np.ndarray):
    """(id, text) -> (id, n_words, n_features, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(n)
        attached = _Values(trie, lambda crc: gain[crc % len(gain)])
        for batch in slices(batches):
            found = np.zeros((batch.num_rows, 3), np.int64)
            for i, raw in enumerate(batch.column(1).to_pylist()):
                for words, old in with_context(raw or b"", n - 1):
                    found[i, 0] += len(words) - old
                    for nodes in trie.walk(words, old):
                        found[i, 1] += len(nodes)
                        found[i, 2] += attached.array()[nodes].sum()
                    if len(trie.crc) >= NODES:
                        attached.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], ["id", "n_words", "n_features", "weight"])

    return run


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text: str = "text", n: int = 1) -> DataFrame:
    """``(id_col, n_words, n_features, weight)`` per row; the weight is the sum of gains over a text's features."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("raw")).mapInArrow(_weigh(n, gain), schema)
    return rows.select(F.col("id").alias(id_col), "n_words", "n_features", "weight")


def noise(id_col: str, seed: int):
    """Gumbel noise in thousandths, rounded down, from the id alone; null for a null id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, among, draw: tuple[int, int], id_col: str = "doc_id") -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... for the highest scores of the rows where ``among`` holds, else null.

    ``draw`` is the share (num, den) of those rows that is drawn, rounded down.  Ties go to smaller ids.
    Rows of a range of scores are sorted in one task, and ranges are cut by ids too, so
    that many equal scores don't meet in one; only the sizes of ranges reach the driver.
    """
    columns = scored.columns
    order = [F.desc("_among"), F.desc("score"), F.asc(id_col), *(F.asc(c) for c in columns if c not in ("score", id_col))]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scored.withColumn("_among", F.coalesce(among & F.col("score").isNotNull(), F.lit(False))).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The id that Spark gives: number of the partition, then 33 bits of place in it.
    placed = stage(dealt.withColumn("_at", F.monotonically_increasing_id()), "importance-ranges")
    part = F.shiftright("_at", 33).cast("int")
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count_if("_among").alias("n")).collect())  # as many as partitions
    total, before = 0, []
    for p, size in sizes:
        before.append((p, total))
        total += size
    drawn = draw[0] * total // draw[1]
    starts = F.broadcast(placed.sparkSession.createDataFrame(before, "part int, before long"))
    rank = F.col("before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(starts, part == F.col("part")).select(*columns, F.when(F.col("_among") & (rank <= drawn), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1, buckets: int = 10_000, draw: tuple[int, int] = (10, 100), min_words: int = 20, seed: int = 2024) -> DataFrame:
    """``(id_col, n_words, n_features, weight, score, rank)`` per row of ``docs``.

    ``score`` is the weight and Gumbel noise, so the drawn rows are a sample without
    replacement in proportion to how much likelier each text is in the target.  Rows with
    fewer than ``min_words`` words aren't drawn, nor are rows with a null id, whose score is null.  Null and empty texts
    have no features and weight 0; repeated rows are scored alike and ranked one after the
    other; an empty table gives an empty table, and with an empty target every bucket counts as seen once there.
    Other columns are ignored; ``drawn`` takes the rows of a table that were drawn.
    """
    gain = gains(bucket_totals(docs, text, n, buckets), bucket_totals(target, target_text, n, buckets))
    weighed = weigh(docs, gain, id_col, text, n)
    scored = stage(weighed.withColumn("score", F.col("weight") + noise(id_col, seed)), "importance-scored")
    return ranked(scored, F.col("n_words") >= min_words, draw, id_col)


def drawn(docs: DataFrame, result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id was drawn, with all their columns."""
    return docs.join(result.where("rank is not null").select(id_col).distinct(), id_col, "left_semi")
