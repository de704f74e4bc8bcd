"""Best-fit packing of documents into sequences of fixed capacity.

What can be packed together depends on lengths alone, and there are at most
``capacity`` of them.  So the packing is made once for the histogram of lengths:
items above a third of the capacity are matched greedily, the longest with the
longest that still fits, at most two to a sequence; shorter items, the longest
first, go where they leave the least room, and what fits nowhere opens sequences
of its own.  The result is a plan of a few thousand ranges: items number r to s of
length n go to sequences from q on.  Every item then finds its place by its number
among the items of its length, so the packing is the same however many tasks make
it, and neither a task nor the driver holds more than the histogram.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import tokens
from lodestar.llm.scratch import sized, stage
from lodestar.llm.words import slices

PIECES = "doc_id long, piece int, start long, length int, ids binary"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Ranges ``(length, first, last, sequence, per_sequence, offset)`` for a histogram of lengths 1..capacity.

    Items first..last-1 of a length fill sequences from ``sequence`` on,
    ``per_sequence`` in each, the first of them at ``offset``.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    given = dict.fromkeys(left, 0)
    ranges: list[tuple[int, int, int, int, int, int]] = []
    open_: dict[int, list[list[int]]] = {}  # room -> [first sequence, sequences]
    rooms: list[int] = []
    opened = 0

    def put(length: int, items: int, sequence: int, each: int, room: int) -> None:
        ranges.append((length, given[length], given[length] + items, sequence, each, capacity - room))
        given[length] += items
        left[length] -= items

    def offer(sequence: int, sequences: int, room: int) -> None:
        if sequences and room:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append([sequence, sequences])

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        fit = bisect_left(large, capacity - a + 1) - 1
        while fit >= 0 and left[large[fit]] == 0:
            fit -= 1
        b = large[fit] if fit >= 0 else 0
        if b == a and left[a] < 2:
            b = next((n for n in reversed(large[: fit]) if left[n]), 0)
        pairs = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
        start = opened
        opened += pairs
        put(a, pairs, start, 1, capacity)
        if b:
            put(b, pairs, start, 1, capacity - a)
        offer(start, pairs, capacity - a - b)
        large = [n for n in large if left[n]]
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                sequences = -(-left[length] // each)
                offer(opened, sequences, capacity)
                opened += sequences
                continue
            room = rooms[at]
            group = open_[room][-1]
            each = room // length
            full = min(group[1], left[length] // each)
            sequence = group[0]
            if full:
                put(length, full * each, sequence, each, room)
                offer(sequence, full, room - each * length)
            else:  # the last items of this length share one sequence
                full, rest = 1, left[length]
                put(length, rest, sequence, rest, room)
                offer(sequence, 1, room - rest * length)
            group[0] += full
            group[1] -= full
            if not group[1]:
                open_[room].remove(group)
            if not open_[room]:
                del open_[room]
                rooms.remove(room)
    return ranges


def _cut(tokenizer: str, ranks: str, end: int, capacity: int):
    """Pieces of each document with their numbers among this task's pieces of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        bpe = tokens.load(tokenizer, ranks)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            columns: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(bpe.encode(text or ""), np.uint32(end)).astype("<u4")
                head = (len(ids) - 1) % capacity + 1
                for piece, stop in enumerate(range(head, len(ids) + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    for column, value in zip(columns, (doc, piece, start, stop - start, ids[start:stop].tobytes(), seen[stop - start])):
                        column.append(value)
                    seen[stop - start] += 1
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(arrays[0]), task, np.int32))], ["doc_id", "piece", "start", "length", "ids", "place", "task"])

    return run


def pack(df: DataFrame, tokenizer: str, ranks: str, id_col: str = "doc_id", text: str = "text", capacity: int = 1024, end: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, sequence_id, offset.

    A document is its ids and then ``end``; a null text is empty, so it is ``end``
    alone.  Documents longer than ``capacity`` are cut into pieces of that length, of
    which the first may be shorter.  ``ids`` are little-endian unsigned 32-bit.
    Repeated rows are packed each; null ids stay null; an empty table gives no rows.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = stage(docs.mapInArrow(_cut(tokenizer, ranks, end, capacity), f"{PIECES}, place long, task int"), "packing-pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(per_task.select("task", "length", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "packing-starts")
    counts = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    ranges = spark.createDataFrame(plan(counts, capacity), "length int, first long, last long, sequence long, each long, at long")
    numbered = pieces.join(sized(starts), ["task", "length"]).withColumn("item", F.col("before") + F.col("place"))
    placed = numbered.join(F.broadcast(ranges), "length").where("item >= first and item < last")
    k = F.col("item") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids",
        (F.col("sequence") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + (k % F.col("each")) * F.col("length")).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences: sequence_id, ids (concatenated by offset), starts of the pieces in them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "piece")))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", joined.alias("ids"), F.transform("parts", lambda p: p["offset"]).alias("starts"))
