"""Token sequences in training order, in fixed-stride shards.

Documents become sequences of ``length`` ids.  A keyed Feistel network over the
smallest even number of bits that holds all sequence numbers, walked along its
cycles until it is back below their count, is a permutation of exactly those
numbers: it gives each sequence its global slot without a sort on random numbers and
without a table, and its inverse says which sequence a slot holds.  Shards are ranges
of slots; every slot takes the same number of bytes, so slot s of a shard starts at
``(s - first) * stride`` and a reader can resume anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import tokens
from lodestar.llm.scratch import sized, stage
from lodestar.llm.words import mix, slices

ROUNDS = 6


class Permutation:
    """Keyed permutation of 0..count-1 that needs no memory."""

    def __init__(self, count: int, key: str):
        self.count = count
        self.half = 1
        while (1 << 2 * self.half) < count:
            self.half += 1
        self.keys = [np.uint64(xxhash.xxh3_64_intdigest(f"{key}/{i}")) for i in range(ROUNDS)]

    def _walk(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        out = x.astype(np.uint64)
        at = np.arange(len(out))
        while len(at):
            a, b = out[at] >> half, out[at] & mask
            for k in reversed(self.keys) if inverse else self.keys:
                a, b = (b ^ (mix(a + k) & mask), a) if inverse else (b, a ^ (mix(b + k) & mask))
            out[at] = a << half | b
            at = at[out[at] >= self.count]
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def _sequences(tokenizer: str, ranks: str, end: int, length: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, bpe, place, rest = TaskContext.get().partitionId(), tokens.load(tokenizer, ranks), 0, np.zeros(0, dtype)

        def rows(ids: np.ndarray, held: list[int]) -> pa.RecordBatch:
            nonlocal place
            n = len(held)
            out = pa.RecordBatch.from_arrays([pa.array(np.full(n, task, np.int32)), pa.array(np.arange(place, place + n)), pa.array(held, pa.int32()), pa.array([x.tobytes() for x in ids.reshape(n, length)], pa.binary())], ["task", "place", "tokens", "payload"])
            place += n
            return out

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                rest = np.concatenate([rest, bpe.encode(text or "").astype(dtype), np.array([end], dtype)])
                if len(rest) >= 64 * length:
                    whole = len(rest) // length
                    yield rows(rest[: whole * length], [length] * whole)
                    rest = rest[whole * length :]
        if len(rest):
            held = [length] * (len(rest) // length) + ([len(rest) % length] if len(rest) % length else [])
            yield rows(np.concatenate([rest, np.full(len(held) * length - len(rest), end, dtype)]), held)

    return run


def in_training_order(df: DataFrame, tokenizer: str, ranks: str, key: str, text: str = "text", length: int = 1024, end: int = 2, wide: bool = False) -> DataFrame:
    """``(slot, tokens, payload)``: every sequence with its global slot.

    Each task strings its documents together (a null text is empty), ``end`` after
    each, and cuts the ids into sequences; its last one is filled up with ``end``, and
    ``tokens`` says how many ids are real.  Ids are little-endian, 16 bits or, if
    ``wide``, 32.  An empty table has no sequences.
    """
    made = stage(df.select(F.col(text).alias("text")).mapInArrow(_sequences(tokenizer, ranks, end, length, "<u4" if wide else "<u2"), "task int, place long, tokens int, payload binary"), "order-sequences")
    sizes = made.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    # A row per task of the scan, not of the data.
    before = stage(sizes.select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")), "order-starts")
    permutation = Permutation(made.count(), key)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(permutation.slot(batch.column(0).to_numpy())), batch.column(1), batch.column(2)], ["slot", "tokens", "payload"])

    return made.join(sized(before), "task").select((F.col("before") + F.col("place")).alias("number"), "tokens", "payload").mapInArrow(number, "slot long, tokens int, payload binary")


#: Sequences that the compression dictionary is trained on at most; it changes the size of the shuffle only.
SAMPLE = 1_500


def _dictionary(ordered: DataFrame):
    """Dictionary of common byte runs, or None if there are too few sequences for one."""
    import zstandard

    sample = [bytes(r["payload"]) for r in ordered.select("payload").limit(SAMPLE).collect()]
    if len(sample) < 64:
        return None
    return zstandard.train_dictionary(min(112_640, sum(map(len, sample)) // 20), sample).as_bytes()


def _packed(dictionary: bytes | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([squeeze.compress(x.as_buffer()) for x in batch.column(2)], pa.binary())], ["shard", "slot", "payload"])

    return run


def write_shards(ordered: DataFrame, path: str, per_shard: int) -> DataFrame:
    """Write ``path/shard-NNNNNNNN.bin`` files of ``per_shard`` slots; returns the manifest (shard, first, slots, stride, file).

    A shard is one range of slots and is written by one task, front to back, under a
    name of its own attempt and then renamed: a task that is run again puts the same
    bytes in the same place.  Sequences are compressed on their way to that task.
    Slots must be distinct, 0, 1, 2, ... as ``in_training_order`` gives them; no sequences
    make no files and an empty manifest.
    """
    dictionary = _dictionary(ordered)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import zstandard
        from pyspark import TaskContext

        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        store, top = fs.FileSystem.from_uri(path)
        store.create_dir(top, recursive=True)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        now, out, rows = None, None, []

        def close() -> None:
            out.close()
            store.move(f"{top}/_{now}-{attempt}", f"{top}/shard-{now:08d}.bin")

        for batch in batches:
            for shard, slot, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                payload = expand.decompress(payload.as_buffer())
                if shard != now:
                    if out is not None:
                        close()
                    now, out = shard, store.open_output_stream(f"{top}/_{shard}-{attempt}")
                    rows.append([shard, slot, 0, len(payload), f"{top}/shard-{shard:08d}.bin"])
                out.write(payload)
                rows[-1][2] += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _MANIFEST)] if rows else [pa.array([], t) for t in _MANIFEST], ["shard", "first", "slots", "stride", "file"])

    keyed = ordered.select(F.floor(F.col("slot") / per_shard).cast("long").alias("shard"), "slot", "payload").mapInArrow(_packed(dictionary), "shard long, slot long, payload binary")
    parts = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Whole ranges go to partitions by their numbers; dealing by sampled ranges would make every sequence twice.
    return keyed.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", "slot").mapInArrow(write, "shard long, first long, slots long, stride int, file string")


_MANIFEST = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())


def read_shards(manifest: DataFrame, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """``(shard, slot, at, payload)`` of the slots in [start, stop), read in order from their byte positions.

    Slots beyond those written, and an empty manifest, give no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for r in batch.to_pylist():
                first, last = max(r["first"], start), min(r["first"] + r["slots"], stop if stop is not None else 1 << 62)
                with store.open_input_file(r["file"]) as f:
                    for at in range(first, last, 256):
                        n = min(256, last - at)
                        raw = f.read_at(n * r["stride"], (at - r["first"]) * r["stride"])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, r["shard"])), pa.array(np.arange(at, at + n)), pa.array((np.arange(at, at + n) - r["first"]) * r["stride"]), pa.array([raw[i * r["stride"] : (i + 1) * r["stride"]] for i in range(n)], pa.binary())],
                            ["shard", "slot", "at", "payload"],
                        )

    return manifest.mapInArrow(read, "shard long, slot long, at long, payload binary")


def shard_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    import uuid

    from lodestar.llm.scratch import root

    return f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
