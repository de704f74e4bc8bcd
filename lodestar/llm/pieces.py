"""SentencePiece encoding and decoding of texts of any length.

A giant text is split into chunks that are encoded by different tasks.  What a chunk
does to the rest of the text is a transfer matrix over boundary states, the ways in which a
piece may lie across the chunk's beginning and its end: entry (i, j) is the best score of
covering the chunk from state i to state j.  Matrices are combined by max-plus products,
which are associative; the best states at all boundaries follow, and each chunk is traced
back on its own between its two states.

For a unigram model, scores are those of the pieces.  For a BPE model, whose segmentation
is what merging by rank leaves, a step between two pieces scores 0 if merging leaves
them side by side and minus infinity if not (``bpe.py``); one path is left, and it is the
library's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import bpe
from lodestar.llm.scratch import stage
from lodestar.llm.words import slices

#: Characters of a chunk of a giant text, which is one of more than two chunks.
CHUNK = 16_384

_loaded: dict[str, "object"] = {}


def load(model: str):
    """One processor per worker process."""
    import sentencepiece

    if model not in _loaded:
        _loaded[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return _loaded[model]


_scans: dict[str, bpe.Bpe] = {}


def scan(model: str) -> bpe.Bpe:
    """One scanner per worker process."""
    if model not in _scans:
        _scans[model] = bpe.Bpe(load(model))
    return _scans[model]


def _encode(model: str, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load(model)
        for batch in slices(batches):
            ids = [np.array(sp.encode(x), "<u4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [id_col, "ids"])

    return run


_PARTS = "key long, part int, text string, begin int, size int"


def _cut(model: str, chunk: int):
    """Chunks of the normalised text, with as much around them as the longest piece may take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = scan(model).longest
        size = max(chunk, 2 * most)
        for batch in slices(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = load(model).normalize(text)
                starts = np.arange(0, max(1, len(text) - 2 * most), size)  # the last chunk isn't shorter than two pieces
                stops = np.append(starts[1:], len(text))
                parts = [text[max(0, a - most) : b + most] for a, b in zip(starts.tolist(), stops.tolist())]
                columns = np.full(len(parts), key), np.arange(len(parts)), parts, np.minimum(starts, most), stops - starts
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()))], ["key", "part", "text", "begin", "size"])

    return run


def _chunks(model: str, batch: pa.RecordBatch) -> Iterator[bpe.Chunk]:
    return (bpe.Chunk(scan(model), t, b, n) for t, b, n in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))))


def _transfer(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [c.transfer() for c in _chunks(model, batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m.shape[1] for m in found], pa.int32()), pa.array([(m == 0).tobytes() for m in found], pa.binary())], ["key", "part", "ends", "paths"])

    return run


def _choose(group: pd.DataFrame) -> pd.DataFrame:
    """States at both ends of each chunk of one text."""
    group = group.sort_values("part")
    matrices = [np.where(np.frombuffer(m, bool), 0.0, -np.inf).reshape(-1, n) for m, n in zip(group["paths"], group["ends"])]
    states = boundary_states(matrices, np.zeros(matrices[-1].shape[1]))
    return pd.DataFrame({"key": group["key"], "part": group["part"], "first": states[:-1], "last": states[1:]})


def _trace(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = [np.array(c.trace(i, j), "<u4").tobytes() for c, i, j in zip(_chunks(model, batch), batch.column(5).to_pylist(), batch.column(6).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["key", "part", "ids"])

    return run


def scan_encode(texts: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """``(key, ids)`` of giant texts ``(key, text)`` with distinct keys by the max-plus scan over a BPE model."""
    parts = stage(texts.mapInArrow(_cut(model, chunk), _PARTS), "pieces-parts").repartition("key", "part")
    states = parts.mapInArrow(_transfer(model), "key long, part int, ends int, paths binary").groupBy("key").applyInPandas(_choose, "key long, part int, first int, last int")
    coded = parts.join(states, ["key", "part"]).select("key", "part", "text", "begin", "size", "first", "last").mapInArrow(_trace(model), "key long, part int, ids binary")
    whole = coded.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("parts"))
    return whole.select("key", F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``(id_col, ids)`` per row: little-endian unsigned 32-bit ids of a BPE model, as the library gives for the whole text.

    Texts of more than two chunks go through the scan; a shorter one is a single chunk, for
    which the library is called.  Null and empty texts have no ids.  Repeated rows are
    encoded each; ids may be null.
    """
    key = F.xxhash64(F.col(id_col), F.col(text))
    docs = df.select(F.col(id_col), key.alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    giant = F.length("text") > 2 * chunk
    kind = dict(df.dtypes)[id_col]
    near = docs.where(~giant).select(id_col, "text").mapInArrow(_encode(model, id_col), f"`{id_col}` {kind}, ids binary")
    long_ = docs.where(giant)
    whole = scan_encode(long_.select("key", "text").dropDuplicates(["key"]), model, chunk)
    return near.unionByName(long_.select(F.col(id_col), "key").join(whole, "key").select(id_col, "ids"))


def decode(coded: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``coded`` with the text of ``ids`` as ``out``; null ids give null."""
    from pyspark.sql import types as T

    rest = [c for c in coded.columns if c != out]
    schema = T.StructType([*[coded.schema[c] for c in rest], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load(model)
        at = rest.index(ids)
        for batch in slices(batches):
            texts = [None if x is None else sp.decode(np.frombuffer(x, "<u4").tolist()) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*rest, out])

    return coded.select(*rest).mapInArrow(run, schema)


class Unigram:
    """Piece scores of a unigram model; a character that no piece covers costs ``unknown``."""

    def __init__(self, scores: dict[str, float], unknown: float):
        self.scores, self.unknown = scores, unknown
        self.longest = max(map(len, scores), default=1)

    def pieces(self, text: str, at: int) -> Iterator[tuple[int, float]]:
        """(length, score) of the pieces that may start at a position."""
        known = False
        for n in range(1, min(self.longest, len(text) - at) + 1):
            s = self.scores.get(text[at : at + n])
            if s is not None:
                known |= n == 1
                yield n, s
        if not known:
            yield 1, self.unknown

    def transfer(self, text: str, size: int) -> np.ndarray:
        """Matrix of a chunk: its ``size`` characters, and up to ``longest - 1`` more after it."""
        width = self.longest
        matrix = np.full((width, width), -np.inf)
        for i in range(width):
            best = np.full(size + width, -np.inf)
            if i >= size:
                matrix[i, i - size] = 0.0  # the piece before reaches across the whole chunk
                continue
            best[i] = 0.0
            for at in range(i, size):
                if best[at] > -np.inf:
                    for n, s in self.pieces(text, at):
                        best[at + n] = max(best[at + n], best[at] + s)
            matrix[i] = best[size : size + width]
        return matrix

    def trace(self, text: str, size: int, first: int, last: int) -> list[str]:
        """Best pieces of a chunk from state ``first`` to state ``last``."""
        if first >= size:
            return []
        best, back = np.full(size + self.longest, -np.inf), np.zeros(size + self.longest, np.int64)
        best[first] = 0.0
        for at in range(first, size):
            if best[at] > -np.inf:
                for n, s in self.pieces(text, at):
                    if best[at] + s > best[at + n]:
                        best[at + n], back[at + n] = best[at] + s, n
        out, at = [], size + last
        while at > first:
            out.append(text[at - back[at] : at])
            at -= back[at]
        return out[::-1]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def boundary_states(matrices: list[np.ndarray], goal: np.ndarray | None = None) -> list[int]:
    """States at the boundaries 0..n of the best path from the first state to the last boundary's, which ``goal`` scores (the first one if not given)."""
    after = [None] * (len(matrices) + 1)
    if goal is None:
        goal = np.full(matrices[-1].shape[1], -np.inf)
        goal[0] = 0.0
    after[-1] = goal
    for i in range(len(matrices) - 1, -1, -1):
        after[i] = (matrices[i] + after[i + 1][None, :]).max(axis=1)
    states = [0]
    for i, m in enumerate(matrices):
        states.append(int((m[states[-1]] + after[i + 1]).argmax()))
    return states


def encode_unigram(df: DataFrame, model: Unigram, id_col: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``(id_col, pieces)`` per distinct row: the best-scoring segmentation of the whole text by the max-plus scan.

    A null or empty text has no pieces; a null id is an id like any other.
    """
    width = model.longest
    chunk = max(chunk, width)
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    many = F.greatest(F.lit(1), F.ceil(F.length("text") / chunk)).cast("int")
    at = docs.select("id", F.xxhash64("text").alias("key"), "text", F.explode(F.sequence(F.lit(0), many - 1)).alias("part"))
    parts = at.select("id", "key", "part", F.substring("text", F.col("part") * chunk + 1, F.lit(chunk + width - 1)).alias("text"), F.least(F.lit(chunk), F.length("text") - F.col("part") * chunk).alias("size")).repartition("id", "key", "part")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(matrix=[model.transfer(t, n).ravel() for t, n in zip(b["text"], b["size"])])[["id", "key", "part", "matrix"]]

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        states = boundary_states([np.array(m).reshape(width, width) for m in group["matrix"]])
        return pd.DataFrame({"id": group["id"], "key": group["key"], "part": group["part"], "first": states[:-1], "last": states[1:]})

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(pieces=[model.trace(t, n, i, j) for t, n, i, j in zip(b["text"], b["size"], b["first"], b["last"])])[["id", "key", "part", "pieces"]]

    kind = dict(docs.dtypes)["id"]
    states = parts.mapInPandas(matrices, f"id {kind}, key long, part int, matrix array<double>").groupBy("id", "key").applyInPandas(choose, f"id {kind}, key long, part int, first int, last int")
    same = parts["id"].eqNullSafe(states["id"]) & (parts["key"] == states["key"]) & (parts["part"] == states["part"])
    done = parts.join(states, same).select(parts["id"], parts["key"], parts["part"], "text", "size", "first", "last").mapInPandas(traced, f"id {kind}, key long, part int, pieces array<string>")
    whole = done.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("part", "pieces"))).alias("parts"))
    return whole.select(F.col("id").alias(id_col), F.flatten(F.transform("parts", lambda p: p["pieces"])).alias("pieces"))
