"""Trained codecs as tables of codes, and search on the codes.

A code is a struct of small integers (``codes``) and a few numbers (``more``), the last of which is
the squared norm of the vector that the code stands for.  A codec knows the inner products of
codes with queries: for product and residual codes they are sums over lookup tables that a task makes
once for its queries, for mixed codes a product with levels, for an autoencoder a product with its decoder's output.
Squared distances and cosines follow from these and the stored norms, so no vector is decoded to a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators import scan, training
from lodestar.operators.codecs import NF4_LEVELS, nf4_thresholds
from lodestar.operators.search import pq_assign, top_k

CODE = T.StructType([T.StructField("codes", T.ArrayType(T.ShortType())), T.StructField("more", T.ArrayType(T.DoubleType()))])


@dataclass(frozen=True)
class TrainedCodec:
    """Functions over blocks of rows.

    ``encode(x)``: codes and numbers before the norm, for vectors of ``dims`` numbers.  ``decode(codes, numbers)``: the vectors.
    ``tables(q)``: what a task needs of its queries; ``dots(codes, numbers, tables)``: (rows, queries) inner products.
    ``bits``: bits of a code for one vector, its norm included.
    """

    name: str
    dims: int
    width: int
    bits: float
    encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
    decode: Callable[[np.ndarray, np.ndarray], np.ndarray]
    tables: Callable[[np.ndarray], object]
    dots: Callable[[np.ndarray, np.ndarray, object], np.ndarray]

    def ratio(self) -> float:
        """Compression against 4 bytes a number, without the model."""
        return 32 * self.dims / self.bits


def _none(x: np.ndarray) -> np.ndarray:
    return np.zeros((len(x), 0))


def _looked_up(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Sum over code places of the table rows that they name; tables are (places, K, queries)."""
    out = np.zeros((len(codes), tables.shape[2]))
    for i in range(codes.shape[1]):
        out += tables[i, codes[:, i]]
    return out


def _bits(k: int) -> int:
    return max(1, int(np.ceil(np.log2(k))))


def residual(model: training.ResidualCodebook) -> TrainedCodec:
    """Codes of all passes, pass by pass; the inner product is a sum over passes and parts."""
    books = [b.astype(np.float64) for b in model.books]
    parts, k, width = books[0].shape

    def tables(q: np.ndarray) -> np.ndarray:
        padded = model.pad(q).reshape(len(q), parts, width)
        return np.concatenate([np.einsum("mkw,qmw->mkq", b, padded) for b in books])

    return TrainedCodec(
        "rq", model.dims, len(books) * parts, len(books) * parts * _bits(k) + 32,
        lambda x: (model.encode(x).reshape(len(x), -1), _none(x)), lambda c, _: model.decode(c.reshape(len(c), len(books), parts)), tables, lambda c, _, t: _looked_up(c, t),
    )


def rotated(rotation: np.ndarray | None, book: np.ndarray) -> TrainedCodec:
    """Product codes of turned vectors; a turned query has the same inner products."""
    parts, k, width = book.shape
    wide = book.astype(np.float64)
    turn = np.eye(parts * width) if rotation is None else rotation

    def tables(q: np.ndarray) -> np.ndarray:
        return np.einsum("mkw,qmw->mkq", wide, (q @ turn).reshape(len(q), parts, width))

    return TrainedCodec(
        "pq" if rotation is None else "opq", parts * width, parts, parts * _bits(k) + 32,
        lambda x: (pq_assign(x @ turn, book), _none(x)), lambda c, _: training.pq_restore(c, wide) @ turn.T, tables, lambda c, _, t: _looked_up(c, t),
    )


def mixed(dims: int, outliers: list[int]) -> TrainedCodec:
    """4-bit codes of most dimensions; the scale, then the outlier dimensions in half precision, are the numbers."""
    rest, top = np.array([i for i in range(dims) if i not in set(outliers)], np.int64), np.array(outliers, np.int64)
    levels = np.array(NF4_LEVELS, np.float32).astype(np.float64)

    def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = np.ascontiguousarray(x[:, rest], np.float32)
        scale = np.abs(y).max(axis=1, initial=0)
        codes = np.searchsorted(np.array(nf4_thresholds(), np.float32), y / np.where(scale == 0, np.float32(1), scale)[:, None])
        return codes, np.hstack([scale[:, None], x[:, top].astype(np.float32).astype(np.float16)]).astype(np.float64)

    def decode(codes: np.ndarray, more: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), dims))
        out[:, rest] = (levels[codes] * more[:, :1]).astype(np.float32)
        out[:, top] = more[:, 1:]
        return out

    return TrainedCodec(
        "nf4-mixed", dims, len(rest), 4 * len(rest) + 16 * len(top) + 64, encode, decode,
        lambda q: (q[:, rest], q[:, top]), lambda c, m, t: (levels[c] @ t[0].T) * m[:, :1] + m[:, 1:] @ t[1].T,
    )


def autoencoder(model: training.Autoencoder) -> TrainedCodec:
    """8-bit codes; the decoder's last layer is moved to the queries, and its output is of length 1 but for zero codes."""
    a, _, c, d = model.weights
    hidden = lambda codes: np.maximum(codes.astype(np.float64) * model.scale / 127 @ c, 0)

    def dots(codes: np.ndarray, _: np.ndarray, table: np.ndarray) -> np.ndarray:
        h = hidden(codes)
        n = np.linalg.norm(h @ d, axis=1, keepdims=True)
        return np.divide(h @ table, n, out=np.zeros((len(h), table.shape[1])), where=n > 0)

    return TrainedCodec("autoencoder", a.shape[0], model.weights[1].shape[1], 8 * model.weights[1].shape[1] + 32, lambda x: (model.encode(x), _none(x)), lambda codes, _: model.decode(codes), lambda q: d @ q.T, dots)


# Tables --------------------------------------------------------------------------------


def _parts(batch: pa.StructArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, codes, numbers) of codes of ``width`` places; others, and nulls, are left out."""
    codes = pc.if_else(batch.is_valid(), batch.field(0), None)
    sizes = pc.fill_null(pc.list_value_length(codes), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == width)
    take = pa.array(at)
    more = batch.field(1).take(take)
    return at, codes.take(take).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(at), width), more.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel(), kind))


def _spread(values: pa.Array, at: np.ndarray, rows: int) -> pa.Array:
    """Values at their positions among ``rows``, null elsewhere."""
    place = np.full(rows, -1)
    place[at] = np.arange(len(at))
    return values.take(pa.array(place, mask=place < 0))


def encode(df: DataFrame, codec: TrainedCodec, vec: str = "vec", out: str = "code") -> DataFrame:
    """``df`` with ``out``; rows without a finite vector of the codec's length have a null code."""
    rows = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.nulls(batch.num_rows, pa.struct([("codes", pa.list_(pa.int16())), ("more", pa.list_(pa.float64()))]))
            for n, at, x in scan.by_length(batch.column(vec)):
                if n == codec.dims and len(x):
                    codes, more = codec.encode(x)
                    norm = (codec.decode(codes.astype(np.int64), more) ** 2).sum(axis=1, keepdims=True)
                    pair = pa.StructArray.from_arrays([_lists(codes.astype(np.int16), pa.int16()), _lists(np.hstack([more, norm]), pa.float64())], ["codes", "more"])
                    made = _spread(pair, at, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, CODE)]))


def decode(df: DataFrame, codec: TrainedCodec, code: str = "code", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: vectors in single precision, null for a null code or one of another codec's width."""
    rows = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, codes, more = _parts(batch.column(code), codec.width)
            made = pa.nulls(batch.num_rows, pa.list_(pa.float32()))
            if len(at):
                made = _spread(_lists(codec.decode(codes, more[:, :-1]).astype(np.float32), pa.float32()), at, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def scorer(codec: TrainedCodec, metric: str) -> scan.Scorer:
    """(rows, queries) scores of rows of codes and numbers strung together; tables are made once for a set of queries."""
    if metric not in ("dot", "cosine", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    made: list[tuple[np.ndarray, object]] = []

    def score(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        if not made or made[0][0] is not q:
            made[:] = [(q, codec.tables(q))]
        codes, more, norm = x[:, : codec.width].astype(np.int64), x[:, codec.width : -1], x[:, -1:]
        dots = codec.dots(codes, more, made[0][1])
        if metric == "dot":
            return dots
        own = (q * q).sum(1)[None]
        if metric == "l2":
            return -np.sqrt(np.maximum(norm - 2 * dots + own, 0))
        length = np.sqrt(norm * own)
        return np.divide(dots, length, out=np.zeros_like(dots), where=length > 0)

    return score


def topk(queries: DataFrame, coded: DataFrame, codec: TrainedCodec, k: int, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """``(query_id, id, score, rank)`` by the codes (id, code); scores of l2 are negated distances.  Null codes are never found."""
    rows = coded if where is None else coded.where(where)
    strung = F.concat(F.transform("code.codes", lambda c: c.cast("double")), F.col("code.more"))
    kinds = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(coded.dtypes)['id']}, score double"
    mine = queries.where(F.size("query") == codec.dims)
    found = scan.pairs(mine, rows.where(F.size("code.codes") == codec.width).select("id", strung.alias("vec")), scan.best(k), kinds, scorer(codec, metric), meets=codec.dims)
    return top_k(found, k)
