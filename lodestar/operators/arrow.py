"""Array codecs over Arrow batches: the results of the expressions in ``codecs``, several times faster on long vectors.

Lambdas over arrays are interpreted number by number; here the vectors of one length in a
batch are one matrix.  Null vectors, vectors of other lengths and null numbers give what
the expressions give: null codes, codes of their own, a null code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestar.operators.codecs import NF4_LEVELS, nf4_thresholds

_ONE = np.float32(1)


def _or_one(m: np.ndarray, value: np.ndarray) -> np.ndarray:
    return np.where(m == 0, _ONE, value).astype(np.float32)


def _top_for_nan(x: np.ndarray, top: float) -> np.ndarray:
    """What isn't a number counts as larger than any, as in Spark."""
    return np.where(np.isnan(x), np.float32(top), x)


def _peak(x: np.ndarray) -> np.ndarray:
    return np.abs(x).max(axis=1, initial=0)


def int8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = _peak(x)
    scale = _or_one(m, (m.astype(np.float64) / 127).astype(np.float32))
    return _top_for_nan(np.clip(np.rint(x / scale[:, None]), -127, 127), 127).astype(np.int8), scale


def nf4(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = _peak(x)
    return np.searchsorted(np.array(nf4_thresholds(), np.float32), x / _or_one(m, m)[:, None]).astype(np.int8), m


def sq(bits: int) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    half = 1 << (bits - 1)

    def run(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scale = _or_one(_peak(x), _peak(x))
        part = _top_for_nan(np.clip(x * (1 / scale.astype(np.float64)).astype(np.float32)[:, None], -1, 1), 1).astype(np.float64)
        return np.clip(np.floor((part + 1) * half), 0, 2 * half - 1).astype(np.int8), scale

    return run


def int8_decode(codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return codes.astype(np.float32) * scale[:, None]


def nf4_decode(codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.array(NF4_LEVELS, np.float32)[codes] * scale[:, None]


def sq_decode(bits: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    top = 1 << bits
    return lambda codes, scale: ((2 * codes.astype(np.float32) - (top - 1)) / np.float32(top)) * scale[:, None]


ENCODERS = {"int8": int8, "nf4": nf4, "sq2": sq(2), "sq3": sq(3)}
DECODERS = {"int8": int8_decode, "nf4": nf4_decode, "sq2": sq_decode(2), "sq3": sq_decode(3)}
CODE = T.StructType([T.StructField("codes", T.ArrayType(T.ByteType())), T.StructField("scale", T.FloatType())])


def _lists(x: np.ndarray, holes: np.ndarray | None = None) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x).ravel(), mask=None if holes is None else holes.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)


def _matrices(column: pa.Array, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(positions, matrix, mask of null numbers, which are 0 in the matrix) of the vectors of each length; null vectors are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == n)
        flat = column.take(pa.array(at)).flatten()
        holes = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, n) if flat.null_count else None
        yield at, pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(at), n), holes


def _in_order(parts: list[pa.Array], places: list[np.ndarray], rows: int) -> pa.Array:
    """Results of all lengths in the order of the rows; null where there is none."""
    place = np.full(rows, -1)
    place[np.concatenate(places)] = np.arange(sum(map(len, places)))
    return pa.concat_arrays(parts).take(pa.array(place, mask=place < 0))


def encode(df: DataFrame, codec: str, vec: str = "vec", out: str = "code") -> DataFrame:
    """``df`` with ``out`` as ``codecs.encode`` gives it."""
    f, rows = ENCODERS[codec], df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            none = f(np.zeros((b.num_rows, 0), np.float32))[1]  # the scale of a vector without numbers
            codes, places, scale = [pa.array([], pa.list_(pa.int8()))], [np.zeros(0, np.int64)], none.copy()
            for at, x, holes in _matrices(b.column(vec), np.float32):
                with np.errstate(invalid="ignore", over="ignore"):
                    found, scale[at] = f(x)
                codes.append(_lists(found, holes))
                places.append(at)
            code = pa.StructArray.from_arrays([_in_order(codes, places, b.num_rows), pa.array(scale)], ["codes", "scale"])
            yield pa.RecordBatch.from_arrays([*b.columns, code], [*b.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, CODE)]))


def decode(df: DataFrame, codec: str, code: str = "code", out: str = "decoded") -> DataFrame:
    """``df`` with ``out`` as ``codecs.decode`` gives it."""
    f, rows = DECODERS[codec], df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(code)
            lists = pc.if_else(c.is_valid(), c.field(0), None)
            scale = pc.fill_null(c.field(1), np.nan).to_numpy(zero_copy_only=False)
            vectors, places = [pa.array([], pa.list_(pa.float32()))], [np.zeros(0, np.int64)]
            for at, x, holes in _matrices(lists, np.int8):
                vectors.append(_lists(f(x, scale[at]).astype(np.float32), holes))
                places.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, _in_order(vectors, places, b.num_rows)], [*b.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def roundtrip_cosine(df: DataFrame, codec: str, vec: str = "vec", out: str = "cosine") -> DataFrame:
    """``df`` without its vectors (array<float>), with their cosines to what the codec makes of them, as ``vec.cosine`` gives them."""
    encoded, decoded, rows = ENCODERS[codec], DECODERS[codec], df.drop(out)
    keep = [c for c in rows.columns if c != vec]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.zeros(b.num_rows)
            for at, x, holes in _matrices(b.column(vec), np.float32):
                with np.errstate(invalid="ignore", over="ignore"):
                    y = decoded(*encoded(x)).astype(np.float32).astype(np.float64)
                    x = x.astype(np.float64)
                    n = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
                    some = (n != 0) & (~holes.any(axis=1) if holes is not None else True)
                    found[at[some]] = (x * y).sum(1)[some] / n[some]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(found)], [*keep, out])

    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in keep], T.StructField(out, T.DoubleType(), False)]))
