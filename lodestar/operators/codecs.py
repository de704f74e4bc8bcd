"""Codecs as pairs of column expressions.

Every codec turns a vector column into a struct of codes and what decoding needs.
Divisions are cast back to single precision, so codes equal those of single-precision
arithmetic.  Zero vectors get scale 1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import vec as V

#: Levels of 4-bit NormalFloat: quantiles of a normal distribution, from the QLoRA paper (fixed values).
NF4_LEVELS = (-1.0, -0.6961928, -0.5250730, -0.3949003, -0.2844677, -0.1848745, -0.09105004, 0.0, 0.07958031, 0.16093908, 0.24611496, 0.33791524, 0.44070983, 0.56266755, 0.72295761, 1.0)


def nf4_thresholds() -> list[float]:
    """Midpoints of neighbouring levels, in single precision."""
    levels = np.array(NF4_LEVELS, np.float32)
    return [float(x) for x in (levels[:-1] + levels[1:]) / np.float32(2)]


def _ratio(x: Column, scale: Column) -> Column:
    return (x.cast("double") / scale.cast("double")).cast("float")


def _or_one(m: Column, value: Column) -> Column:
    return F.when(m == 0, F.lit(1.0)).otherwise(value).cast("float")


def _clip(x: Column, bound: float) -> Column:
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), x))


# INT8 family -----------------------------------------------------------------


def _coded(v: Column, scale: Column, code: Callable[[Column, Column], Column], kind: str = "tinyint") -> Column:
    """Struct of ``code(x, scale)`` of every number, and the scale; a null number has a null code."""
    return V.let(scale, lambda s: F.struct(F.transform(v, lambda x: F.when(x.isNotNull(), code(x, s).cast(kind))).alias("codes"), s.alias("scale")))


def int8(v: Column, range_factor: float = 1.0) -> Column:
    """Symmetric abs-max codes; halves round to even."""
    scale = V.let(V.abs_max(v), lambda m: _or_one(m, m.cast("double") / (127.0 * range_factor)))
    return _coded(v, scale, lambda x, s: _clip(F.rint(_ratio(x, s)), 127.0))


def int8_decode(c: Column) -> Column:
    return F.transform(c["codes"], lambda x: (x.cast("float") * c["scale"]).cast("float"))


def int8_max_scale(v: Column) -> Column:
    """Codes with the maximum itself as scale; halves round away from 0."""
    scale = V.let(V.abs_max(v), lambda m: _or_one(m, m))
    return _coded(v, scale, lambda x, s: _clip(F.round((_ratio(x, s) * 127).cast("float").cast("double")), 127.0))


def int8_max_scale_decode(c: Column) -> Column:
    return F.transform(c["codes"], lambda x: (x.cast("double") * c["scale"] / 127).cast("float"))


def int8_normalized(v: Column) -> Column:
    """For unit vectors: the scale is 1/127 and no maximum is looked for."""
    return F.struct(F.transform(v, lambda x: _clip(F.round(x.cast("double") * 127), 127.0).cast("tinyint")).alias("codes"), F.lit(1 / 127).cast("float").alias("scale"))


def _in_groups(v: Column, size: int, one: Callable[[Column], Column], *more: tuple[str, str]) -> Column:
    """Struct of the strung-together codes of consecutive groups and arrays of their other fields."""
    field = lambda parts, name: F.transform(parts, lambda p: p[name])
    return V.let(F.transform(V.groups(v, size), lambda g: one(g)), lambda parts: F.struct(F.flatten(field(parts, "codes")).alias("codes"), *[field(parts, old).alias(new) for old, new in more]))


def int8_grouped(v: Column, size: int) -> Column:
    """A scale for each ``size`` consecutive numbers."""
    return _in_groups(v, size, int8, ("scale", "scales"))


def grouped_decode(c: Column, size: int) -> Column:
    return F.transform(c["codes"], lambda x, i: (x.cast("float") * F.element_at(c["scales"], F.floor(i / size).cast("int") + 1)).cast("float"))


def int8_adaptive(v: Column, clip_ratio: float = 3.0) -> Column:
    """Numbers are clipped at ``clip_ratio`` median absolute deviations first."""
    mad = V.let(V.median(v), lambda m: V.median(F.transform(v, lambda x: F.abs(x.cast("double") - m))))
    bound = V.let(mad, lambda d: F.when(d == 0, V.abs_max(v).cast("double")).otherwise(d * clip_ratio))
    clipped = V.let(bound, lambda b: F.transform(v, lambda x: F.greatest(-b, F.least(b, x.cast("double"))).cast("float")))
    return V.let(clipped, int8)


def int4_grouped(v: Column, size: int = 64) -> Column:
    """Codes -7..7 with a scale for each ``size`` numbers."""
    def one(g: Column) -> Column:
        return _coded(g, V.let(V.abs_max(g), lambda m: _or_one(m, m.cast("double") / 7)), lambda x, s: _clip(F.rint(_ratio(x, s)), 7.0))

    return _in_groups(v, size, one, ("scale", "scales"))


def profile_simulated(v: Column, bits: int, range_factor: float, percentile: float) -> Column:
    """Vector as it comes back from a profile: clip at a percentile of magnitudes, scale, round."""
    most = {8: 127.0, 4: 7.0}.get(bits)

    def rounded(w: Column) -> Column:
        scale = V.let(V.abs_max(w), lambda m: _or_one(m, m.cast("double") / (127.0 * range_factor)))
        if most is None:
            return V.let(scale, lambda s: F.transform(w, lambda x: (F.signum(x) * s).cast("float")))
        return V.let(scale, lambda s: F.transform(w, lambda x: (_clip(F.rint(_ratio(x, s)), most) * s).cast("float")))

    if percentile >= 100:
        return rounded(v)

    def at_percentile(s: Column) -> Column:
        at = (F.size(s) - 1) * (percentile / 100)
        low = F.element_at(s, F.floor(at).cast("int") + 1)
        return low + (F.element_at(s, F.ceil(at).cast("int") + 1) - low) * (at - F.floor(at))

    bound = V.let(F.array_sort(F.transform(v, lambda x: F.abs(x.cast("double")))), at_percentile)
    return V.let(V.let(bound, lambda b: F.transform(v, lambda x: F.greatest(-b, F.least(b, x.cast("double"))).cast("float"))), rounded)


# 4 bits and fewer -------------------------------------------------------------


def int2(v: Column, size: int = 32) -> Column:
    """Ternary codes 0..2 around each group's mean."""
    def one(g: Column) -> Column:
        def around(zero: Column) -> Column:
            shifted = F.transform(g, lambda x: (x.cast("double") - zero.cast("double")).cast("float"))
            coded = V.let(shifted, lambda w: _coded(w, V.let(V.abs_max(w), lambda m: _or_one(m, m)), lambda x, s: _clip(F.rint(_ratio(x, s)), 1.0) + 1))
            return V.let(coded, lambda c: F.struct(c["codes"].alias("codes"), c["scale"].alias("scale"), zero.alias("zero")))

        return V.let(V.mean(g).cast("float"), around)

    return _in_groups(v, size, one, ("scale", "scales"), ("zero", "zeroes"))


def int2_decode(c: Column, size: int = 32) -> Column:
    at = lambda i: F.floor(i / size).cast("int") + 1
    return F.transform(c["codes"], lambda x, i: ((x.cast("double") - 1) * F.element_at(c["scales"], at(i)) + F.element_at(c["zeroes"], at(i))).cast("float"))


def nf4(v: Column, halves_up: bool = False) -> Column:
    """Index of the nearest level; a number half-way between two gets the lower, or with ``halves_up`` the upper."""
    bounds = F.array(*[F.lit(t).cast("float") for t in nf4_thresholds()])
    index = lambda y: V.let(y, lambda z: F.size(F.filter(bounds, lambda t: t <= z if halves_up else t < z)))
    return V.let(V.abs_max(v), lambda m: F.struct(F.transform(v, lambda x: F.when(x.isNotNull(), index(_ratio(x, _or_one(m, m))).cast("tinyint"))).alias("codes"), m.alias("scale")))


def nf4_decode(c: Column) -> Column:
    levels = F.array(*[F.lit(x).cast("float") for x in NF4_LEVELS])
    return F.transform(c["codes"], lambda x: (F.element_at(levels, x.cast("int") + 1) * c["scale"]).cast("float"))


def sq(v: Column, bits: int) -> Column:
    """Uniform codes of 2 or 3 bits over [-max, max]."""
    half = 1 << (bits - 1)

    def code(x: Column, s: Column) -> Column:
        inverse = (F.lit(1.0) / s.cast("double")).cast("float")
        part = _clip((x * inverse).cast("float"), 1.0)
        return F.greatest(F.lit(0), F.least(F.lit(2 * half - 1), F.floor((part.cast("double") + 1) * half)))

    return _coded(v, V.let(V.abs_max(v), lambda m: _or_one(m, m)), code)


def sq_decode(c: Column, bits: int) -> Column:
    top = 1 << bits
    return F.transform(c["codes"], lambda x: (c["scale"] * ((2 * x.cast("int") - (top - 1)) / F.lit(float(top))).cast("float")).cast("float"))


def binary(v: Column) -> Column:
    """Sign bits (1 where above 0) in 64-bit words, lowest dimension in the lowest bit."""
    words = F.transform(V.groups(v, 64), lambda g: F.aggregate(F.transform(g, lambda x, i: F.when(x > 0, _bit(i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(b)))
    return F.struct(words.alias("words"), F.size(v).alias("dims"))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def binary_decode(c: Column) -> Column:
    bit = lambda i: F.call_function("shiftright", F.element_at(c["words"], F.floor(i / 64).cast("int") + 1), (i % 64).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return F.transform(F.sequence(F.lit(0), c["dims"] - 1), lambda i: (2 * bit(i) - 1).cast("float"))


def matryoshka(v: Column, dims: list[int]) -> Column:
    """Sign bits of several prefixes: array of (dims, words)."""
    return F.array(*[F.struct(F.lit(d).alias("prefix"), binary(F.slice(v, 1, d))["words"].alias("words")) for d in dims])


def packed(codes: Column, bits: int) -> Column:
    """Codes of 1, 2 or 4 bits as bytes 0..255, the first code in the lowest bits."""
    per = 8 // bits
    return F.transform(V.groups(codes, per), lambda g: F.aggregate(F.transform(g, lambda x, i: x.cast("int") * F.pow(F.lit(2), i * bits).cast("int")), F.lit(0), lambda acc, x: acc + x).cast("smallint"))


def unpacked(data: Column, bits: int, count: int) -> Column:
    per, top = 8 // bits, (1 << bits) - 1
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.call_function("shiftright", F.element_at(data, F.floor(i / per).cast("int") + 1).cast("int"), ((i % per) * bits).cast("int")).bitwiseAND(F.lit(top)).cast("tinyint"))


# Min-max over the data set ----------------------------------------------------


def minmax_table(df: DataFrame, vec: str = "vec") -> DataFrame:
    """One row: arrays of every dimension's minimum and maximum over the finite vectors that have it.

    Each task first reduces its batches to one row per dimension, so the shuffle
    carries dimensions, not numbers.  Null vectors and those with a null or non-finite number don't count.
    """
    from lodestar.operators.scan import by_length

    def run(batches):
        low = high = np.zeros(0, np.float32)
        for b in batches:
            for n, _, x in by_length(b.column(0)):
                if n > len(low):
                    low, high = (np.append(ends, np.full(n - len(ends), none, np.float32)) for ends, none in ((low, np.inf), (high, -np.inf)))
                low[:n], high[:n] = np.minimum(low[:n], x.min(0, initial=np.inf)), np.maximum(high[:n], x.max(0, initial=-np.inf))
        known = np.flatnonzero(low <= high)
        if len(known) < len(low):
            low, high = low[known], high[known]
        if len(low):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low), pa.array(high)], ["dim", "low", "high"])

    per = df.select(vec).mapInArrow(run, "dim int, low float, high float").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "low", "high")))
    return per.agg(F.transform(ordered, lambda r: r["low"]).alias("lows"), F.transform(ordered, lambda r: r["high"]).alias("highs"))


def minmax(df: DataFrame, vec: str = "vec") -> DataFrame:
    """``df`` with lows, highs and codes 0..255; a dimension without range gets code 0.

    Products with 255 are in single precision.
    """
    joined = df.crossJoin(F.broadcast(minmax_table(df, vec)))  # one row
    one = lambda n: F.lit(float(n)).cast("float")
    part = lambda x, i: ((x.cast("double") - F.element_at("lows", i + 1)) / (F.element_at("highs", i + 1).cast("double") - F.element_at("lows", i + 1))).cast("float")
    code = lambda x, i: F.when(F.element_at("highs", i + 1) <= F.element_at("lows", i + 1), 0).otherwise(F.round(F.greatest(one(0), F.least(one(1), part(x, i))) * one(255))).cast("smallint")
    return joined.withColumn("codes", F.transform(vec, code))


def minmax_decode(codes: Column, lows: Column, highs: Column) -> Column:
    """Numbers of the codes; quotients by 255 are in single precision, as the products are."""
    return F.transform(codes, lambda c, i: (F.element_at(lows, i + 1).cast("double") + (c / F.lit(255.0)).cast("float").cast("double") * (F.element_at(highs, i + 1).cast("double") - F.element_at(lows, i + 1))).cast("float"))


# Registry ---------------------------------------------------------------------


@dataclass(frozen=True)
class Codec:
    """Encode and decode expressions and the bytes of a vector of d numbers."""

    name: str
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]
    bytes: Callable[[int], float]

    def ratio(self, dims: int) -> float:
        """Compression against 4 bytes a number."""
        return 4 * dims / self.bytes(dims)

    def bits_per_dim(self, dims: int) -> float:
        return 8 * self.bytes(dims) / dims

    def dist_to_query(self, query: Column, code: Column) -> Column:
        """Cosine distance of a vector and a code; codes with one scale need none of it, as it cancels out."""
        plain = self.name in ("int8", "int8_normalized", "int8_adaptive")
        return 1 - V.cosine(query, code["codes"] if plain else self.decode(code))


CODECS = {
    c.name: c
    for c in (
        Codec("int8", int8, int8_decode, lambda d: d + 4),
        Codec("int8_normalized", int8_normalized, int8_decode, lambda d: d),
        Codec("int8_grouped", lambda v: int8_grouped(v, 16), lambda c: grouped_decode(c, 16), lambda d: d + 4 * -(-d // 16)),
        Codec("int8_adaptive", int8_adaptive, int8_decode, lambda d: d + 4),
        Codec("int4", int4_grouped, lambda c: grouped_decode(c, 64), lambda d: d / 2 + 4 * -(-d // 64)),
        Codec("int2", int2, int2_decode, lambda d: d / 4 + 8 * -(-d // 32)),
        Codec("nf4", nf4, nf4_decode, lambda d: -(-d // 2) + 4),
        Codec("sq2", lambda v: sq(v, 2), lambda c: sq_decode(c, 2), lambda d: -(-d // 4) + 4),
        Codec("sq3", lambda v: sq(v, 3), lambda c: sq_decode(c, 3), lambda d: -(-3 * d // 8) + 4),
        Codec("binary", binary, binary_decode, lambda d: -(-d // 8)),
    )
}


def encode(df: DataFrame, codec: str, vec: str = "vec", out: str = "code") -> DataFrame:
    return df.withColumn(out, CODECS[codec].encode(F.col(vec)))


def decode(df: DataFrame, codec: str, code: str = "code", out: str = "decoded") -> DataFrame:
    return df.withColumn(out, CODECS[codec].decode(F.col(code)))


def register(codec: Codec) -> None:
    """Add or replace a codec."""
    CODECS[codec.name] = codec
