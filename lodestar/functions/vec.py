"""Vector arithmetic as column expressions; sums are in double precision, left to right."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A column used inside a lambda is computed anew for every element; a lambda's own
    variable isn't.
    """
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, zero: float = 0.0) -> Column:
    """Cosine; ``zero`` where a norm is 0 or the lengths differ."""
    return let(norm(a) * norm(b), lambda n: F.when((n > 0) & (F.size(a) == F.size(b)), dot(a, b) / n).otherwise(F.lit(zero)))


def l2_squared(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def normalized(v: Column) -> Column:
    """Unit vector in single precision; a zero vector stays as it is."""
    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(v))


def abs_max(v: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(v, lambda x: F.abs(x))), F.lit(0.0).cast("float"))


def mean(v: Column) -> Column:
    """Mean of the numbers; null for none."""
    return F.try_divide(total(v), F.size(v))


def median(v: Column) -> Column:
    """Mean of the two middle values for an even number of them."""
    def middle(s: Column) -> Column:
        n = F.size(s)
        return (F.element_at(s, F.floor((n + 1) / 2).cast("int")).cast("double") + F.element_at(s, F.floor(n / 2 + 1).cast("int")).cast("double")) / 2

    return let(F.array_sort(v), middle)


def groups(v: Column, size: int) -> Column:
    """Consecutive slices of ``size``; the last may be shorter."""
    count = F.ceil(F.size(v) / size).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda g: F.slice(v, g * size + 1, F.lit(size)))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """95 % interval (low, high) of a proportion; nulls for no trials."""
    n = F.when(n > 0, n)
    p, zz = hits / n, z * z
    middle, spread, scale = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)), 1 + zz / n
    return F.struct(F.greatest(F.lit(0.0), (middle - spread) / scale).alias("low"), F.least(F.lit(1.0), (middle + spread) / scale).alias("high"))
