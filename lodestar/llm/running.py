"""Running values and cuts over long arrays, as native expressions.

An expression that appends to an array copies it, so a scan of n items costs n squared.
Here items go in chunks: appending happens inside a chunk, and once for each chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items of a chunk.
CHUNK = 128


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda computes other columns anew for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunks(items: Column) -> Column:
    """``items`` as an array of arrays."""
    many = lambda x: F.greatest(F.lit(1), F.ceil(F.size(x) / CHUNK)).cast("int")
    return once(items, lambda x: F.transform(F.sequence(F.lit(0), many(x) - 1), lambda i: F.slice(x, i * CHUNK + 1, CHUNK)))


def running(items: Column, kind: str, start: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """``step(state, item) -> (state, output)`` from left to right; the array of outputs, of type ``kind``.  Null items give null."""
    none = F.array().cast(f"array<{kind}>")

    def inner(chunk: Column, state: Column) -> Column:
        def one(acc: Column, item: Column) -> Column:
            after, out = step(acc["state"], item)
            return F.struct(after.alias("state"), F.array_append(acc["out"], out).alias("out"))

        return F.aggregate(chunk, F.struct(state.alias("state"), none.alias("out")), one)

    def outer(acc: Column, chunk: Column) -> Column:
        return once(inner(chunk, acc["state"]), lambda x: F.struct(x["state"].alias("state"), F.array_append(acc["out"], x["out"]).alias("out")))

    nested = F.array().cast(f"array<array<{kind}>>")
    return F.flatten(F.aggregate(chunks(items), F.struct(start.alias("state"), nested.alias("out")), outer)["out"])


def cuts(text: Column, spans: Column) -> Column:
    """Parts of a text at sorted spans (start, end); each chunk of spans walks the text once."""
    def inside(whole: Column, chunk: Column) -> Column:
        first = F.element_at(chunk, 1)["start"]
        part = F.substring(whole, first + 1, F.element_at(chunk, -1)["end"] - first)
        return once(F.struct(part.alias("part"), first.alias("first")), lambda p: F.transform(chunk, lambda s: F.substring(p["part"], s["start"] - p["first"] + 1, s["end"] - s["start"])))

    every = once(text, lambda whole: F.flatten(F.transform(chunks(spans), lambda chunk: inside(whole, chunk))))
    return F.when(F.size(spans) == 0, F.array().cast("array<string>")).otherwise(every)
