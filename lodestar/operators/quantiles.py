"""Exact quantiles of any number of rows, by counting ranges.

A quantile is the value of a rank or two.  A sketch of fixed size cuts the range that holds
a wanted rank into cells, an exact count says which cell has it, and the next round looks at
that cell alone, until it has few enough rows to be sorted.  What a task, a
shuffle or the driver holds depends on the number of cells and ranks, never on how many distinct values there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.staging import stage

#: Cells of a range, and accuracy of the sketch that finds their borders.
CELLS, ACCURACY = 256, 2_000
#: Rows of a range that are sorted at once.
SORTED = 50_000


class _Range:
    """Where a wanted rank of a group is: ``low`` to ``high``, with so many rows of the group ``below`` and ``inside``."""

    def __init__(self, group: int, rank: int, low: float, high: float, inside: int):
        self.group, self.rank, self.low, self.high, self.below, self.inside = group, rank, low, high, 0, inside

    @property
    def found(self) -> bool:
        return self.low == self.high or (np.isnan(self.low) and np.isnan(self.high))


def _cells(at: list[tuple[int, float, float, np.ndarray]]):
    """(group, value) -> (range, cell, n): cell 2i holds values equal to border i, cell 2i + 1 those up to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(2 * len(b) + 1, np.int64) for *_, b in at]
        for batch in batches:
            group, value = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for j, (g, low, high, borders) in enumerate(at):
                v = value[group == g]
                v = v[((v >= low) | np.isnan(v)) & ((v <= high) | np.isnan(high))]
                left = np.searchsorted(borders, v, "left")  # NaN sorts last
                equal = np.searchsorted(borders, v, "right") > left
                counts[j] += np.bincount(2 * left - 1 + equal, minlength=len(counts[j]) + 1)[: len(counts[j])] if len(v) else 0
        rows = [(j, int(c), int(counts[j][c])) for j in range(len(at)) for c in np.flatnonzero(counts[j])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], ["range", "cell", "n"])

    return run


def _ranges(rows: DataFrame, wanted: list[_Range]) -> DataFrame:
    """Rows that lie in some range, with ``range``: its number in ``wanted``."""
    table = rows.sparkSession.createDataFrame([(r.group, i, float(r.low), float(r.high)) for i, r in enumerate(wanted)], "g int, range int, low double, high double")
    t = F.broadcast(table)  # a row per wanted rank
    return rows.join(t, (rows["group"] == t["g"]) & (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))).select("range", "group", "value")


def _narrow(rows: DataFrame, wanted: list[_Range]) -> None:
    """One round: every range becomes the cell that holds its rank."""
    grid = F.array(*[F.lit(i / CELLS) for i in range(CELLS + 1)])
    sketched = _ranges(rows, wanted).groupBy("range").agg(F.percentile_approx("value", grid, F.lit(ACCURACY)).alias("q")).collect()  # ``CELLS`` numbers a rank
    borders = {r["range"]: np.unique(np.array([wanted[r["range"]].low, *r["q"], wanted[r["range"]].high])) for r in sketched}
    at = [(r.group, r.low, r.high, borders[i]) for i, r in enumerate(wanted)]
    counted = rows.select("group", "value").mapInArrow(_cells(at), "range int, cell int, n long").groupBy("range", "cell").agg(F.sum("n").alias("n"))
    cells: dict[int, list[tuple[int, int]]] = {}
    for r in counted.collect():  # 2 * ``CELLS`` rows a rank at most
        cells.setdefault(r["range"], []).append((r["cell"], r["n"]))
    for i, r in enumerate(wanted):
        b, below = borders[i], r.below
        for cell, n in sorted(cells[i]):
            if below + n >= r.rank:
                # The values between two borders are what is left of that cell; its borders are cells of their own.
                low, high = (b[cell // 2], b[cell // 2]) if cell % 2 == 0 else (np.nextafter(b[cell // 2], np.inf), np.inf if np.isnan(b[cell // 2 + 1]) else np.nextafter(b[cell // 2 + 1], -np.inf))
                r.low, r.high, r.below, r.inside = float(low), float(high), below, n
                break
            below += n


def exact(df: DataFrame, value: Column, fractions: list[float], by: list[str] | None = None, linear: bool = True) -> DataFrame:
    """``(by..., fraction, value)``: quantiles of ``value`` in each group, linear between two ranks, or with ``linear`` off the first value whose share of rows at or below it reaches the fraction.

    Nulls don't count, and what isn't a number counts as larger than any; a group without values, or an
    empty table, has no rows.  Groups must be few: a row for each and for each wanted rank reaches the driver.
    """
    keys = by or []
    spark = df.sparkSession
    # Written once, as it is read a few times and an expression may cost more than a number.
    valued = stage(df.select(*keys, value.cast("double").alias("value")), "quantiles").where("value is not null")
    ends = valued.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("value").alias("_low"), F.max("value").alias("_high")).collect()
    kinds = ", ".join([*(f"`{c}` {t}" for c, t in valued.dtypes[:-1]), "fraction double, value double"])
    if not ends or not ends[0]["_n"]:
        return spark.createDataFrame([], kinds)
    if keys:
        names = spark.createDataFrame([(i, *(e[c] for c in keys)) for i, e in enumerate(ends)], "group int, " + ", ".join(f"`_k{j}` {t}" for j, (_, t) in enumerate(valued.dtypes[:-1])))
        same = [valued[c].eqNullSafe(F.col(f"_k{j}")) for j, c in enumerate(keys)]
        rows = valued.join(F.broadcast(names), same).select("group", "value")  # a row per group
    else:
        rows = valued.select(F.lit(0).alias("group"), "value")

    def places(n: int, p: float) -> tuple[int, int, float]:
        """(rank, next rank, share of the next)"""
        if not linear:
            return (rank := min(n, max(1, ceil(p * n - 1e-9)))), rank, 0.0
        at = p * (n - 1)
        return floor(at) + 1, ceil(at) + 1, at - floor(at)

    wanted = {(g, r): _Range(g, r, e["_low"], e["_high"], e["_n"]) for g, e in enumerate(ends) for p in fractions for r in places(e["_n"], p)[:2]}
    while open_ := [r for r in wanted.values() if not r.found and r.inside > SORTED]:
        _narrow(rows, open_)
    last = [r for r in wanted.values() if not r.found]
    if last:
        shared = {(r.group, r.low, r.high): r for r in last}
        number = {k: i for i, k in enumerate(shared)}
        ranks = spark.createDataFrame([(number[r.group, r.low, r.high], i, r.rank - r.below) for i, r in enumerate(last)], "range int, which int, at int")
        lists = _ranges(rows, list(shared.values())).groupBy("range").agg(F.sort_array(F.collect_list("value")).alias("values"))  # ``SORTED`` numbers a range at most
        for r in lists.join(F.broadcast(ranks), "range").select("which", F.element_at("values", F.col("at")).alias("v")).collect():
            last[r["which"]].low = r["v"]
    out = []
    for g, e in enumerate(ends):
        for p in fractions:
            one, two, share = places(e["_n"], p)
            a, b = wanted[g, one].low, wanted[g, two].low
            out.append((*(e[c] for c in keys), float(p), float(a if share == 0 else (1 - share) * a + share * b)))
    return spark.createDataFrame(out, kinds)
