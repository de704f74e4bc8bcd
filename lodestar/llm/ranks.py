"""Gapless positions inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window partition is meant to hold.
ROWS_PER_CELL = 50_000


def gapless(df: DataFrame, group: str, spread, order: list, name: str, rows: int) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each value of ``group``.

    A group is split into cells by the hash ``spread``; the number of cells grows
    with ``rows``, so a cell stays near ``ROWS_PER_CELL`` rows however large the
    group is.  A row's position is its place in the cell plus the sizes of the
    group's earlier cells.
    """
    cells = max(1, -(-rows // ROWS_PER_CELL))
    keyed = df.withColumn("_cell", F.pmod(spread, F.lit(cells)).cast("int"))
    within = Window.partitionBy(group, "_cell").orderBy(*order)
    placed = keyed.withColumn("_place", F.row_number().over(within).cast("long") - 1)
    if cells == 1:
        return placed.withColumn(name, F.col("_place")).drop("_cell", "_place")
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n")).select(group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, [group, "_cell"]).withColumn(name, F.col("_start") + F.col("_place")).drop("_cell", "_place", "_start")
