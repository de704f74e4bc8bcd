"""Stored vectors: append, upsert, delete, compact.

A store is a table with an ``id``.  Every change is a plan over the old table and the
change; nothing is decoded or encoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows that one task numbers.
CELL_ROWS = 1_000_000


def last_per_id(new: DataFrame, order: str | None = None, id_col: str = "id") -> DataFrame:
    """One row per id: that with the largest ``order``, or any if none is given."""
    if order is None:
        return new.dropDuplicates([id_col])
    w = Window.partitionBy(id_col).orderBy(F.desc_nulls_last(order))
    return new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def append(store: DataFrame, new: DataFrame) -> DataFrame:
    return store.unionByName(new)


def write(store: DataFrame, new: DataFrame, policy: str = "skip", order: str | None = None, id_col: str = "id") -> DataFrame:
    """Rows of ``new`` into the store; ids in both are kept (``skip``), replaced (``overwrite``) or refused (``fail``).

    Ids that ``new`` has twice count once.
    """
    new = last_per_id(new, order, id_col)
    if policy == "skip":
        return store.unionByName(new.join(store.select(id_col), id_col, "left_anti"))
    if policy == "overwrite":
        return store.join(new.select(id_col), id_col, "left_anti").unionByName(new)
    if policy == "fail":
        if new.join(store.select(id_col), id_col, "left_semi").limit(1).count():
            raise ValueError("an id is in the store already")
        return store.unionByName(new)
    raise ValueError(f"unknown policy {policy!r}")


def write_counts(store: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """``(action, n)``: how many ids of ``new`` would be inserted or updated."""
    known = store.select(id_col).distinct().withColumn("_known", F.lit(True))
    action = F.when(F.col("_known"), "update").otherwise("insert")
    return new.select(id_col).distinct().join(known, id_col, "left").groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


def delete(store: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return store.join(ids.select(id_col), id_col, "left_anti")


def fetch(store: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of known ids; no id known is an error."""
    found = store.join(ids.select(id_col).distinct(), id_col, "left_semi")
    if not found.limit(1).count():
        raise KeyError("none of the ids is in the store")
    return found


def tombstone(tombstones: DataFrame | None, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Deleted ids, with more of them."""
    ids = ids.select(id_col)
    return (ids if tombstones is None else tombstones.unionByName(ids)).distinct()


def alive(store: DataFrame, tombstones: DataFrame, id_col: str = "id") -> DataFrame:
    return store.join(tombstones, id_col, "left_anti")


def compact(store: DataFrame, tombstones: DataFrame, id_col: str = "id", renumber: bool = False) -> DataFrame:
    """The store without deleted rows; ids stay unless ``renumber``, which adds ``new_id`` 0, 1, ... by id.

    Rows are numbered in cells of about ``CELL_ROWS`` (ranges of a numeric id, hashes of
    any other), after the rows of the cells before, so no task sees the whole store.
    """
    left = alive(store, tombstones, id_col)
    if not renumber:
        return left
    cells = max(1, left.count() // CELL_ROWS)
    if cells == 1:
        cell = F.lit(0)
    elif dict(left.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        bounds = sorted(set(left.approxQuantile(id_col, [i / cells for i in range(1, cells)], 0.1 / cells)))
        cell = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(id_col)))
    else:
        cell = F.pmod(F.xxhash64(id_col), F.lit(cells)).cast("int")
    keyed = left.withColumn("_p", cell)
    sizes = keyed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(id_col)) - 1
    return keyed.withColumn("_i", place).join(F.broadcast(starts), "_p").withColumn("new_id", F.col("_s") + F.col("_i")).drop("_p", "_i", "_s")


def stats(store: DataFrame, tombstones: DataFrame | None, dims: int, bytes_per_vector: float, id_col: str = "id") -> DataFrame:
    """One row: total, alive, deleted, dims, compression ratio."""
    marked = store.select(id_col) if tombstones is None else store.select(id_col).join(tombstones.withColumn("_dead", F.lit(1)), id_col, "left")
    dead = F.lit(0) if tombstones is None else F.count("_dead")
    return marked.agg(F.count(F.lit(1)).alias("total"), dead.alias("deleted")).select("total", (F.col("total") - F.col("deleted")).alias("alive"), "deleted", F.lit(dims).alias("dims"), F.lit(4 * dims / bytes_per_vector).alias("ratio"))
