"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Centroids are fitted on a bounded sample of rows; every row is then assigned to
the cell of its nearest centroid.  A vector within reach of a linked one that lives
in another cell is also a guest there: if x lives in cell a and y in cell b, y lies
beyond the plane half-way between the two centroids, so x can link to it only if the
angle from x to that plane is at most the linking angle.  Guests go to cells with
lower numbers only, so that each pair meets once.

That bound loses no link and is the default.  ``sigmas`` narrows it to that many shares of
1 / sqrt(d), which loses links of vectors that differ mostly across the plane.

Vectors of every length are compared with those of the same length: the most common
lengths have cells of their own, any other is one cell.

Within a cell, blocks of rows are multiplied in pairs.  A product gives link counts
and a spanning forest of its links, never the pairs themselves.  Identical vectors
are one row with a count by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.components import components
from lodestar.llm.scratch import drop, sized, stage

#: Rows, and numbers in them, that centroids are fitted on at most.
SAMPLE_ROWS, SAMPLE_NUMBERS = 16_384, 2_000_000
#: Rows that a cell is meant to hold, and cells at most.
CELL_ROWS, MAX_CELLS = 1_500, 1_024
#: Lengths of vectors that are split into cells; the others, less common, are one cell each.
LENGTHS = 8
#: Rows of a block, and numbers in it.
BLOCK, BLOCK_NUMBERS = 2_048, 4_000_000


def _encode(kind: str):
    """id, embedding -> id, dimension (0: links with nothing), bytes of its numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, raw = [], []
            for v in batch.column(1):
                x = v.values.to_numpy(zero_copy_only=False).astype(kind) if v.is_valid else np.zeros(0, kind)  # a null is NaN
                ok = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                dims.append(len(x) if ok else 0)
                raw.append((x + x.dtype.type(0)).tobytes() if ok else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["id", "dim", "raw"])

    return run


def unit(raw, dim: int, kind: str) -> np.ndarray:
    """Rows of bytes as unit vectors in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Unit centroids; a centroid that loses its rows moves to the row worst served."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        products = x @ centroids.T
        home = products.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        norms = np.linalg.norm(sums, axis=1)
        poor = np.argsort(products[np.arange(len(x)), home])
        for i, c in enumerate(np.flatnonzero(norms < 1e-12)):
            sums[c], norms[c] = x[poor[i % len(x)]], 1.0
        new = sums / norms[:, None]
        if np.allclose(new, centroids):
            break
        centroids = new
    return centroids


def reach(x: np.ndarray, centroids: np.ndarray, threshold: float, sigmas: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each row, mask of the cells below it where the row is a guest)."""
    products = x @ centroids.T
    home = products.argmax(axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * centroids[home] @ centroids.T, 0))
    sine = np.sqrt(1 - threshold * threshold) * (1 if sigmas is None else min(1.0, sigmas / np.sqrt(x.shape[1])))
    best = products[np.arange(len(x)), home][:, None]
    guest = (best - products) <= sine * gap + 1e-9
    return home, guest & (np.arange(len(centroids)) < home[:, None])


def _assign(centroids: dict[int, np.ndarray], kind: str, threshold: float, sigmas: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.take(pa.array(np.flatnonzero(dims == dim)))
                home, row, cell = np.zeros(rows.num_rows, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                if dim in centroids:
                    home, guest = reach(unit(rows.column(3).to_pylist(), dim, kind), centroids[dim], threshold, sigmas)
                    row, cell = np.nonzero(guest)
                out = rows.take(pa.array(np.concatenate([np.arange(len(home)), row])))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate([home, cell]).astype(np.int32)), pa.array(np.repeat([False, True], [len(home), len(row)]))], ["id", "dim", "copies", "raw", "cell", "guest"])

    return run


def _product(kind: str, threshold: float):
    """One pair of blocks of a cell: rows with side 0 or 1 in, (id, links, root) of linked rows out."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        one = rows[rows["side"] == 0]
        two = rows[rows["side"] == 1]
        alone = bool((rows["i"] == rows["j"]).all()) and not len(two)
        if not len(one) or (not alone and not len(two)):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        dim = int(rows["dim"].iloc[0])
        x = unit(one["raw"], dim, kind)
        y = x if alone else unit(two["raw"], dim, kind)
        near = x @ y.T >= threshold
        if alone:
            np.fill_diagonal(near, False)
            ids, links = one["id"].to_numpy(), near @ one["copies"].to_numpy()
        else:
            ids = np.concatenate([one["id"], two["id"]])
            links = np.concatenate([near @ two["copies"].to_numpy(), near.T @ one["copies"].to_numpy()])
        root = _roots(ids, near, alone)
        linked = links > 0
        return pd.DataFrame({"id": ids[linked], "links": links[linked].astype(np.int64), "root": root[linked]})

    return run


def _roots(ids: np.ndarray, near: np.ndarray, alone: bool) -> np.ndarray:
    """Smallest id that each row reaches inside the product."""
    label = ids.copy()
    a, b = np.nonzero(near)
    b = b if alone else b + near.shape[0]
    while len(a):
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        if (new == label).all():
            break
        label = new
    return label


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, sigmas: float | None = None) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` per row; vectors link at cosine >= threshold, above 0.

    All links are found, and none below the threshold.  With ``sigmas``, those between
    cells may be missed.

    Rows link with nothing if the vector is null, empty, zero or holds a null or
    non-finite number, or if the id is null (component null, not kept).  Vectors of
    different lengths don't link.  Numbers are compared in double precision: those of an
    ``array<float>`` as they are, those of any other array as doubles.  Repeated rows link
    like any two equal vectors.
    """
    kind = "<f4" if dict(df.dtypes)[vector] == "array<float>" else "<f8"
    numbers = F.col(vector) if kind == "<f4" else F.col(vector).cast("array<double>")
    rows = stage(df.select(F.col(id_col).cast("long").alias("id"), numbers.alias("v")).mapInArrow(_encode(kind), "id long, dim int, raw binary"), "vectors")
    valid = rows.where("dim > 0 and id is not null")
    classes = stage(valid.groupBy("dim", "raw").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "dim", "copies", "raw"), "vector-classes")
    common = classes.groupBy("dim").count().where(F.col("count") >= 2 * CELL_ROWS).orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()
    centroids = {}
    for dim, total in common:
        sample = min(SAMPLE_ROWS, max(1, SAMPLE_NUMBERS // dim))
        fit_on = classes.where(F.col("dim") == dim).select("id", "raw").orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # bounded by ``sample``
        centroids[dim] = spherical_kmeans(unit([r["raw"] for r in fit_on], dim, kind), max(1, min(MAX_CELLS, total // CELL_ROWS, len(fit_on))))
    placed = stage(classes.mapInArrow(_assign(centroids, kind, threshold, sigmas), "id long, dim int, copies long, raw binary, cell int, guest boolean"), "vector-cells")
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_NUMBERS) / F.col("dim"))))
    blocks = placed.groupBy("dim", "cell").agg(F.count_if(~F.col("guest")).alias("h"), F.count_if(F.col("guest")).alias("g")).select("dim", "cell", F.ceil(F.col("h") / room).cast("int").alias("homes"), F.ceil(F.col("g") / room).cast("int").alias("guests"))
    split = placed.join(sized(stage(blocks, "vector-blocks")), ["dim", "cell"])
    own = F.pmod(F.xxhash64("id"), F.greatest("homes", F.lit(1))).cast("int")
    visit = F.pmod(F.xxhash64("id"), F.greatest("guests", F.lit(1))).cast("int")
    split = split.withColumn("block", F.when(F.col("guest"), F.col("homes") + visit).otherwise(own))
    # Block i meets every home block j >= i and every guest block; guest blocks don't meet each other.
    low = F.when(F.col("guest"), F.expr("array()").cast("array<int>")).otherwise(F.sequence("block", F.col("homes") + F.col("guests") - 1))
    high = F.when(F.col("guest"), F.when(F.col("homes") > 0, F.sequence(F.lit(0), F.col("homes") - 1)).otherwise(F.expr("array()").cast("array<int>"))).otherwise(F.when(F.col("block") > 0, F.sequence(F.lit(0), F.col("block") - 1)).otherwise(F.expr("array()").cast("array<int>")))
    meets = F.concat(F.transform(low, lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(0).alias("side"))), F.transform(high, lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))))
    columns = ["id", "dim", "copies", "raw"]
    tasks = split.select("cell", *columns, F.explode(meets).alias("m")).select("cell", "m.i", "m.j", "m.side", *columns)
    found = stage(tasks.groupBy("dim", "cell", "i", "j").applyInPandas(_product(kind, threshold), "id long, links long, root long"), "vector-links")
    drop(placed)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = components(found.select("id", "root")).withColumnRenamed("node", "id")
    result = classes.join(links, "id", "left").join(named, "id", "left").select("raw", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    mine = rows.join(result, (rows["raw"] == result["raw"]) & (rows["dim"] > 0) & rows["id"].isNotNull(), "left").select(rows["id"], "copies", "links", "component")
    component = F.coalesce("component", "id")
    return mine.select(F.col("id").alias(id_col), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
