"""Proximity graph in layers: built by neighbour descent, searched by frontier joins.

A node's level is drawn from a hash of its id, so that each layer has about one node in ``m`` of the layer
below.  Edges are a table ``(layer, src, dst, score)``.  A layer's graph starts from exact
neighbours inside blocks of rows around the same pivots, and gets better by
descent: whoever has a new common neighbour is compared, in blocks, and each row keeps its best.
Until it is done, a row's edges are one list, and lists are merged in groups of rows.

A search moves all queries at once.  The rows of the highest layer in use are few and
scored exactly; from there on a round joins every query's unexpanded candidates with the edges, scores the
new rows and keeps the best ``ef`` of each query, until no query has an unexpanded one.  Rows that are deleted or
filtered out lead on but aren't found.

Vectors of the most common length that are finite take part; others are never found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators import quality, scan, search, store
from lodestar.session import dimension, valid
from lodestar.staging import BROADCAST_ROWS, sized, stage

#: A table of so many rows has one layer.  The highest layer in use of a larger one, which every query is compared with, has at most that many times more.
ENTRY_ROWS, ENTRY_FACTOR = 512, 128
#: Rows of a block that are compared all with all, in the mean (none has over twice as many), and how many blocks a row is in.
BLOCK_ROWS, TABLES = 1536, 12
#: Pivots that blocks are made around, and numbers in them, at most.
PIVOTS, PIVOT_NUMBERS = 4_096, 4_000_000
#: Rows whose lists of edges one group merges; rows of a part that reached pairs are scored with, and pairs scored at once.
MERGED, PART_ROWS, PAIRS = 2_048, 8_192, 65_536
#: Rows whose neighbourhoods one group compares.
CENTRES = 128
#: Descent ends when a round replaces less than this share of the edges.
SETTLED = 0.01
#: Candidates kept in the layers above the lowest, and rounds of a search in a layer at most.
UPPER, STEPS = 8, 32


def _rowwise(metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Scores of rows of two matrices, pair by pair; the larger, the nearer."""

    def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        return np.divide(np.einsum("ij,ij->i", a, b), n, out=np.zeros(len(a)), where=n > 0)

    known = {"cosine": cosine, "dot": lambda a, b: np.einsum("ij,ij->i", a, b), "l2": lambda a, b: -np.sqrt(((a - b) ** 2).sum(1))}
    if metric not in known:
        raise ValueError(f"a graph has no metric {metric!r}")
    return known[metric]


def score_pairs(pairs: DataFrame, metric: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``score`` of pairs with vectors ``a`` and ``b``, all of one length and finite."""
    one = _rowwise(metric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (batch.column(batch.num_columns - i).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) for i in (2, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(one(a, b))], [*keep, "score"])

    rows = pairs.select(*keep, "a", "b")
    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes[:-2]) + ", score double")


def held_queries(asked: DataFrame) -> tuple[pa.Array, np.ndarray] | None:
    """Ids and vectors of queries, all of one length and finite, where they can go to every task within the bounds of ``scan``."""
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("query")), F.lit(0)).alias("numbers")).first()
    if not size["n"] or size["n"] > scan.QUERY_ROWS * scan.HELD_BLOCKS or size["numbers"] > scan.QUERY_NUMBERS:
        return None
    rows = asked.select("query_id", "query").collect()  # within both bounds
    return pa.array([r["query_id"] for r in rows], scan.ARROW.get(dict(asked.dtypes)["query_id"])), np.array([r["query"] for r in rows], np.float32)


def score_parts(pairs: DataFrame, rows: DataFrame, count: int, names: pa.Array, queries: np.ndarray, metric: str) -> DataFrame:
    """``(query_id, id, score, _ok)`` of pairs (query_id, id): pairs meet packed rows (id, vec, _ok), of their own lengths, in parts of rows, so a vector moves once for all its pairs."""
    one, kinds = _rowwise(metric), dict(pairs.dtypes)

    def meet(asked: pa.Table, db: pa.Table) -> pa.Table:
        if not asked.num_rows or not db.num_rows:
            return pa.Table.from_arrays([asked.column(0).slice(0, 0), asked.column(1).slice(0, 0), pa.array([], pa.float64()), pa.array([], pa.bool_())], ["query_id", "id", "score", "_ok"])
        ids, x = _vectors(db)
        at = pc.index_in(asked.column("id").combine_chunks(), value_set=ids).to_numpy(zero_copy_only=False)
        query = pc.index_in(asked.column("query_id").combine_chunks(), value_set=names).to_numpy(zero_copy_only=False)
        slices = [slice(lo, lo + PAIRS) for lo in range(0, len(at), PAIRS)]
        scores = np.concatenate([one(queries[query[s]].astype(np.float64), x[at[s]].astype(np.float64)) for s in slices])
        return pa.Table.from_arrays([asked.column("query_id"), asked.column("id"), pa.array(scores), db.column("_ok").take(pa.array(at))], ["query_id", "id", "score", "_ok"])

    part = F.pmod(F.xxhash64("id"), F.lit(max(1, ceil(count / PART_ROWS)))).cast("int")
    left, right = pairs.select("query_id", "id", part.alias("part")), rows.select("id", "vec", "_ok", part.alias("part"))
    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(meet, f"query_id {kinds['query_id']}, id {kinds['id']}, score double, _ok boolean")


def _flat(lists: pa.ChunkedArray) -> pa.Array:
    return lists.combine_chunks().flatten()


def _listed(src: pa.Array, row: np.ndarray, *columns: pa.Array) -> list[pa.Array]:
    """``src`` of each run of equal numbers in ``row``, and the columns as a list for each."""
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    offsets = pa.array(np.append(starts, len(row)).astype(np.int32))
    return [src.take(pa.array(row[starts])), *(pa.ListArray.from_arrays(offsets, c) for c in columns)]


def _list_schema(nodes: DataFrame, fresh: str) -> str:
    kind = dict(nodes.dtypes)["id"]
    return f"src {kind}, dst array<{kind}>, score array<double>, fresh {fresh}"


def as_lists(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, score) as lists of one, all fresh."""
    return edges.select("src", F.array("dst").alias("dst"), F.array("score").alias("score"), F.lit(True).alias("fresh"))


def best_lists(lists: DataFrame, count: int, degree: int) -> DataFrame:
    """The ``degree`` best distinct edges of each row, from any number of lists of a row; ties go to smaller ids.

    A list is fresh or not as a whole; an edge of the result is fresh if it is in fresh lists only.
    """
    kind = dict(lists.dtypes)["src"]

    def merge(group: pa.Table) -> pa.Table:
        each = np.diff(group.column("dst").combine_chunks().offsets.to_numpy())
        names, src = np.unique(group.column("src").to_numpy(), return_inverse=True)
        src, fresh = np.repeat(src, each), np.repeat(group.column("fresh").to_numpy(), each)
        ids, score = _flat(group.column("dst")), _flat(group.column("score")).to_numpy()
        dst = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        edge = src * (dst.max() + 1) + dst
        at = np.argsort(2 * edge + fresh)  # of an edge's copies, known ones first
        at = at[np.diff(edge[at], prepend=-1) != 0]
        at = at[np.argsort(-score[at], kind="stable")]
        at = at[np.argsort(src[at].astype(np.uint16 if len(names) < 1 << 16 else np.int64), kind="stable")]
        starts = np.flatnonzero(np.diff(src[at], prepend=-1))
        at = at[np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at)))) < degree]
        columns = _listed(pa.array(names, group.schema.field("src").type), src[at], ids.take(pa.array(at)), pa.array(score[at]), pa.array(fresh[at]))
        return pa.Table.from_arrays(columns, ["src", "dst", "score", "fresh"])

    bucket = F.pmod(F.xxhash64("src"), F.lit(max(1, ceil(count / MERGED)))).cast("int").alias("bucket")
    rows = lists.where(F.size("dst") > 0).select("src", "dst", "score", "fresh", bucket)
    return rows.groupBy("bucket").applyInArrow(merge, f"src {kind}, dst array<{kind}>, score array<double>, fresh array<boolean>")


def _top_per_row(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best finite scores of each row."""
    if scores.shape[1] > k:
        at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    else:
        at = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    row, col = np.repeat(np.arange(len(scores)), at.shape[1]), at.ravel()
    found = scores[row, col] > -np.inf
    return row[found], col[found]


def packed(rows: DataFrame, unit: bool = False) -> DataFrame:
    """``rows`` (id, vec, ...) with each vec as the bytes of its numbers, which move faster than a list; with ``unit``, of length 1."""
    names = rows.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, at, x in scan.by_length(batch.column("vec")):
                out = batch.take(pa.array(at))
                vec = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * n), len(at), [None, pa.py_buffer((_unit(x) if unit else x).astype(np.float32))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([vec if c == "vec" else out.column(c) for c in names], names)

    return rows.mapInArrow(pack, ", ".join(f"{c} {'binary' if c == 'vec' else t}" for c, t in rows.dtypes))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _packed_scorer(metric: str) -> scan.Scorer:
    """Scores of packed rows: of cosine, products in single precision."""
    score = scan.scorer(metric)
    return (lambda x, q: x @ q.T) if metric == "cosine" else (lambda x, q: score(x.astype(np.float64), q.astype(np.float64)))


def _vectors(group: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """Ids and matrix of packed rows, all of one length."""
    vec = group.column("vec").combine_chunks()
    offsets = np.frombuffer(vec.buffers()[1], np.int32)[vec.offset : vec.offset + len(vec) + 1] if len(vec) else np.zeros(1, np.int32)
    x = np.frombuffer(vec.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float32) if len(vec) else np.zeros(0, np.float32)
    return group.column("id").combine_chunks(), x.reshape(len(vec), -1)


def _pivots(nodes: DataFrame, count: int, dims: int, metric: str, seed: int) -> np.ndarray:
    """Distinct vectors of rows drawn by a hash of the id, so many that a block has ``BLOCK_ROWS`` rows in the mean, within the bounds of pivots."""
    most = max(1, min(PIVOTS, PIVOT_NUMBERS // dims, ceil(count * TABLES / BLOCK_ROWS)))
    drawn = nodes.select("id", "vec", F.xxhash64("id", F.lit(seed)).alias("_h")).orderBy("_h", "id").limit(most)
    x = np.unique(np.array([np.frombuffer(r["vec"], np.float32) for r in drawn.select("vec").collect()]), axis=0)
    return x if metric == "l2" else _unit(x)


def block_edges(nodes: DataFrame, count: int, dims: int, degree: int, metric: str, seed: int) -> DataFrame:
    """Lists of exact neighbours of packed rows inside blocks: a row is in the blocks of its ``TABLES`` nearest pivots, dealt by a hash where those are too large."""
    pivots = _pivots(nodes, count, dims, metric, seed) if count > 2 * BLOCK_ROWS else np.zeros((1, dims), np.float32)
    kind, tables = dict(nodes.dtypes)["id"], min(TABLES, len(pivots))
    score, near = _packed_scorer(metric), scan.scorer("l2") if metric == "l2" else lambda x, q: x @ q.T

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(pa.Table.from_batches([batch]))[1]
            for s in scan.row_slices(x, len(pivots)):
                row, side = _top_per_row(near(x[s], pivots), tables)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row + s.start)).columns, pa.array(side)], ["id", "vec", "side"])

    dealt = nodes.select("id", "vec").mapInArrow(deal, f"id {kind}, vec binary, side long")
    sizes = stage(dealt.groupBy("side").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK_ROWS)).cast("int").alias("parts")), "graph-sides")
    blocks = dealt.join(sized(sizes), "side").withColumn("part", F.pmod(F.xxhash64("id", "side"), F.col("parts")).cast("int")).drop("parts")

    def nearest(group: pa.Table) -> pa.Table:
        ids, x = _vectors(group)
        rows, cols, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        step = max(1, scan.SCORES // len(x))
        for lo in range(0, len(x), step):
            s = score(x[lo : lo + step], x)
            s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
            row, col = _top_per_row(s, degree)
            rows.append(row + lo)
            cols.append(col)
            scores.append(s[row, col])
        columns = _listed(ids, np.concatenate(rows), ids.take(pa.array(np.concatenate(cols))), pa.array(np.concatenate(scores).astype(np.float64)))
        return pa.Table.from_arrays([*columns, pa.array(np.ones(len(columns[0]), bool))], ["src", "dst", "score", "fresh"])

    return blocks.groupBy("side", "part").applyInArrow(nearest, _list_schema(nodes, "boolean"))


def descend(nodes: DataFrame, lists: DataFrame, count: int, degree: int, metric: str, rounds: int) -> DataFrame:
    """Better lists of edges of packed rows (staged): each round compares the neighbours, in either direction, of every row with one another.

    Two rows that both were neighbours of a row in the round before have been compared; they aren't again.
    """
    score, schema = _packed_scorer(metric), _list_schema(nodes, "boolean")
    cells = max(1, ceil(count / CENTRES))

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("centre")
        ids, x = _vectors(group)
        worst, fresh = group.column("worst").to_numpy(), group.column("fresh").to_numpy()
        codes = group.column("centre").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate([np.flatnonzero(np.diff(codes, prepend=-1)), [len(codes)]])
        rows, cols, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for lo, hi in zip(ends[:-1], ends[1:]):
            new = fresh[lo:hi]
            if not new.any():
                continue
            s = score(x[lo:hi], x[lo:hi])
            np.fill_diagonal(s, -np.inf)
            s[(s <= worst[lo:hi, None]) | ~(new[:, None] | new)] = -np.inf  # no better than what the row has, or compared before
            row, col = _top_per_row(s, degree)
            rows.append(row + lo)
            cols.append(col + lo)
            scores.append(s[row, col])
        columns = _listed(ids, np.concatenate(rows), ids.take(pa.array(np.concatenate(cols))), pa.array(np.concatenate(scores).astype(np.float64)))
        return pa.Table.from_arrays([*columns, pa.array(np.ones(len(columns[0]), bool))], ["src", "dst", "score", "fresh"])

    lists = stage(best_lists(lists, count, degree), "graph-lists")
    for i in range(rounds):
        worst = F.when(F.size("dst") >= degree, F.array_min("score")).otherwise(float("-inf"))
        known = nodes.select("id", "vec").join(lists.select(F.col("src").alias("id"), worst.alias("worst")), "id", "left").fillna(float("-inf"), ["worst"])
        edges = lists.select("src", F.explode(F.arrays_zip("dst", "fresh")).alias("e")).select("src", "e.dst", "e.fresh")
        back = Window.partitionBy("dst").orderBy(F.xxhash64("src", F.lit(i)), "src")  # of many that point at a row, as many as it points at
        into = edges.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= degree)
        links = edges.select(F.col("src").alias("centre"), F.col("dst").alias("id"), "fresh").union(into.select("dst", "src", "fresh"))
        links = links.union(nodes.select("id", "id", F.lit(False))).groupBy("centre", "id").agg(F.max("fresh").alias("fresh"))
        cell = F.pmod(F.xxhash64("centre"), F.lit(cells)).cast("int").alias("cell")
        found = links.join(known, "id").select(cell, "centre", "id", "vec", "worst", "fresh").groupBy("cell").applyInArrow(compare, schema)
        lists = stage(best_lists(lists.withColumn("fresh", F.lit(False)).unionByName(found), count, degree), "graph-lists")
        size = lists.agg(F.sum(F.size("dst")).alias("n"), F.sum(F.size(F.filter("fresh", lambda x: x))).alias("new")).first()
        if not size["n"] or size["new"] <= SETTLED * size["n"]:
            break
    return lists


def both_ways(nodes: DataFrame, lists: DataFrame, count: int, degree: int) -> DataFrame:
    """Edges in both directions, the ``degree`` best of each row, and one edge into each row that none leads to."""
    back = lists.select("src", F.explode(F.arrays_zip("dst", "score")).alias("e")).select(F.col("e.dst").alias("src"), F.col("src").alias("dst"), "e.score")
    every = best_lists(lists.withColumn("fresh", F.lit(True)).unionByName(as_lists(back)), count, degree)
    kept = stage(every.select("src", F.explode(F.arrays_zip("dst", "score")).alias("e")).select("src", "e.dst", "e.score"), "graph-kept")
    # of copies, which are equally near, lost rows hang on different ones
    lost = nodes.select("id").join(kept.select(F.col("dst").alias("id")), "id", "left_anti")
    first = kept.join(lost, F.col("src") == F.col("id")).groupBy("src").agg(F.max_by("dst", F.struct("score", F.xxhash64("src", "dst"))).alias("dst"), F.max("score").alias("score"))
    return kept.unionByName(first.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"))


@dataclass(frozen=True)
class GraphIndex:
    """nodes (id, vec, level, ...), edges (layer, src, dst, score) and tombstones; every change returns a new index."""

    nodes: DataFrame
    edges: DataFrame
    top: int
    m: int = 16
    metric: str = "cosine"
    rounds: int = 6
    seed: int = 0
    tombstones: DataFrame | None = None

    @staticmethod
    def build(df: DataFrame, m: int = 16, metric: str = "cosine", rounds: int = 6, seed: int = 0) -> GraphIndex:
        """Distinct ids that aren't null; a table without a finite vector is an error."""
        nodes = stage(GraphIndex._levelled(df, dimension(df), m, seed), "graph-nodes")
        index = GraphIndex(nodes, nodes.limit(0), 0, m, metric, rounds, seed)
        return index._with_layers({})

    @staticmethod
    def _levelled(df: DataFrame, dims: int, m: int, seed: int) -> DataFrame:
        u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 31)) + 0.5) / (1 << 31)
        rows = valid(df.withColumn("vec", F.col("vec").cast("array<float>")), dims).where("id is not null")
        return rows.drop("level").withColumn("level", F.floor(-F.log(u) / log(max(m, 2))).cast("int"))

    def _with_layers(self, known: dict[int, DataFrame]) -> GraphIndex:
        """The index with edges of all layers in use; ``known`` has edges to start from instead of blocks."""
        sizes = {r["level"]: r["count"] for r in self.nodes.groupBy("level").count().collect()}  # a row per level
        if not sizes:
            raise ValueError("no finite vector for a graph")
        at_least = [sum(n for lv, n in sizes.items() if lv >= layer) for layer in range(max(sizes) + 1)]
        top = next((layer for layer, n in enumerate(at_least) if n <= ENTRY_ROWS * (ENTRY_FACTOR if layer else 1)), len(at_least) - 1)
        dims, out = dimension(self.nodes), None
        for layer in range(top + 1):
            nodes = stage(packed(self.nodes.where(F.col("level") >= layer).select("id", "vec"), self.metric == "cosine"), "graph-packed")
            start = known.get(layer)
            blocks = block_edges(nodes, at_least[layer], dims, self.m, self.metric, self.seed + layer)
            start = blocks if start is None else as_lists(start).unionByName(blocks)
            made = descend(nodes, start, at_least[layer], self.m, self.metric, self.rounds)
            made = both_ways(nodes, made, at_least[layer], self.m if layer else 2 * self.m).select(F.lit(layer).alias("layer"), "src", "dst", "score")
            out = made if out is None else out.unionByName(made)
        return replace(self, edges=stage(out, "graph-layers"), top=top)

    def alive(self) -> DataFrame:
        return self.nodes if self.tombstones is None else store.alive(self.nodes, self.tombstones)

    def delete(self, ids: DataFrame) -> GraphIndex:
        """Rows that are no longer found but still lead on, until ``compact``."""
        return replace(self, tombstones=stage(store.tombstone(self.tombstones, ids), "graph-tombstones"))

    def add(self, df: DataFrame) -> GraphIndex:
        """Insert rows, or replace those with known ids; a deleted id lives again.

        New rows look for their neighbours in the graph as it is; these edges and the old ones are where the descent starts.
        """
        new = stage(self._levelled(df, dimension(self.nodes), self.m, self.seed).select(self.nodes.columns), "graph-new")
        near = self.search(new.select(F.col("id").alias("query_id"), F.col("vec").alias("query")), self.m + 1, 4 * self.m)
        seeds = near.where("query_id <> id").select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "score")
        old = self.edges.where("layer = 0").drop("layer")
        for c in ("src", "dst"):
            old = old.join(new.select(F.col("id").alias(c)), c, "left_anti")
            seeds = seeds.join(new.select(F.col("id").alias(c)), c, "left_anti") if c == "dst" else seeds
        nodes = stage(store.write(self.nodes, new, "overwrite"), "graph-nodes")
        dead = None if self.tombstones is None else stage(store.delete(self.tombstones, new), "graph-tombstones")
        start = old.select("src", "dst", "score").unionByName(seeds).unionByName(seeds.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"))
        return replace(self, nodes=nodes, tombstones=dead)._with_layers({0: start})

    def compact(self) -> GraphIndex:
        """Without the deleted rows: whoever pointed at one points at what that pointed at, and rows that nothing leads to get an edge again."""
        if self.tombstones is None:
            return self
        nodes = stage(self.alive(), "graph-nodes")
        base = self.edges.where("layer = 0").select("src", "dst", "score")
        live = base.join(self.tombstones.select(F.col("id").alias("src")), "src", "left_anti")
        kept = live.join(self.tombstones.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst", "score")
        into = live.join(self.tombstones.select(F.col("id").alias("dst")), "dst").select("src", F.col("dst").alias("gone"))
        out = base.join(self.tombstones.select(F.col("id").alias("src")), "src").select(F.col("src").alias("gone"), "dst")
        out = out.join(self.tombstones.select(F.col("id").alias("dst")), "dst", "left_anti")
        bridged = into.join(out, "gone").where("src <> dst").select("src", "dst").distinct()
        vec = nodes.select(F.col("id"), F.col("vec"))
        pairs = bridged.join(vec.toDF("src", "a"), "src").join(vec.toDF("dst", "b"), "dst")
        return replace(self, nodes=nodes, tombstones=None)._with_layers({0: kept.unionByName(score_pairs(pairs, self.metric, ["src", "dst"]))})

    def search(self, queries: DataFrame, k: int = 10, ef: int = 64, where: Column | None = None) -> DataFrame:
        """``(query_id, id, score, rank)``: about the k nearest rows that live and pass ``where``.

        ``ef`` is how many candidates a query keeps.  Queries that are null, not finite or of another length find
        nothing.  A query for which the walk finds fewer than k such rows, as under a narrow filter,
        is answered by exact search.
        """
        live = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        rows = self.nodes.withColumn("_ok", live)
        if self.tombstones is not None:
            rows = rows.join(self.tombstones.select("id", F.lit(True).alias("_dead")), "id", "left").withColumn("_ok", F.col("_ok") & F.col("_dead").isNull())
        rows = rows.select("id", "vec", "_ok")
        asked = stage(valid(queries.select("query_id", F.col("query").cast("array<float>").alias("query")), dimension(self.nodes), "query"), "graph-queries")
        held = held_queries(asked)
        parts = None if held is None else stage(packed(rows), "graph-packed")
        entry = self.nodes.where(F.col("level") >= self.top).select("id", "vec")
        width = max(ef, k) if self.top == 0 else UPPER
        beam = search.knn(asked, entry, width, self.metric).select("query_id", "id", "score")
        beam = stage(beam.join(rows.select("id", "_ok"), "id").select("query_id", "id", "score", "_ok", F.lit(False).alias("done"), F.lit(True).alias("near")), "graph-beam")
        for layer in range(self.top - 1 if self.top else 0, -1, -1):
            beam = self._walk(asked, held, rows, parts, beam, layer, max(ef, k) if layer == 0 else UPPER, k)
            if layer:
                beam = beam.withColumn("done", F.lit(False))
        found = search.top_k(beam.where("_ok").select("query_id", "id", "score"), k)
        if where is None and self.tombstones is None:
            return found
        found = stage(found, "graph-found")
        short = asked.join(found.where(F.col("rank") == k).select("query_id"), "query_id", "left_anti")
        exact = search.knn(short, rows.where("_ok").select("id", "vec"), k, self.metric)
        return found.join(short.select("query_id"), "query_id", "left_anti").unionByName(exact)

    def _walk(self, asked: DataFrame, held: tuple[pa.Array, np.ndarray] | None, rows: DataFrame, parts: DataFrame | None, beam: DataFrame, layer: int, width: int, k: int) -> DataFrame:
        """Rounds in one layer: the ``width`` best of each query (``near``) and its k best that may be found."""
        edges = self.edges.where(F.col("layer") == layer).select("src", "dst")
        count = 0 if parts is None else parts.count()
        for _ in range(STEPS):
            front = beam.where("near and not done").select("query_id", F.col("id").alias("src"))
            n = front.count()
            if not n:
                break
            few = n * 4 * self.m <= BROADCAST_ROWS  # and so is what they reach, at twice the degree of the lowest layer
            reached = edges.join(F.broadcast(front) if few else front, "src").select("query_id", F.col("dst").alias("id")).distinct()
            reached = reached.join(beam.select("query_id", "id"), ["query_id", "id"], "left_anti")
            if few or held is None:
                pairs = rows.join(F.broadcast(reached) if few else reached, "id").join(sized(asked), "query_id").withColumnsRenamed({"query": "a", "vec": "b"})
                scored = score_pairs(pairs, self.metric, ["query_id", "id", "_ok"])
            else:
                scored = score_parts(reached, parts, count, *held, self.metric)
            scored = scored.select("query_id", "id", "score", "_ok", F.lit(False).alias("done"))
            every = beam.select("query_id", "id", "score", "_ok", (F.col("done") | F.col("near")).alias("done")).unionByName(scored)
            w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
            ranked = every.withColumn("_n", F.row_number().over(w)).withColumn("_m", F.sum(F.col("_ok").cast("int")).over(w))
            beam = stage(ranked.where((F.col("_n") <= width) | (F.col("_ok") & (F.col("_m") <= k))).select("query_id", "id", "score", "_ok", "done", (F.col("_n") <= width).alias("near")), "graph-beam")
        return beam

    def stats(self) -> DataFrame:
        """``(layer, nodes, edges, mean_degree, max_degree, orphans)`` per layer; orphans are rows that no edge leads to."""
        layers = self.edges.sparkSession.range(self.top + 1).select(F.col("id").cast("int").alias("layer"))
        each = self.nodes.join(F.broadcast(layers), F.col("level") >= F.col("layer")).select("layer", "id")
        out = self.edges.groupBy("layer", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out"))
        into = self.edges.groupBy("layer", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("into"))
        rows = each.join(out, ["layer", "id"], "left").join(into, ["layer", "id"], "left")
        return rows.groupBy("layer").agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("out"), F.lit(0)).alias("edges"), (F.coalesce(F.sum("out"), F.lit(0)) / F.count(F.lit(1))).alias("mean_degree"), F.coalesce(F.max("out"), F.lit(0)).alias("max_degree"), F.count_if(F.col("into").isNull()).alias("orphans"))

    def totals(self) -> DataFrame:
        """One row: total, alive, deleted, top."""
        dead = 0 if self.tombstones is None else search.by_ids(self.nodes, self.tombstones).count()
        return self.nodes.agg(F.count(F.lit(1)).alias("total")).select("total", (F.col("total") - dead).alias("alive"), F.lit(dead).cast("long").alias("deleted"), F.lit(self.top).alias("top"))

    def recall_estimate(self, queries: DataFrame, k: int = 10, ef: int = 64) -> DataFrame:
        """Recall of some queries against exact search, with its 95 % interval."""
        truth = search.knn(queries, self.alive().select("id", "vec"), k, self.metric)
        return quality.recall_estimate(quality.recall(truth, self.search(queries, k, ef), k), k)

    def save(self, path: str) -> None:
        """Nodes, edges by layer, and tombstones; ``load`` gives the same index."""
        spark = self.nodes.sparkSession
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")
        (self.nodes.select("id").limit(0) if self.tombstones is None else self.tombstones).write.mode("overwrite").parquet(f"{path}/tombstones")
        spark.createDataFrame([(self.top, self.m, self.metric, self.rounds, self.seed, self.tombstones is not None)], "top int, m int, metric string, rounds int, seed long, dead boolean").write.mode("overwrite").parquet(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> GraphIndex:
        s = spark.read.parquet(f"{path}/settings").first()
        dead = spark.read.parquet(f"{path}/tombstones") if s["dead"] else None
        return GraphIndex(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), s["top"], s["m"], s["metric"], s["rounds"], s["seed"], dead)
