"""Set-similarity join with signature trees.

A document's set is its distinct k-word shingles.  Documents with equal sets are
one class.  A signature tree over a block of classes has, at every node, the OR of
its members' token bitmaps and the range of their set sizes; two nodes can only
hold a linked pair if their ranges are compatible and the bits they share leave
room for the overlap that the threshold asks for.  A dual traversal from the roots
drops every pair of nodes that can't, and sorted sets decide the rest exactly.

Trees are built over pools: classes that share a min-hash band with each other,
directly or through others.  The number of bands is such that a pair at the
threshold is in different pools with probability under ``MISS``.  A pool is one
block, or several with ``BLOCK`` classes each; blocks of a pool meet in pairs, and
a pair of blocks that is already one component isn't visited.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.components import Forest, components
from lodestar.llm.scratch import sized, stage, stage_only
from lodestar.llm.words import WordHashes, give_back, mix, shingles, slices

#: Chance that the bands lose a pair that is exactly at the threshold.
MISS = 1e-9
#: Classes in a block, and words of sets that a block is meant to hold.
BLOCK = 768
BLOCK_SHINGLES = 1_500_000
#: Classes of small pools that one group of rows is meant to hold.
UNIT = 500
FANOUT = 8
#: 64-bit words of bitmaps that a traversal compares at once.
_PAIR_WORDS = 1 << 20


def bands(threshold: float, rows: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**rows))


def band_rows(threshold: float) -> int:
    """Hashes in a band: the more, the less unrelated documents share one."""
    return max(1, min(6, round(math.log(0.35) / math.log(threshold))))


def word_hashes(text: str | None, cache: WordHashes) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased."""
    return cache.of((text or "").encode("utf-8", "surrogatepass").lower().split())


def _sketch(k: int, threshold: float):
    """(id, text) -> id, n_shingles, two fingerprints of the set, band keys."""
    rows = band_rows(threshold)
    count = bands(threshold, rows)
    rng = np.random.default_rng(20_240)
    a = rng.integers(0, 1 << 32, rows * count, np.uint64).astype(np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, rows * count, np.uint64).astype(np.uint32)
    salt = mix(np.arange(1, count + 1, dtype=np.uint64))

    def keys(s: np.ndarray) -> np.ndarray:
        x = (s >> np.uint64(32)).astype(np.uint32)
        low = np.full(rows * count, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 1024):
            h = x[i : i + 1024, None] * a + b
            h ^= h >> np.uint32(15)
            np.minimum(low, h.min(axis=0), out=low)
        out = salt.copy()
        for column in low.reshape(count, rows).T:
            out = mix(out ^ column.astype(np.uint64))
        return out.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches):
            sizes, high, low, found, offsets = [], [], [], [], [0]
            for text in batch.column(1).to_pylist():
                s = shingles(word_hashes(text, cache), k)
                sizes.append(len(s))
                with np.errstate(over="ignore"):
                    high.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                    low.append(int(mix(mix(s) ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                if len(s):
                    found.append(keys(s))
                offsets.append(offsets[-1] + (count if len(s) else 0))
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["id", "n_shingles", "high", "low", "keys"])

    return run


class Tree:
    """Signature tree over sets sorted by size: one OR bitmap and size range per node of each level."""

    def __init__(self, sets: list[np.ndarray], width: int):
        sizes = np.array([len(s) for s in sets], np.int64)
        words = width // 64
        bits = np.zeros((len(sets), words), np.uint64)
        for i, s in enumerate(sets):
            at = (s & np.uint64(width - 1)).astype(np.int64)
            np.bitwise_or.at(bits[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        # spare: members of a set beyond one for each of its bits
        spare = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, spare)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, spare = self.levels[-1]
            cuts = np.arange(0, len(bits), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(spare, cuts)))


def survivors(x: Tree, y: Tree, num: int, den: int, joined=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs of two trees that size ranges and shared bits can't rule out.

    ``joined(level_x, level_y, i, j)`` may say which pairs of nodes need no visit.
    A pair links when ``den * overlap >= num * union``, so with sizes s and t the
    overlap must reach ``num * (s + t) / (num + den)``.
    """
    lx, ly = len(x.levels) - 1, len(y.levels) - 1
    stack = [(lx, ly, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        lx, ly, i, j = stack.pop()
        bx, lox, hix, spx = x.levels[lx]
        by, loy, hiy, spy = y.levels[ly]
        most = np.minimum(hix[i], hiy[j])
        need = num * (lox[i] + loy[j])
        ok = (most * (num + den) >= need) & (hix[i] * den >= loy[j] * num) & (hiy[j] * den >= lox[i] * num)
        if joined is not None:
            ok &= ~joined(lx, ly, i, j)
        i, j, need = i[ok], j[ok], need[ok]
        shared = np.minimum(spx[i], spy[j])
        step = max(1, _PAIR_WORDS // bx.shape[1])
        for at in range(0, len(i), step):
            cut = slice(at, at + step)
            shared[cut] += np.bitwise_count(bx[i[cut]] & by[j[cut]]).sum(axis=1, dtype=np.int64)
        ok = shared * (num + den) >= need
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if lx == 0 and ly == 0:
            yield i, j
            continue
        for part in range(0, len(i), 4096):
            pi, pj = i[part : part + 4096], j[part : part + 4096]
            down_x, down_y = lx > 0 and lx >= ly, ly > 0 and ly >= lx
            if down_x:
                pi, pj = _children(pi, pj, len(x.levels[lx - 1][0]))
            if down_y:
                pj, pi = _children(pj, pi, len(y.levels[ly - 1][0]))
            stack.append((lx - down_x, ly - down_y, pi, pj))


def _children(i: np.ndarray, other: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    child = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    keep = child < below
    return child[keep], np.repeat(other, FANOUT)[keep]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def join_blocks(sets: list[np.ndarray], split: int, known: np.ndarray, num: int, den: int) -> np.ndarray:
    """Root of every set after linking sets [0, split) with the rest, or all among themselves if split is 0.

    ``known`` has the component that each set is in so far; pairs of one component
    are not compared, as their link adds nothing.
    """
    n = len(sets)
    forest = Forest(n)
    first: dict[int, int] = {}
    for i, c in enumerate(known.tolist()):
        forest.join(first.setdefault(c, i), i)
    width = 64
    while width < 4 * max(map(len, sets)):
        width *= 2
    width = min(width, 1 << 15)
    x = Tree(sets[:split] if split else sets, width)
    y = Tree(sets[split:], width) if split else x
    state: dict = {}

    def joined(lx: int, ly: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs whose members are all in one component; in one tree, also what is visited the other way round."""
        if state.get("links") != links:
            roots = forest.roots()
            state.update(links=links, x=_uniform(roots[: split or n], len(x.levels)), y=_uniform(roots[split:], len(y.levels)))
        lo, hi = state["x"][lx]
        lo2, hi2 = state["y"][ly]
        done = (lo[i] == hi[i]) & (lo2[j] == hi2[j]) & (lo[i] == lo2[j])
        return done | (i > j) if split == 0 else done

    links = 0
    for i, j in survivors(x, y, num, den, joined):
        for a, b in zip(i.tolist(), (j + split).tolist()):
            if forest.find(a) != forest.find(b):
                common = overlap(sets[a], sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    links += forest.join(a, b)
    return forest.roots()


def _uniform(roots: np.ndarray, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Smallest and largest root under each node, by level."""
    out = [(roots, roots)]
    for _ in range(levels - 1):
        cuts = np.arange(0, len(out[-1][0]), FANOUT)
        out.append((np.minimum.reduceat(out[-1][0], cuts), np.maximum.reduceat(out[-1][1], cuts)))
    return out


def _link(by: list[str], k: int, num: int, den: int):
    """Blocks or pairs of blocks, told apart by the columns ``by``: id, side, component so far and text in; links (a, b) out."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        cache = WordHashes()
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for _, rows in group.groupby(by, sort=False):
            if len(rows) < 2:
                continue
            sets = [shingles(word_hashes(t, cache), k) for t in rows["text"]]
            rows = rows.drop(columns="text")
            ids, side = rows["id"].to_numpy(), rows["side"].to_numpy()
            order = np.lexsort((ids, [len(s) for s in sets], side))
            split = int((side == 0).sum()) if side.max() else 0
            ids = ids[order]
            roots = join_blocks([sets[i] for i in order], split, rows["component"].to_numpy()[order], num, den)
            hung = roots != np.arange(len(roots))
            out.append((ids[hung], ids[roots[hung]]))
            del sets
        del cache, group
        give_back()
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        return pd.DataFrame({"a": a, "b": b})

    return run


def similar_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``(id_col, n_shingles, component_id)`` per row: groups of documents linked by Jaccard >= num/den.

    Nulls: a null text has no shingles and links with nothing; a row with a null id
    is its own component (null).  Texts without words link with nothing.  Repeated
    rows are in one component.  Components are named by their smallest id.  Ids are
    longs; rows with one id and different texts are one document of several texts.
    """
    threshold = num / den
    docs = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    sketch = stage(docs.mapInArrow(_sketch(k, threshold), "id long, n_shingles long, high long, low long, keys array<long>"), "jaccard-sketch")
    reps = stage_only(lambda: _named(docs, sketch, k, num, den), "jaccard-named")
    # Both sides come from files, so a hot class can be split.
    joined = sketch.select("id", "n_shingles", "high", "low").join(sized(reps), ["high", "low", "n_shingles"], "left")
    return joined.select(F.col("id").alias(id_col), "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component_id"))


def _named(docs: DataFrame, sketch: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``(high, low, n_shingles, component)`` of every class of equal sets."""
    sets = sketch.where("n_shingles > 0 and id is not null")
    classes = stage(sets.groupBy("high", "low", "n_shingles").agg(F.min("id").alias("rep"), F.first("keys").alias("keys")).select("rep", "n_shingles", "keys"), "jaccard-classes")
    entries = classes.select(F.explode("keys").alias("key"), F.col("rep"))
    hubs = entries.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub < top").select("key", "hub")
    hubs = stage(hubs, "jaccard-hubs")  # so that a band that very many classes share can be split in the join
    near = entries.join(hubs, "key").where("rep <> hub").select("rep", "hub").distinct()
    pools = stage(components(near).withColumnRenamed("component", "pool"), "jaccard-pools")
    links = _link_pools(docs, classes, pools, k, num, den)
    found = stage(components(links), "jaccard-components")
    reps = sets.groupBy("high", "low", "n_shingles").agg(F.min("id").alias("rep"))
    return reps.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("high", "low", "n_shingles", F.coalesce("component", "rep").alias("component"))


def _link_pools(docs: DataFrame, classes: DataFrame, pools: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links inside every pool: first within blocks, then between blocks not yet joined."""
    sizes = pools.join(classes.select(F.col("rep").alias("node"), "n_shingles"), "node")
    totals = sizes.groupBy("pool").agg(F.greatest(F.lit(1), F.ceil(F.countDistinct("node") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    where = pools.withColumnRenamed("node", "id").join(sized(stage(totals, "jaccard-totals")), "pool").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    where = stage(where.select("id", "pool", "blocks", "block"), "jaccard-blocks")
    units = max(1, where.count() // UNIT)
    members = docs.where("text is not null").join(sized(where), "id")
    # Small pools share a unit; each block of a large pool is one.
    unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("pool"), F.lit(units))).otherwise(F.xxhash64("pool", "block"))
    within = members.select("id", "pool", "block", "text", F.lit(0).alias("side"), F.col("id").alias("component"), unit.alias("unit"))
    first = stage(within.groupBy("unit").applyInPandas(_link(["pool", "block"], k, num, den), "a long, b long"), "jaccard-links")
    many = where.where("blocks > 1")
    if not many.limit(1).count():
        return first
    # Representatives of the components of a pool's blocks meet first: in most large pools they are all one component.
    part = stage(components(first), "jaccard-parts").withColumnRenamed("node", "id")
    placed = stage(many.join(part, "id", "left").withColumn("component", F.coalesce("component", "id")), "jaccard-placed")
    parts = F.greatest(F.lit(1), F.floor(F.col("blocks") / 8)).cast("long")
    heads = placed.where("component = id").withColumn("slice", F.pmod(F.xxhash64("id", F.lit(1)), parts))
    head_texts = docs.where("text is not null").join(sized(stage(heads, "jaccard-heads")), "id").withColumn("side", F.lit(0))
    second = stage(head_texts.select("id", "pool", "slice", "text", "side", "component").groupBy("pool", "slice").applyInPandas(_link(["pool", "slice"], k, num, den), "a long, b long"), "jaccard-links")
    part = stage(components(first.unionByName(second)), "jaccard-parts").withColumnRenamed("node", "id")
    placed = stage(many.join(part, "id", "left").withColumn("component", F.coalesce("component", "id")), "jaccard-placed")
    state = placed.groupBy("pool", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    one, two = state.toDF("pool", "i", "low", "high"), state.toDF("pool", "j", "low2", "high2")
    todo = stage(one.join(two, "pool").where("i < j and not (low = high and low2 = high2 and low = low2)").select("pool", "i", "j"), "jaccard-todo")
    sides = todo.select("pool", "i", "j", F.lit(0).alias("side"), F.col("i").alias("block")).unionByName(todo.select("pool", "i", "j", F.lit(1).alias("side"), F.col("j").alias("block")))
    rows = docs.where("text is not null").join(sized(placed), "id").select("id", "pool", "block", "text", "component").join(sides, ["pool", "block"])
    third = rows.groupBy("pool", "i", "j").applyInPandas(_link(["pool", "i", "j"], k, num, den), "a long, b long")
    return first.unionByName(second).unionByName(third)
