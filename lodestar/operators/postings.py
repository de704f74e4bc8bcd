"""A stored inverted index for BM25, in blocks of postings of like impact.

A posting's impact is what its word adds to a score for a weight of 1; it depends on the
document alone.  Every word's postings are dealt into levels of impact, and a level into blocks
of about ``BLOCK`` documents, so no task ever holds all postings of a common word.  Each level
knows its largest impact.  Files are partitioned by a hash of the word.

A search scores a few blocks of each query first, those of its best levels, for a bound: the k-th of these
scores.  Words that together can't reach the bound (common ones, mostly) bring in no
document; of the others, a level is read only if its largest impact and the largest impacts
of all other words of the query can reach the bound.  Documents of the blocks that are left are
scored exactly, by their counted words.  Whatever is skipped can't be among the first k.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import bm25, scan
from lodestar.operators.search import top_k
from lodestar.staging import sized, stage

#: Levels of impact, and documents of a block.
LEVELS, BLOCK = 32, 256
#: Words of queries that are planned at once.
PLANNED = 20_000
#: Bounds are compared with this much to spare.
SLACK = 1e-6


#: Columns of the tables that are partitioned by ``part``.
_TABLES = {"terms": "term string, df bigint, part int", "levels": "term string, level int, documents bigint, top double, blocks int, part int", "blocks": "term string, level int, block int, ids array<{id}>, part int"}


def _opened(spark: SparkSession, path: str, name: str, kind: str = "bigint") -> DataFrame:
    """One of the partitioned tables, which may have no file."""
    return spark.read.schema(_TABLES[name].format(id=kind)).parquet(f"{path}/{name}")


@dataclass(frozen=True)
class PostingIndex:
    """forward (id, length, words, counts), terms (part, term, df), levels (part, term, level, documents, blocks, top), blocks (part, term, level, block, ids) and one row of totals."""

    forward: DataFrame
    terms: DataFrame
    levels: DataFrame
    blocks: DataFrame
    documents: int
    mean_length: float
    parts: int
    k1: float = 1.5
    b: float = 0.75

    @staticmethod
    def build(documents: DataFrame, path: str, parts: int = 16, k1: float = 1.5, b: float = 0.75) -> PostingIndex:
        """Write the index of ``(id, text)`` with distinct ids to a folder, and open it."""
        spark = documents.sparkSession
        bm25.counted(documents).write.mode("overwrite").parquet(f"{path}/forward")
        forward = spark.read.parquet(f"{path}/forward")
        bm25.totals_of(forward).select("documents", F.coalesce("mean_length", F.lit(0.0)).alias("mean_length"), F.lit(parts).alias("parts"), F.lit(k1).alias("k1"), F.lit(b).alias("b")).write.mode("overwrite").parquet(f"{path}/totals")
        mean = spark.read.parquet(f"{path}/totals").first()["mean_length"]
        part = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part")
        hits = forward.select("id", "length", F.explode(F.arrays_zip("words", "counts")).alias("h")).select("id", F.col("h.words").alias("term"), F.col("h.counts").alias("n"), "length")
        impact = F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("length") / max(mean, 1.0)))
        level = F.least(F.lit(LEVELS - 1), F.floor(F.col("impact") * (LEVELS / (k1 + 1)))).cast("int")
        postings = hits.select(part, "term", "id", impact.alias("impact")).withColumn("level", level)
        per = postings.groupBy("part", "term", "level").agg(F.count(F.lit(1)).alias("documents"), F.max("impact").alias("top"))
        per.withColumn("blocks", F.ceil(F.col("documents") / BLOCK).cast("int")).repartition("part").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/levels")
        levels = _opened(spark, path, "levels")
        levels.groupBy("part", "term").agg(F.sum("documents").alias("df")).repartition("part").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/terms")
        # A level of one block needs no look-up; the others are few.
        many = levels.where("blocks > 1").select("term", "level", "blocks")
        dealt = postings.join(sized(stage(many, "postings-levels")), ["term", "level"], "left")
        block = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block")
        grouped = dealt.select("part", "term", "level", block, "id").groupBy("part", "term", "level", "block").agg(F.collect_list("id").alias("ids"))
        grouped.repartition("part", F.pmod(F.xxhash64("term", "level", "block"), F.lit(4))).sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/blocks")
        return PostingIndex.load(spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> PostingIndex:
        total = spark.read.parquet(f"{path}/totals").first()
        forward = spark.read.parquet(f"{path}/forward")
        kind = dict(forward.dtypes)["id"]
        return PostingIndex(forward, _opened(spark, path, "terms"), _opened(spark, path, "levels"), _opened(spark, path, "blocks", kind), total["documents"], total["mean_length"], total["parts"], total["k1"], total["b"])

    def counted(self) -> bm25.CountedIndex:
        return bm25.CountedIndex(self.forward, self.terms.select("term", "df"), self.documents, self.mean_length, self.k1, self.b)

    def _levels(self, terms: set[str]) -> dict[str, list]:
        """Levels of some words, best first; only their parts of the files are read."""
        spark = self.levels.sparkSession
        words = spark.createDataFrame([(t,) for t in sorted(terms)], "term string").withColumn("part", F.pmod(F.xxhash64("term"), F.lit(self.parts)).cast("int"))
        out: dict[str, list] = {}
        for r in self.levels.join(F.broadcast(words), ["part", "term"], "left_semi").collect():  # ``LEVELS`` rows a word at most
            out.setdefault(r["term"], []).append(r)
        return {t: sorted(rows, key=lambda r: -r["level"]) for t, rows in out.items()}

    def _documents(self, wanted: dict[tuple[str, int], int]) -> DataFrame:
        """Distinct ids of the first so many blocks of each (term, level)."""
        spark = self.blocks.sparkSession
        rows = spark.createDataFrame([(t, lv, n) for (t, lv), n in sorted(wanted.items())], "term string, level int, upto int")
        rows = rows.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(self.parts)).cast("int"))
        found = self.blocks.join(F.broadcast(rows), ["part", "term", "level"]).where("block < upto")
        return found.select(F.explode("ids").alias("id")).distinct()

    def _best(self, wanted: dict[tuple[str, int], int], weights: bm25.Weights, kinds: str, k: int, digits: int | None) -> DataFrame:
        """Exact scores of the documents of some blocks: each query's k best."""
        ids = stage(self._documents(wanted), "postings-found")
        rows = self.forward.join(sized(ids), "id", "left_semi")
        return top_k(bm25.score_counted(rows, weights, bm25.rounded(scan.best(k), digits), kinds), k)

    def _plans(self, queries: DataFrame, k: int, digits: int | None):
        """(weights, blocks to read, blocks that the words have) for some queries at a time."""
        kinds = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(self.forward.dtypes)['id']}, score double"
        for _, rows, weights in bm25.passes(self.counted(), queries, PLANNED):
            levels = self._levels({t for _, t, _ in rows})
            asked: dict[object, list[tuple[str, float]]] = {}
            for q, t, w in rows:
                asked.setdefault(q, []).append((t, w))
            seeds: dict[tuple[str, int], int] = {}
            for mine in asked.values():
                need = k
                for gain, t, r in sorted(((w * r["top"], t, r) for t, w in mine for r in levels[t]), key=lambda x: (-x[0], x[1])):
                    blocks = min(r["blocks"], -(-need * 2 // BLOCK))
                    seeds[t, r["level"]] = max(seeds.get((t, r["level"]), 0), blocks)
                    need -= r["documents"]
                    if need <= 0:
                        break
            bounds = {r["query_id"]: r["score"] for r in self._best(seeds, weights, kinds, k, digits).where(F.col("rank") == k).collect()}  # a row per query
            wanted: dict[tuple[str, int], int] = {}
            for q, mine in asked.items():
                bound = bounds.get(q, 0.0) - SLACK
                tops = sorted((w * levels[t][0]["top"], t, w) for t, w in mine)
                total, below = sum(x for x, _, _ in tops), 0.0
                for top, t, w in tops:
                    below += top
                    if below < bound:  # these words alone can't reach the bound
                        continue
                    for r in levels[t]:
                        if w * r["top"] + total - top >= bound:
                            wanted[t, r["level"]] = r["blocks"]
            yield weights, wanted, sum(r["blocks"] for rows in levels.values() for r in rows), kinds

    def search(self, queries: DataFrame, k: int, digits: int | None = None) -> DataFrame:
        """``(query_id, id, score, rank)``: as ``bm25.search`` over the same documents."""
        out = None
        for weights, wanted, _, kinds in self._plans(queries, k, digits):
            found = self._best(wanted, weights, kinds, k, digits)
            out = found if out is None else out.unionByName(found)
        if out is None:
            return queries.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, id {dict(self.forward.dtypes)['id']}, score double, rank int")
        return out

    def skipped(self, queries: DataFrame, k: int) -> tuple[int, int]:
        """(blocks that a search reads, blocks that the queries' words have)."""
        read = every = 0
        for _, wanted, blocks, _ in self._plans(queries, k, None):
            read, every = read + sum(wanted.values()), every + blocks
        return read, every
