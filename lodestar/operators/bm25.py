"""BM25 over a table of documents.

Texts are cut into words once, inside tasks, and what is staged of a document is its
length and the counts of the words that queries ask for.  Document frequencies and totals
are aggregates of that small table, and scores are made where its rows are read: a task
knows the weights of all queries' words, and keeps the best k documents for each query,
so no row per query and document of a common word is shuffled.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import SPACE, robertson_idf, tokens
from lodestar.operators import scan
from lodestar.operators.search import top_k
from lodestar.staging import stage

#: Pairs of a query and one of its words that a task knows at once; more queries are scored in several passes over the counted words.
WEIGHTS = 200_000
#: Scores that a task holds at once, and contributions of words to them.
CELLS, PARTS = 2_000_000, 4_000_000

_SPACES = re.compile(re.sub(r"x\{(\w+)\}", lambda m: f"u{int(m[1], 16):04x}", SPACE))


def words_of(text: str | None) -> list[str]:
    """As ``functions.text.tokens``."""
    cut = (w.strip(string.punctuation) for w in _SPACES.split((text or "").lower()))
    return [w for w in cut if w]


#: White space to ``str.split`` that ``SPACE`` leaves in words.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def word_counts(text: str | None) -> dict[str, int]:
    """How often a text has each of its words, in the order of their first places; as a count of ``words_of``.

    Pieces between white space are counted before they are stripped, so each distinct one is stripped once.
    """
    low = (text or "").lower()
    out: dict[str, int] = {}
    for piece, n in Counter(_SPACES.split(low) if _SEPARATORS.search(low) else low.split()).items():
        if word := piece.strip(string.punctuation):
            out[word] = out.get(word, 0) + n
    return out


def _count(keep: frozenset[str] | None):
    """(id, text) -> (id, length, words, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, sizes, words, counts = [], [0], [], []
            for text in batch.column(1).to_pylist():
                found = word_counts(text)
                lengths.append(sum(found.values()))
                if keep is not None:
                    found = {w: n for w, n in found.items() if w in keep}
                words.extend(found)
                counts.extend(found.values())
                sizes.append(len(words))
            at = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(at, pa.array(words, pa.string())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int32()))], ["id", "length", "words", "counts"])

    return run


def counted(documents: DataFrame, keep: frozenset[str] | None = None) -> DataFrame:
    """``(id, length, words, counts)`` of each document: how often it has each of its words, or of those in ``keep``."""
    schema = T.StructType([documents.schema["id"], T.StructField("length", T.LongType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    return documents.select("id", "text").mapInArrow(_count(keep), schema)


def frequencies(forward: DataFrame) -> DataFrame:
    """``(term, df)`` of counted documents."""
    return forward.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def totals_of(forward: DataFrame) -> DataFrame:
    """One row: documents, mean_length."""
    return forward.agg(F.count(F.lit(1)).alias("documents"), F.avg("length").alias("mean_length"))


@dataclass(frozen=True)
class Index:
    """documents (id, text) and, when asked for, tf (id, term, n), terms (term, df, idf) and one row of totals (documents, mean_length)."""

    documents: DataFrame
    k1: float = 1.5
    b: float = 0.75

    def forward(self, keep: frozenset[str] | None = None) -> DataFrame:
        """Counted documents, written once."""
        return stage(counted(self.documents, keep), "bm25-counted")

    def frequencies(self, forward: DataFrame) -> DataFrame:
        return frequencies(forward)

    def total(self, forward: DataFrame) -> tuple[int, float]:
        """Number of documents and their mean length."""
        row = totals_of(forward).first()
        return row["documents"], row["mean_length"] or 0.0

    @property
    def tf(self) -> DataFrame:
        hits = counted(self.documents).select("id", F.explode(F.arrays_zip("words", "counts")).alias("h"))
        return hits.select("id", F.col("h.words").alias("term"), F.col("h.counts").cast("long").alias("n"))

    @property
    def totals(self) -> DataFrame:
        return totals_of(counted(self.documents, frozenset()))

    @property
    def terms(self) -> DataFrame:
        size = self.documents.agg(F.count(F.lit(1)).alias("documents"))
        return frequencies(counted(self.documents)).crossJoin(F.broadcast(size)).select("term", "df", robertson_idf(F.col("df"), F.col("documents")).alias("idf"))  # one row of totals


@dataclass(frozen=True)
class CountedIndex:
    """An index over counted documents (id, length, words, counts) whose statistics are known: (term, df), and the number of documents and their mean length."""

    counted: DataFrame
    known: DataFrame
    documents: int
    mean_length: float
    k1: float = 1.5
    b: float = 0.75

    def forward(self, keep: frozenset[str] | None = None) -> DataFrame:
        return self.counted

    def frequencies(self, forward: DataFrame) -> DataFrame:
        return self.known

    def total(self, forward: DataFrame) -> tuple[int, float]:
        return self.documents, self.mean_length


def build(documents: DataFrame, k1: float = 1.5, b: float = 0.75) -> Index:
    """Index of ``(id, text)`` with distinct ids that aren't null; a document without tokens has length 0 and is found by no query."""
    return Index(documents.select("id", "text"), k1, b)


def asked_words(queries: DataFrame) -> DataFrame:
    """``(query_id, term, times)`` of queries ``(query_id, text)``."""
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


@dataclass(frozen=True)
class Weights:
    """What a task knows of some queries: for every term, which of them ask for it and with what weight."""

    names: pa.Array
    terms: pa.Array
    starts: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    mean_length: float
    k1: float
    b: float

    @staticmethod
    def of(rows: list[tuple], kind: pa.DataType | None, mean_length: float, k1: float, b: float) -> Weights:
        """From (query_id, term, weight) rows."""
        rows = sorted(rows, key=lambda r: (r[1], str(r[0])))
        names = list(dict.fromkeys(r[0] for r in rows))
        number = {q: i for i, q in enumerate(names)}
        terms = list(dict.fromkeys(r[1] for r in rows))
        sizes = Counter(r[1] for r in rows)
        starts = np.concatenate([[0], np.cumsum([sizes[t] for t in terms])]).astype(np.int64)
        return Weights(pa.array(names, kind), pa.array(terms, pa.string()), starts, np.array([number[r[0]] for r in rows], np.int64), np.array([r[2] for r in rows], np.float64), mean_length, k1, b)

    def blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """(rows, their scores for every query) of counted documents, in blocks of bounded size."""
        lists = batch.column(batch.schema.get_field_index("words"))
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        term = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        n = batch.column(batch.schema.get_field_index("counts")).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.float64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        known = term >= 0
        row, term, n = row[known], term[known], n[known]
        part = n * (self.k1 + 1) / (n + self.k1 * (1 - self.b + self.b * length[row] / max(self.mean_length, 1.0)))
        many = self.starts[term + 1] - self.starts[term]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, weights=many, minlength=len(sizes)))])
        at, width = 0, max(1, len(self.names))
        while at < len(sizes):
            stop = int(np.searchsorted(ends, ends[at] + PARTS, "right")) - 1
            stop = min(len(sizes), max(at + 1, min(stop, at + max(1, CELLS // width))))
            lo, hi = np.searchsorted(row, [at, stop])
            count = many[lo:hi]
            where = np.repeat(self.starts[term[lo:hi]] - np.cumsum(count) + count, count) + np.arange(count.sum())
            cell = np.repeat(row[lo:hi] - at, count) * width + self.query[where]
            scores = np.bincount(cell, weights=np.repeat(part[lo:hi], count) * self.weight[where], minlength=(stop - at) * width)
            yield batch.slice(at, stop - at), scores.reshape(stop - at, width)
            at = stop


def weighed(asked: list, terms: dict[str, int], documents: int) -> list[tuple]:
    """(query_id, term, weight) of asked words that documents have: times asked, times the word's rarity."""
    return [(q, t, times * float(np.log((documents - terms[t] + 0.5) / (terms[t] + 0.5) + 1))) for q, t, times in asked if t in terms]


def score_counted(forward: DataFrame, weights: Weights, reduce: scan.Reducer, kinds: str) -> DataFrame:
    """What ``reduce`` makes of each task's positive scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, scores in weights.blocks(batch):
                yield reduce(weights.names, rows.column(0), np.where(scores > 0, scores, -np.inf))

    return forward.mapInArrow(run, kinds)


def passes(index: Index | CountedIndex, queries: DataFrame, size: int = WEIGHTS) -> Iterator[tuple[DataFrame, list[tuple], Weights]]:
    """(counted documents, (query_id, term, weight) rows, weights) for some queries at a time, about ``size`` words of them."""
    asked = stage(asked_words(queries), "bm25-asked")
    many = -(-asked.count() // size)
    group = F.pmod(F.xxhash64("query_id"), F.lit(max(many, 1)))
    kind = scan.ARROW.get(dict(queries.dtypes)["query_id"])
    forward = total = None
    for i in range(many):
        own = asked if many == 1 else asked.where(group == i)
        mine = [tuple(r) for r in own.collect()]  # about ``size``
        if forward is None:
            forward = index.forward(frozenset(t for _, t, _ in mine) if many == 1 else None)
            total = index.total(forward)
        terms = index.frequencies(forward).join(F.broadcast(own.select("term").distinct()), "term", "left_semi")
        rows = weighed(mine, {r["term"]: r["df"] for r in terms.collect()}, total[0])  # asked words only
        if rows:
            yield forward, rows, Weights.of(rows, kind, total[1], index.k1, index.b)


def _scored(index: Index | CountedIndex, queries: DataFrame, reduce: scan.Reducer, among: DataFrame | None = None) -> DataFrame:
    id_kind = dict((index.documents if isinstance(index, Index) else index.counted).dtypes)["id"]
    kinds = f"query_id {dict(queries.dtypes)['query_id']}, id {id_kind}, score double"
    out = None
    for forward, _, weights in passes(index, queries):
        rows = forward if among is None else forward.join(among.select("id"), "id", "left_semi")
        found = score_counted(rows, weights, reduce, kinds)
        out = found if out is None else out.unionByName(found)
    return queries.sparkSession.createDataFrame([], kinds) if out is None else out


def score(index: Index | CountedIndex, queries: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """``(query_id, id, score)`` of documents with a term of a query ``(query_id, text)``; a repeated term counts each time.

    With ``among``, only of documents whose id that table has; statistics are still those of all documents.
    """
    return _scored(index, queries, scan.everything, among)


def search(index: Index | CountedIndex, queries: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """``(query_id, id, score, rank)``: the k best documents of each query; with ``digits``, scores are rounded before they rank."""
    return top_k(_scored(index, queries, rounded(scan.best(k), digits)), k)


def rounded(reduce: scan.Reducer, digits: int | None) -> scan.Reducer:
    return reduce if digits is None else lambda names, found, scores: reduce(names, found, np.round(scores, digits))
