"""Toxicity by FTRL-proximal logistic regression over hashed words, stems, n-grams and skip-grams.

Features are presence bits: each word, its first letters (stems, which words of one
root share), pairs of neighbouring words, and pairs with one word between.  Every coordinate has a learning
rate of its own, and the L1 term leaves most weights at 0: the model is the
list of the others, which goes to every task.

The model is fitted on at most ``FIT_ROWS`` labelled texts, taken in the order of a hash
of their ids, in one task that streams over them ``ROUNDS`` times; its memory is two arrays of
``2 ** BITS`` numbers.  Scores are for every row of a table.  Texts are read in parts, so no
text is too long for either.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.alnum import parts
from lodestar.llm.scratch import sized, stage
from lodestar.llm.words import Windows, give_back, mix, slices

#: Labelled rows that a model is fitted on at most, and how often they are seen.
FIT_ROWS, ROUNDS = 12_000, 3
#: Features are hashed to so many bits.
BITS = 22
#: Letters of the stems.
STEMS = (4, 6)
#: Learning rate (alpha, beta) and regularisation (L1, L2).
ALPHA, BETA, L1, L2 = 0.5, 1.0, 8.0, 1.0

_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


_LETTER_START = (np.arange(256) & 0xC0) != 0x80
_NONE = np.zeros(0, np.uint64)


def _word_hashes(part: bytes) -> np.ndarray:
    """A row per word of a part: hashes of the word and its stems, from one pass over the bytes."""
    b = np.frombuffer(part + b" ", np.uint8)
    space = b == 32
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    runs = Windows(b.astype(np.uint64))
    letters = np.flatnonzero(_LETTER_START[b])  # where each letter starts
    first = np.searchsorted(letters, starts)
    out = [runs.of(starts, ends)]
    for k in STEMS:
        stop = letters[np.minimum(first + k, len(letters) - 1)] if len(letters) else ends
        out.append(mix(runs.of(starts, np.clip(stop, starts, ends)) + np.uint64(k)))
    return np.stack(out, axis=1)


def features(text: str | None) -> Iterator[np.ndarray]:
    """Hashed features of a text, part by part, with repetitions."""
    before = _NONE
    for part in parts((text or "").lower().encode("utf-8", "surrogatepass")):
        found = _word_hashes(part)
        h, old = np.concatenate([before, found[:, 0]]), len(before)
        pairs = h[:-1] * _PAIR + h[1:]
        skips = h[:-2] * _SKIP + h[2:]
        new = [found.ravel(), pairs[max(0, old - 1) :], skips[max(0, old - 2) :]]
        yield (mix(np.concatenate(new)) >> np.uint64(64 - BITS)).astype(np.int64)
        before = h[-2:]


def _distinct(text: str | None) -> np.ndarray:
    """All distinct features of a text."""
    out = np.zeros(0, np.int64)
    for found in features(text):
        out = np.unique(np.concatenate([out, found]))
    return out


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, label, text) -> (key, label, features)."""
    for batch in slices(batches):
        rows = [_distinct(t).astype("<i4").tobytes() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["key", "label", "features"])


@dataclass(frozen=True)
class Model:
    """Weights that aren't 0, by feature in ascending order, and the bias."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def known(self) -> np.ndarray:
        """Whether each feature has a weight."""
        out = np.zeros(1 << BITS, bool)
        out[self.feature] = True
        return out

    def logits(self, texts: list[str | None], known: np.ndarray) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            hit = np.zeros(0, np.int64)
            for found in features(text):
                hit = np.unique(np.concatenate([hit, found[known[found]]]))  # at most the model's features
            out[i] += self.weight[np.searchsorted(self.feature, hit)].sum()
        return out


class Ftrl:
    """Follow the regularised leader, one example at a time; a weight is computed from its coordinate's sums when it is needed."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the bias

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        active = np.where(at == len(self.z) - 1, 0.0, L1)  # no L1 on the bias
        return np.where(np.abs(z) <= active, 0.0, -(z - np.sign(z) * active) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        grown = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
        self.n[at] = grown

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights(np.arange(len(self.z)))
        at = np.flatnonzero(w)
        return at, w[at]


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, features) in the order of learning -> (feature, weight)."""
    learner = Ftrl(1 << BITS)
    for batch in slices(batches):
        for label, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            learner.learn(np.frombuffer(raw, "<i4").astype(np.int64), label)
    at, w = learner.model()
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], ["feature", "weight"])
    give_back()


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS, rounds: int = ROUNDS) -> Model:
    """A model of ``label`` (1 or 0) from rows of ``docs`` whose id has a label and for which ``usable``, of ``labels``, holds.

    At most ``rows`` ids are taken, in the order of a hash of the id.  Ids with several labels count
    as toxic if one says so; of texts that share an id one is taken, by a hash of the text.
    Null ids, labels and texts aren't used.  Without usable labels every text scores 0.5.
    """
    known = labels.where(usable & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg((F.max(label) > 0).cast("int").alias("label"))
    order = F.xxhash64("key", F.lit("toxicity"))
    chosen = stage(known.orderBy(order, "key").limit(rows), "toxicity-labels")
    own = docs.select(F.col(id_col).alias("key"), F.col(text).alias("text")).where("text is not null").join(sized(chosen), "key")
    once = own.groupBy("key", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("key", "label", "text")
    kind = T.StructType([T.StructField("key", docs.schema[id_col].dataType), T.StructField("label", T.IntegerType()), T.StructField("features", T.BinaryType())])
    seen = stage(once.mapInArrow(_featurise, kind), "toxicity-features")
    line = seen.withColumn("round", F.explode(F.array(*map(F.lit, range(rounds))))).coalesce(1).sortWithinPartitions("round", order, "key")
    # One task learns from at most ``rows`` texts, round after round.
    found = stage(line.select("label", "features").mapInArrow(_train, "feature long, weight double"), "toxicity-model").orderBy("feature").toArrow()
    at, w = (found.column(i).to_numpy() for i in (0, 1))
    own_bias = at == 1 << BITS
    return Model(at[~own_bias], w[~own_bias].astype(np.float32), float(w[own_bias].sum()))


def _score(model: Model):
    """(id, text) -> (id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.known()
        for batch in slices(batches):
            logits = model.logits(batch.column(1).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logits, -35, 35))))], ["id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id_col, score)`` per row: the probability that the whole text is toxic.

    Null and empty texts get the bias alone; repeated rows score alike; an empty table gives an empty table;
    other columns are ignored.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(_score(model), schema).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """A fifth of all ids, for measuring: CRC-32 of the id as text, modulo 5, is 0.  A null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
