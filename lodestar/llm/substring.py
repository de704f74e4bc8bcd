"""Duplicate spans by relative Lempel-Ziv parsing.

Every document is reference text for the documents with larger ids.  Texts are cut into
phrases: each run of windows (``window`` consecutive words) that share one minimiser,
the smallest hash of ``gram`` words in a window, is a phrase, so a passage that two
documents share falls into the same phrases in both wherever it stands.  The index has
the first occurrence of every phrase.

Parsing fetches the reference blocks (``SPAN`` windows of a document) where a document's
phrases occur first, and factors it greedily from left to right: of all places in these
blocks where its next phrase stands, the one from which most of the following phrases
match too gives the factor ``(first, count, ref_doc, ref_first)``.  At the boundaries of
factors, a phrase may be known in another form only: same minimiser, other words around it.
Its windows are looked up one by one, and those found extend a factor or make one of their
own.  A factor of one window has ``window`` words; these are the duplicate spans.

Phrases and windows are 64-bit hashes.  Equal phrases are aggregated before they
meet their other occurrences, so that a passage in a third of all documents is one
row by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.scratch import sized, stage, stage_only
from lodestar.llm.words import Windows, WordHashes, mix, slices

GRAM = 20
#: Windows of a reference block.
SPAN = 512


def phrases(hashes: Windows, n: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser hash, phrase hash, first window, windows) of a document of n words."""
    starts = n - window + 1
    grams = np.arange(n - gram + 1)
    value = hashes.of(grams, grams + gram)
    span = window - gram + 1  # grams in a window
    best, width = grams.copy(), 1
    while width < span:  # smallest gram of growing runs, the leftmost of equals
        step = min(width, span - width)
        a, b = best[:-step], best[step:]
        best = np.where(value[b] < value[a], b, a)
        width += step
    best = best[:starts]
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    count = np.diff(np.append(first, starts))
    whole = hashes.of(first, first + count + window - 1)
    offset = (best[first] - first).astype(np.uint64)
    return value[best[first]], mix(whole ^ (offset << np.uint64(32))), first, count


def _index(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches):
            keys, docs, parts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), []
            for key, doc, text in zip(keys, docs, batch.column(2).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                if len(words) >= window:
                    anchor, phrase, first, count = phrases(Windows(cache.of(words)), len(words), window, gram)
                    parts.append((np.full(len(first), key), np.full(len(first), doc), anchor.view(np.int64), phrase.view(np.int64), first, count))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(zip(*parts), (np.int64, np.int64, np.int64, np.int64, np.int32, np.int16))], ["key", "doc", "anchor", "phrase", "first", "count"])

    return run


def _boundary_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches):
            parts = []
            keys, docs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for key, doc, text, spans in zip(keys, docs, batch.column(2).to_pylist(), batch.column(3)):
                hashes = Windows(cache.of(text.encode("utf-8", "surrogatepass").split()))
                first, count = (spans.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                parts.append((np.full(len(at), key), np.full(len(at), doc), hashes.of(at, at + window).view(np.int64), at))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(zip(*parts), (np.int64, np.int64, np.int64, np.int32))], ["key", "doc", "hash", "first"])

    return run


class Blocks:
    """Phrases of reference blocks in order, with the places of each."""

    def __init__(self, blocks: list[dict]):
        rows = sorted({(b["ref_doc"], b["ref_key"], p["first"], p["count"], p["phrase"]) for b in blocks for p in b["phrases"]})
        self.doc, key, self.first, count, self.phrase = (np.array(c, np.int64) for c in zip(*rows))
        # Whether a phrase goes on where the one before it ended.
        self.goes_on = np.concatenate([[False], (key[1:] == key[:-1]) & (self.first[:-1] + count[:-1] == self.first[1:])])
        self.order = np.argsort(self.phrase, kind="stable")
        self.sorted = self.phrase[self.order]

    def longest(self, own: np.ndarray) -> tuple[int, int]:
        """(place, phrases) of the longest run that begins as ``own`` does; the earliest of equals, (-1, 0) if there is none."""
        lo, hi = np.searchsorted(self.sorted, own[0], "left"), np.searchsorted(self.sorted, own[0], "right")
        alive, n = np.sort(self.order[lo:hi]), 1
        if not len(alive):
            return -1, 0
        while n < len(own):
            at = alive + n
            more = at < len(self.phrase)
            more[more] = self.goes_on[at[more]] & (self.phrase[at[more]] == own[n])
            if not more.any():
                break
            alive, n = alive[more], n + 1
        return int(alive[0]), n


def parse(own: list[dict], blocks: list[dict]) -> list[dict]:
    """Greedy factors of a document's known phrases against its reference blocks."""
    own = sorted({(p["first"], p["count"], p["phrase"]) for p in own})
    refs = Blocks(blocks)
    first, count, phrase = (np.array(c, np.int64) for c in zip(*own))
    breaks = [*(np.flatnonzero(first[1:] != first[:-1] + count[:-1]) + 1).tolist(), len(own)]
    out, at = [], 0
    for end in breaks:
        while at < end:
            place, n = refs.longest(phrase[at:end])
            if n:
                out.append({"first": int(first[at]), "count": int(count[at : at + n].sum()), "ref_doc": int(refs.doc[place]), "ref_first": int(refs.first[place])})
            at += max(n, 1)
    return out


_FACTORS = "array<struct<first:int,count:int,ref_doc:long,ref_first:int>>"
_ARROW_FACTORS = pa.list_(pa.struct([("first", pa.int32()), ("count", pa.int32()), ("ref_doc", pa.int64()), ("ref_first", pa.int32())]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [parse(own, blocks) for own, blocks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW_FACTORS)], ["key", "factors"])


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors in order; those that meet and go on in the same place of the same reference become one."""
    for batch in slices(batches):
        out = []
        for factors in batch.column(1).to_pylist():
            grown: list[dict] = []
            for f in sorted(factors, key=lambda f: (f["first"], -f["count"], f["ref_doc"], f["ref_first"])):
                last = grown[-1] if grown else None
                if last and f["first"] <= last["first"] + last["count"] and (f["ref_doc"], f["ref_first"] - f["first"]) == (last["ref_doc"], last["ref_first"] - last["first"]):
                    last["count"] = max(last["count"], f["first"] + f["count"] - last["first"])
                else:
                    grown.append(f)
            out.append(grown)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _ARROW_FACTORS)], ["key", "factors"])


def _factors(df: DataFrame, id_col: str, text: str, window: int, gram: int) -> DataFrame:
    """``(key, factors)`` of the documents that have any."""
    if not 0 < gram < window:
        raise ValueError("gram must be between 1 and window - 1")
    docs = df.select(row_key(id_col, text).alias("key"), F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    index = stage(docs.mapInArrow(_index(window, gram), "key long, doc long, anchor long, phrase long, first int, count smallint"), "substring-index")
    forms = index.groupBy("anchor", "phrase").agg(F.min(F.struct("doc", "key", "first")).alias("ref"), F.max("doc").alias("high"))
    anchors = forms.groupBy("anchor").agg(F.min("ref.doc").alias("least"), F.max("high").alias("most"), F.count(F.lit(1)).alias("forms")).where("least < most")
    # Tables by one key are staged before they join rows of that key: the join can then split a hot one.
    anchors = stage(anchors.select("anchor", "forms"), "substring-anchors")
    shared = stage(forms.join(anchors, "anchor").select("anchor", "phrase", "forms", F.col("ref.doc").alias("ref_doc"), F.col("ref.key").alias("ref_key"), F.floor(F.col("ref.first") / SPAN).cast("int").alias("block")), "substring-shared")
    hits = index.join(shared, ["anchor", "phrase"]).where("doc > ref_doc or forms > 1")
    hits = stage(hits.select("key", "phrase", "first", "count", (F.col("doc") > F.col("ref_doc")).alias("whole"), "ref_doc", "ref_key", "block"), "substring-hits")
    whole = hits.where("whole")
    places = stage(whole.select("ref_doc", "ref_key", "block").distinct(), "substring-places")
    at = index.select(F.col("key").alias("ref_key"), F.floor(F.col("first") / SPAN).cast("int").alias("block"), F.struct("first", "count", "phrase").alias("p"))
    blocks = stage(at.join(sized(places), ["ref_key", "block"]).groupBy("ref_doc", "ref_key", "block").agg(F.collect_set("p").alias("phrases")), "substring-blocks")
    wanted = stage(whole.select("key", "ref_key", "block").distinct(), "substring-wanted")
    fetched = wanted.join(sized(blocks), ["ref_key", "block"]).groupBy("key").agg(F.collect_list(F.struct("ref_doc", "ref_key", "phrases")).alias("blocks"))
    own = whole.groupBy("key").agg(F.collect_set(F.struct("first", "count", "phrase")).alias("own"))
    parsed = own.join(fetched, "key").select("key", "own", "blocks").mapInArrow(_parse, f"key long, factors {_FACTORS}")
    # One document per form of a phrase stands for all that have the form.
    unsure = stage(hits.where("not whole").groupBy("key").agg(F.collect_set(F.struct("first", "count")).alias("spans")), "substring-forms")
    texts = docs.join(sized(unsure), "key").select("key", "doc", "text", "spans")
    windows = stage(texts.mapInArrow(_boundary_windows(window), "key long, doc long, hash long, first int"), "substring-windows")
    earliest = windows.groupBy("hash").agg(F.min(F.struct("doc", "first")).alias("ref"), F.max("doc").alias("high")).where("ref.doc < high")
    earliest = stage(earliest.select("hash", F.col("ref.doc").alias("ref_doc"), F.col("ref.first").alias("ref_first")), "substring-earliest")
    late = windows.join(earliest, "hash").where("doc > ref_doc").select("key", F.struct("first", F.lit(1).alias("count"), "ref_doc", "ref_first").alias("f"))
    late = late.groupBy("key").agg(F.collect_set("f").alias("factors"))
    every = parsed.unionByName(late).groupBy("key").agg(F.flatten(F.collect_list("factors")).alias("factors"))
    return every.mapInArrow(_grow, f"key long, factors {_FACTORS}")


def factors(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 50, gram: int = GRAM) -> DataFrame:
    """``(key, first, words, ref_doc, ref_first)``: the factors of at least ``window`` words of each document.

    Words ``first`` to ``first + words - 1`` also stand in the document ``ref_doc``, from its word
    ``ref_first`` on; ``ref_doc`` has a smaller id.  Every window that occurs in a document
    with a smaller id lies in a factor.  Nulls and repeated rows as in ``duplicate_spans``.
    """
    found = _factors(df, id_col, text, window, gram).select("key", F.explode("factors").alias("f"))
    return found.select("key", "f.first", (F.col("f.count") + window - 1).alias("words"), "f.ref_doc", "f.ref_first")


def duplicate_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 50, gram: int = GRAM) -> DataFrame:
    """``(key, spans)``: for each document with duplicate words, runs ``(first, count)`` of windows that also stand in a document with a smaller id.

    ``key`` is ``row_key`` of the row.  Rows with a null id or text have no spans
    and are no reference.  Repeated rows have one id, so neither is the other's reference.
    """
    return _factors(df, id_col, text, window, gram).mapInArrow(_merge, "key long, spans array<struct<first:int,count:int>>")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Touching factors made one span; factors come sorted."""
    for batch in batches:
        out = []
        for found in batch.column(1).to_pylist():
            merged: list[dict] = []
            for s in found:
                if merged and s["first"] <= merged[-1]["first"] + merged[-1]["count"]:
                    merged[-1]["count"] = max(merged[-1]["count"], s["first"] + s["count"] - merged[-1]["first"])
                else:
                    merged.append({"first": s["first"], "count": s["count"]})
            out.append(merged)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("count", pa.int32())])))], ["key", "spans"])


def row_key(id_col: str, text: str):
    """Key of a row that tells rows with one id and different texts apart."""
    return F.xxhash64(F.col(id_col), F.col(text))


def covered(spans, n: int, window: int) -> np.ndarray:
    """Which of n words stand in a window of the spans."""
    change = np.zeros(n + 1, np.int64)
    first, count = (spans.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    np.add.at(change, first, 1)
    np.add.at(change, np.minimum(first + count + window - 1, n), -1)
    return np.cumsum(change[:n]) > 0


def _cut(text_at: int, names: list[str], window: int):
    import regex

    word = regex.compile(rb"[^ \t\n\x0b\x0c\r]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, kept, total, gone = batch.column(text_at).to_pylist(), [], [], []
            spans = batch.column(batch.num_columns - 1)
            for i, text in enumerate(texts):
                raw = (text or "").encode("utf-8", "surrogatepass")
                words = raw.split()
                total.append(len(words))
                gone.append(0)
                if not spans[i].is_valid or not words:
                    kept.append(text)
                    continue
                mask = covered(spans[i], len(words), window)
                gone[-1] = int(mask.sum())
                # A removed word goes with the white space after it.
                begins = [m.start() for m in word.finditer(raw)] + [len(raw)]
                pieces, edges = [raw[: begins[0]]], np.flatnonzero(np.diff(np.concatenate([[1], mask, [1]])))
                for a, b in zip(edges[::2], edges[1::2]):
                    pieces.append(raw[begins[a] : begins[b]])
                kept.append(b"".join(pieces).decode("utf-8", "surrogatepass"))
            columns = [pa.array(kept, pa.string()) if j == text_at else batch.column(j) for j in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_words", "n_removed"])

    return run


def remove_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 50, gram: int = GRAM) -> DataFrame:
    """``df`` with duplicate words cut from ``text``, plus ``n_words`` (before) and ``n_removed``.

    A word goes if it stands in a run of ``window`` words that also occurs in a
    document with a smaller id; windows are judged on the texts as they came in.
    Rows stay even if no word does.  Null texts stay null with 0 words; columns named
    like an added one are replaced.
    """
    rest = df.drop(*[c for c in ("n_words", "n_removed", "_key", "_spans") if c != text])
    spans = stage_only(lambda: duplicate_spans(df, id_col, text, window, gram).select(F.col("key").alias("_key"), F.col("spans").alias("_spans")), "substring-spans")
    joined = rest.withColumn("_key", row_key(id_col, text)).join(sized(spans), "_key", "left").select(*[rest[c] for c in rest.columns], "_spans")
    schema = T.StructType([*rest.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(_cut(rest.columns.index(text), rest.columns, window), schema)
