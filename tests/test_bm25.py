"""BM25: stored postings and maintained statistics against scores from the texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.operators import bm25, postings
from lodestar.operators.postings import PostingIndex
from lodestar.streaming.corpus import MaintainedCorpus

RNG = random.Random(11)
COMMON, RARE = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(600)]
DOCS = [(i, " ".join(RNG.choices(COMMON, k=RNG.randint(0, 40)) + RNG.choices(RARE, k=RNG.randint(0, 6)))) for i in range(900)] + [(1000, None), (1001, ""), (1002, "C1, c1! r5")]
ASKED = [(q, " ".join(RNG.choices(COMMON, k=4) + RNG.choices(RARE, k=3))) for q in range(25)] + [(90, "c1 c2"), (91, "zzz"), (92, None), (93, "r5 r5 c3"), (94, "r7")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, text string").repartition(4).cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, "query_id int, text string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


def by_hand(docs, asked, k, k1=1.5, b=0.75):
    import math
    from collections import Counter

    cut = {i: Counter(bm25.words_of(t)) for i, t in docs}
    mean = sum(sum(c.values()) for c in cut.values()) / len(cut)
    df = Counter(w for c in cut.values() for w in c)
    out = []
    for q, text in asked:
        scores = []
        for i, c in cut.items():
            s = sum(m * math.log((len(cut) - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * sum(c.values()) / max(mean, 1))) for w, m in Counter(bm25.words_of(text)).items() if c[w])
            if s > 0:
                scores.append((-round(s, 9), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_search_equals_sums_by_hand(docs, asked, monkeypatch):
    want = by_hand(DOCS, ASKED, 5)
    assert rows(bm25.search(bm25.build(docs), asked, 5, digits=9)) == want
    monkeypatch.setattr(bm25, "CELLS", 50)
    monkeypatch.setattr(bm25, "PARTS", 20)
    assert rows(bm25.search(bm25.build(docs), asked, 5, digits=9)) == want


def test_many_queries_are_scored_in_passes(docs, asked, monkeypatch):
    monkeypatch.setattr(bm25.passes, "__defaults__", (40,))
    assert rows(bm25.search(bm25.build(docs), asked, 5, digits=9)) == by_hand(DOCS, ASKED, 5)


def test_postings_give_the_rows_of_a_full_scan_and_skip_blocks(spark, docs, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    index = PostingIndex.build(docs, str(tmp_path / "index"), parts=3)
    sizes = index.blocks.select(F.size("ids").alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert sizes[0] < 60 and sizes[1] == bm25.build(docs).tf.count()
    again = PostingIndex.load(spark, str(tmp_path / "index"))
    for k in (1, 5):
        assert rows(again.search(asked, k, digits=9)) == by_hand(DOCS, ASKED, k)
    read, every = again.skipped(asked.where("query_id in (3, 90, 93)"), 3)
    assert 0 < read < every * 0.6
    assert again.search(asked.where("query_id in (91, 92)"), 3).collect() == []
    read, _ = again.skipped(asked.where("query_id = 94"), 1)
    assert read <= sum(r["blocks"] for r in again.levels.where("term = 'r7'").collect())


def test_postings_of_empty_table(spark, asked, tmp_path):
    index = PostingIndex.build(spark.createDataFrame([], "id long, text string"), str(tmp_path / "none"))
    assert index.search(asked, 3).collect() == [] and index.documents == 0


def state(c):
    total = c.totals().first()
    return sorted(map(tuple, c.terms().collect())), (total["documents"], total["length"]), sorted((r["id"], r["length"], sorted(zip(r["words"], r["counts"]))) for r in c.documents().collect())


def fresh(spark, docs, path):
    out = MaintainedCorpus(spark, path)
    out.apply(spark.createDataFrame(docs, "id long, text string"), 0)
    return out


def test_maintained_statistics(spark, asked, tmp_path):
    """Appends, changes, deletions and replayed batches leave what a fresh build of the living documents has."""
    schema = "id long, text string, deleted boolean, order int"
    batches = [
        [(i, t, False, 0) for i, t in DOCS[:400]],
        [(i, t, None, 0) for i, t in DOCS[400:]] + [(5, "c1 changed", False, 1), (5, "c1 lost", False, 0), (6, None, True, 0), (5000, "x", True, 0), (None, "c1", False, 0)],
        [(6, "back again c2", False, 0), (7, "x", True, 2), (7, "y", False, 1), (8, None, False, 0)],
    ]
    kept = MaintainedCorpus(spark, str(tmp_path / "kept"))
    assert kept.totals().first()["documents"] == 0 and kept.terms().count() == 0
    for n, rows_ in enumerate(batches):
        kept.apply(spark.createDataFrame(rows_, schema), n)
        if n != 1:
            kept.apply(spark.createDataFrame(rows_, schema).repartition(3), n)  # the same batch again
    living = {**dict(DOCS), 5: "c1 changed", 6: "back again c2", 8: None}
    living.pop(7)
    want = fresh(spark, list(living.items()), str(tmp_path / "fresh"))
    assert state(kept) == state(want)
    assert rows(bm25.search(kept.index(), asked, 5, digits=9)) == by_hand(list(living.items()), ASKED, 5)
    folded = kept.fold(str(tmp_path / "folded"))
    assert state(folded) == state(kept)
    folded.apply(spark.createDataFrame([(5, None, True, 0)], schema), 3)
    assert folded.totals().first()["documents"] == len(living) - 1


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    kept = fresh(spark, DOCS[:50], str(tmp_path / "c"))
    before = state(kept)
    spark.createDataFrame([("ghost", 7)], "term string, df long").write.parquet(f"{tmp_path}/c/terms/batch=1")
    assert state(kept) == before


def test_stream_of_changes(spark, tmp_path):
    """A stream that is stopped and goes on equals the batch result."""
    schema = "id long, text string, deleted boolean, order int"
    put = lambda rows_, n: spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    kept = MaintainedCorpus(spark, str(tmp_path / "kept"))
    put([(i, t, False, 0) for i, t in DOCS[:60]], 0)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    kept.follow(read(), str(tmp_path / "at"), once=True).awaitTermination()
    put([(3, None, True, 1), (4, "other words", False, 1)], 1)
    put([(3, "c1 returns", False, 2)], 2)
    kept.follow(read(), str(tmp_path / "at"), once=True).awaitTermination()
    living = {**dict(DOCS[:60]), 4: "other words", 3: "c1 returns"}
    assert state(kept) == state(fresh(spark, list(living.items()), str(tmp_path / "fresh")))


def test_words_are_counted_before_they_are_stripped():
    """Counts and their order are those of the words in turn, whatever stands between them."""
    odd = [None, "", " . ", "The the, (THE) other\u00a0the", "a\x1cb a\x1cb. c\x1fd\u2003c", "x\u3000'x' \u0085x- y", "\u0130stanbul i\u0307stanbul", "--- a --- -a-"]
    for text in odd:
        counted = bm25.word_counts(text)
        assert list(counted.items()) == list(Counter(bm25.words_of(text)).items()), text


def test_scores_among_some_documents(spark):
    """The rest is not scored, and counts in the statistics all the same."""
    docs = spark.createDataFrame(DOCS, "id long, text string")
    queries = spark.createDataFrame([(1, "c1 r5 r5"), (2, "r7 c2")], "query_id long, text string")
    some = docs.where("id % 3 = 0")
    rows = lambda found: sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in found.collect())
    assert rows(bm25.score(bm25.build(docs), queries, some)) == rows(bm25.score(bm25.build(docs), queries).where("id % 3 = 0"))
