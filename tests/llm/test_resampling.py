"""Operators 11 to 13: queries against brute force, and odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestar.llm import alnum, importance, toxicity, whitening
from lodestar.llm import queries as Q

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def runs(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute_resample(docs, target, n=1, buckets=10_000, num=10, den=100, min_words=20, seed=2024):
    import hashlib

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, runs(x, n)))
    for x in target:
        t.update(map(bucket, runs(x, n)))
    S, total = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (total + buckets))))
    rows = []
    for d, x in docs:
        f = runs(x, n)
        w = sum(map(gain, map(bucket, f)))
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r, (_, x) in zip(rows, docs) if len(words(x)) >= min_words), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: num * len(able) // den]):
        r[4] = k + 1
    return sorted(map(tuple, rows), key=repr)


def test_op11(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    target = [r["text"] for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()]
    rows = Q.op11_importance_resampling(spark, sf_dir).collect()
    assert sorted(map(tuple, rows), key=repr) == brute_resample(docs, target)


@pytest.mark.parametrize("n", [1, 3])
def test_resample_runs_and_small_tries(spark, monkeypatch, n):
    """Runs of several words; tries that are folded and texts that are read in parts give the same rows."""
    rng = random.Random(n)
    vocabulary = ["a", "B", "é", "x1", "日本", "the", "of", "zz" * 40]
    docs = [(i, rng.choice([None, "", "!!", " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))])) for i in range(80)]
    docs += [(7, "a b a b"), (7, "a b a b"), (200, "a-B." * 300)]
    target = ["the of the", None, "x1 a b"]
    df, goal = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    want = brute_resample(docs, target, n=n, buckets=97, num=1, den=3, min_words=5, seed=9)
    got = importance.resample(df.repartition(3), goal, n=n, buckets=97, draw=(1, 3), min_words=5, seed=9)
    plain = lambda f: sorted(map(tuple, f.drop("n_words").collect()), key=repr)
    assert plain(got) == want
    gain = importance.gains(*(importance.bucket_totals(x, n=n, buckets=97) for x in (df, goal)))
    monkeypatch.setattr(importance, "NODES", 5)
    monkeypatch.setattr(alnum, "PIECE", 16)
    batches = df.select("doc_id", F.col("text").cast("binary").alias("raw")).toArrow().to_batches()
    again = [tuple(r.values()) for b in importance._weigh(n, gain)(iter(batches)) for r in b.to_pylist()]
    assert sorted((a, c, d) for a, _, c, d in again) == sorted(r[:3] for r in want)
    counted = [b for b in importance._count(n, 97)(iter([x.select(["raw"]) for x in batches]))][0].to_pylist()
    assert sum(r["times"] for r in counted) == sum(r[1] for r in want)


def test_resample_odd_rows(spark):
    """Empty tables, null ids, other columns that clash, ties."""
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (None, "a b"), (2, None)], "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("raw", F.lit(2))
    assert importance.resample(empty, empty).collect() == []
    rows = {r["doc_id"]: r for r in importance.resample(some, empty, min_words=0, draw=(1, 1)).collect()}
    assert rows[None]["score"] is None and rows[None]["rank"] is None and rows[None]["weight"] == rows[1]["weight"]
    assert {rows[1]["rank"], rows[2]["rank"]} == {1, 2} and rows[2]["n_features"] == 0 and rows[2]["weight"] == 0
    tied = spark.createDataFrame([(i, 5, 0, 7) for i in range(100, 0, -1)] + [(i, 5, 0, 8) for i in (300, 200)], "doc_id long, n_words long, weight long, score long")
    order = [r["doc_id"] for r in importance.ranked(tied, F.col("n_words") > 1, (1, 2)).where("rank is not null").orderBy("rank").collect()]
    assert order == [200, 300, *range(1, 50)]
    texts = importance.drawn(some, importance.resample(some, empty, min_words=0, draw=(1, 1)))
    assert texts.columns == some.columns and {r["doc_id"] for r in texts.collect()} == {1, 2}


def brute_features(text):
    w = re.findall(r"[0-9a-z\x80-\U0010FFFF]+", (text or "").lower())
    out = {("word", x) for x in w} | {("pair", *x) for x in zip(w, w[1:])} | {("skip", *x) for x in zip(w, w[2:])}
    return out | {(k, x[:k]) for x in w for k in toxicity.STEMS}


def test_features(monkeypatch):
    """As many distinct features as by plain means, the same for equal ones, whole or in parts."""
    texts = ["", None, "!!", "a", "Ab cde, fghij-klmnopq", "éèà日本語日本語 ßx " * 3, "x" * 100 + " y", " lead and trail  ", "a b a b c"]
    seen = {}
    for t in texts:
        assert len(toxicity._distinct(t)) == len(brute_features(t))
        seen[t] = toxicity._distinct(t).tolist()
    one, two = set(seen["a b a b c"]), set(toxicity._distinct("b a b"))
    assert two < one
    monkeypatch.setattr(alnum, "PIECE", 4)
    assert {t: toxicity._distinct(t).tolist() for t in texts} == seen


def test_op12(spark, sf_dir):
    rows = {r["doc_id"]: r for r in Q.op12_toxicity(spark, sf_dir).collect()}
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    assert rows.keys() == docs.keys()
    for d, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    labels = [(r["toxic"], rows[r["doc_id"]]) for r in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()]
    out = [(y, r) for y, r in labels if r["held_out"]]
    assert sum(y == r["predicted"] for y, r in out) >= 0.93 * len(out)
    assert sum(r["predicted"] for y, r in labels if not y) <= 0.005 * len(labels)


def test_toxicity_learns_only_from_usable_rows(spark):
    """Words, stems and pairs are learnt; odd rows have defined scores."""
    rng = random.Random(3)
    clean = ["lamp", "river", "stone", "cloud", "green", "paper"]
    rows = []
    for i in range(600):
        text = rng.choices(clean, k=20)
        kind = i % 4
        if kind == 0:
            text[rng.randrange(20)] = rng.choice(["wretch", "wretches", "Wretched"])
        rows.append((i, " ".join(text), int(kind == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, "another text of id 0"), (None, "lamp"), (1000, None), (1001, "wretchful"), (1002, "river stone " * 3000 + "wretch"), (1003, "lamp river")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1), (1, 0), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 2 == 0)
    again = toxicity.fit(docs.repartition(5), labels.repartition(4), F.col("doc_id") % 2 == 0)
    assert (model.feature == again.feature).all() and np.allclose(model.weight, again.weight)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count()
    score = {r["doc_id"]: r["score"] for r in got if r["doc_id"] != 0}
    assert score[1001] > 0.5 and score[1002] > 0.5 and score[1003] < 0.5 and score[1000] < 0.5 and score[None] < 0.5
    assert all((score[i] > 0.5) == bool(y) for i, _, y in rows if i)
    none = toxicity.fit(docs, labels, F.lit(False))
    assert len(none.feature) == 0 and {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).collect() == []
    assert len(toxicity.fit(docs, labels, F.lit(True), rows=10).feature) <= len(model.feature)


def brute_whiten(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, S = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, S)) for r in x]
    c = x - S / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, deviation, c @ (u / np.sqrt(e)), e / np.trace(c.T @ c / n)


def check_whitened(rows, ids, vectors):
    n, deviation, white, explained = brute_whiten(vectors)
    by = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(by) == len(ids) * white.shape[1]
    for j in range(white.shape[1]):
        got = np.array([by[i, j + 1]["whitened"] for i in ids])
        sign = np.sign(got @ white[:, j])
        assert np.abs(got * sign - white[:, j]).max() < 1e-6
        assert all(by[i, j + 1]["deviation"] == d and by[i, j + 1]["n"] == n for i, d in zip(ids, deviation))
        assert all(abs(by[i, j + 1]["explained"] / explained[j] - 1) < 1e-9 and by[i, j + 1]["identity_error"] < 1e-9 for i in ids)


def test_op13(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()
    check_whitened(Q.op13_embedding_whitening(spark, sf_dir).collect(), [r["vec_id"] for r in table], [r["embedding"] for r in table])


def test_whitening_odd_rows(spark, tmp_path):
    """Null, non-finite, huge and other-length vectors are left out; repeated rows and null ids stay."""
    rng = np.random.default_rng(1)
    good = rng.normal(size=(40, 12)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(good)] + [(100, None), (101, []), (102, [1.0] * 11 + [None]), (103, [float("nan")] * 12), (104, [float("inf")] + [0.0] * 11), (105, [1e30] * 12), (106, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit("x")).withColumn("label", F.lit(1)).repartition(5)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    check_whitened(Q.op13_embedding_whitening(spark, str(tmp_path)).collect(), list(range(40)), good)
    twice = whitening.whiten(spark.createDataFrame([(None, v) for v in good] + [(1, v) for v in good], "vec_id long, embedding array<float>")).collect()
    assert len(twice) == 80 and sum(r["vec_id"] is None for r in twice) == 40 and {r["n"] for r in twice} == {80}
    assert whitening.whiten(df.limit(0)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in one] == [([None, None], [0.0, 0.0], None, 0)]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<double>")).collect()
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] and abs(r["explained"][0] - 1) < 1e-12 and r["identity_error"] < 1e-9 for r in line)


def test_whitening_is_exact_for_large_numbers(spark):
    """Sums and deviations beyond 64 bits, and a mean that a single pass would drown."""
    rows = [(i, [1e12 + i % 3, -1e12 + i % 5, float(i)]) for i in range(50)]
    got = {r["vec_id"]: r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()}
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    S = [sum(c) for c in zip(*x)]
    assert all(int(got[i]["deviation"]) == sum((50 * a - b) ** 2 for a, b in zip(r, S)) for i, r in enumerate(x))
    assert got[0]["identity_error"] < 1e-9
    far = [(i, [1e14 * (-1) ** i, 0.5]) for i in range(20)]
    got = {r["vec_id"]: r for r in whitening.whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect()}
    assert int(got[0]["deviation"]) == (20 * 1024 * 10**14) ** 2
    further = [(i, [1e15 * (-1) ** i]) for i in range(20)]
    assert {r["deviation"] for r in whitening.whiten(spark.createDataFrame(further, "vec_id long, embedding array<double>")).collect()} == {None}
