"""Every registered query against brute force over whole small tables."""

from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest

from lodestar.llm import queries as Q


def table(sf_dir, name):
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs(sf_dir):
    return [(r["doc_id"], r["text"]) for r in table(sf_dir, "documents")]


def test_op1(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    rows = Q.op1_best_fit_packing(spark, sf_dir).collect()
    tokenizer = Tokenizer.from_file(Q.TOKENIZER)
    by = defaultdict(dict)
    for r in rows:
        assert r["piece"] not in by[r["doc_id"]]
        by[r["doc_id"]][r["piece"]] = r
    for (doc, _), e in zip(docs, tokenizer.encode_batch([t or "" for _, t in docs], add_special_tokens=False)):
        ids = np.array([*e.ids, 2], "<u4")
        at = 0
        for k in range(len(by[doc])):
            r = by[doc][k]
            assert r["start"] == at and r["ids_crc32"] == brute.crc(ids[at : at + r["length"]].tobytes())
            assert r["length"] == 1024 or k == 0
            at += r["length"]
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(r["length"] for r in rows) // 1024)
    assert len(sequences) <= 1.02 * least + 1


def test_op2(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in Q.op2_quality_rules(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for d, t in docs:
        r = rows[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.quality(t)
        assert not (r["kept"] and r["base_failed"])
    labels = {r["doc_id"]: r["quality"] for r in table(sf_dir, "labels")}
    verdicts = Counter((q, rows[d]["kept"]) for d, q in labels.items() if not rows[d]["base_failed"])
    assert verdicts[1, True] >= 0.99 * (verdicts[1, True] + verdicts[1, False])
    assert verdicts[0, False] >= 0.95 * (verdicts[0, True] + verdicts[0, False])


def test_op4(spark, sf_dir, docs):
    sizes, groups = brute.jaccard_groups(docs, 3, 90, 100)
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in Q.op4_ngram_jaccard_join(spark, sf_dir).collect()}
    assert rows == {d: (sizes[d], groups[d]) for d, _ in docs}


def test_op5(spark, sf_dir):
    vectors = [(r["vec_id"], r["embedding"]) for r in table(sf_dir, "embeddings")]
    links, groups = brute.vector_groups(vectors, 0.95)
    rows = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in Q.op5_embedding_near_dedup(spark, sf_dir).collect()}
    assert rows == {i: (links[i], groups[i], groups[i] == i) for i, _ in vectors}


def test_op6(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in Q.op6_secret_scan(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    total = 0
    for d, t in docs:
        spans, digest = brute.secrets(t)
        count = Counter(k for _, _, _, k in spans)
        r = rows[d]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (count["assign"], count["access"], count["hex"], digest)
        got = [x for x in r["spans"].split(",") if x and x.split(":")[0] in ("assign", "access", "hex")]
        assert got == [f"{k}:{s}:{e}" for s, _, e, k in spans]
        total += len(spans)
    assert total


def test_op8(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in Q.op8_sharding(spark, sf_dir).collect()}
    slots = defaultdict(list)
    for d, t in docs:
        r = rows[d]
        raw = (t or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == brute.crc(raw) and 0 <= r["shard"] < 40
        assert r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(docs) / 120 < sum(r["grown_shard"] == 40 for r in rows.values()) < len(docs) / 15


def test_op9(spark, sf_dir, docs):
    want = {d: (n, gone, brute.sha(" ".join(kept))) for d, (n, gone, kept) in brute.substring(docs, 50).items()}
    rows = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in Q.op9_substring_dedup(spark, sf_dir).collect()}
    assert rows == want
    assert any(gone for _, gone, _ in want.values())


def test_op10(spark, sf_dir):
    turns = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table(sf_dir, "conversations")]
    turns += [(-1, 0, "user", Q.TRAP), (-1, 1, "assistant", Q.TRAP)]
    by = defaultdict(list)
    for c, *rest in sorted(turns):
        by[c].append(rest)
    rows = {r["conv_id"]: r for r in Q.op10_chat_formatting(spark, sf_dir).collect()}
    assert rows.keys() == by.keys()
    for c, ts in by.items():
        r = rows[c]
        learned = "".join(x or "" for _, role, x in ts if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(ts), brute.sha("".join(f"{role}\n{x or ''}\n" for _, role, x in ts)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), brute.sha(learned))
        assert r["formatted_chars"] > sum(len(x or "") for _, _, x in ts)
