"""Ranked lexical search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidelog.llm.lexical_search import TERM_IDS, fit_bisection, hashed, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(ASCII_LOWER))


def brute_force(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(counted), sum(c.total() for _, c in counted)
    held = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c in counted:
            m = 75 + 25 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows_of(seed, n=300):
    rng = random.Random(seed)
    topics = [[f"w{t}x{j}" for j in range(40)] for t in range(6)]
    docs = [(0, None), (1, ""), (2, " .,; "), (3, "Élan ÉLAN élan İx"), (4, "x" * 3000), (5, "a b c " * 2000), (6, "same same"), (7, "same same"), (7, "same same"), (None, "same same")]
    for i in range(10, n):
        topic = rng.choice(topics)
        docs.append((i, " ".join(rng.choice(topic) if rng.random() < 0.8 else f"common{rng.randint(0, 9)}" for _ in range(rng.randint(1, 120))) + rng.choice([".", "!", ""])))
    items = [(i, " ".join(rng.choice(rng.choice(topics)) for _ in range(rng.randint(1, 12)))) for i in range(12)]
    items += [(20, None), (21, "  "), (22, "SAME"), (22, "SAME"), (23, "Élan x1"), (24, "common1 common1 common2"), (25, "nowhere")]
    return docs, items


def found_by(result):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in result.collect()), key=str)


@pytest.mark.parametrize(("shard_docs", "block_bytes"), [(256, 1 << 20), (8, 400)])
def test_equals_scoring_all(spark, shard_docs, block_bytes):
    docs, items = rows_of(3)
    frame = spark.createDataFrame([(i, t, "x", 1.5) for i, t in docs], "doc_id long, text string, item string, score double").repartition(3)
    asked = spark.createDataFrame([(i, t, 4) for i, t in items], "item_id int, text string, rank int")
    result = search(frame, asked, 5, shard_docs=shard_docs, block_bytes=block_bytes)
    assert result.columns == ["item_id", "rank", "doc_id", "score"]
    assert found_by(result) == brute_force(docs, items, 5)


def test_shards_are_left_out(spark):
    rng = random.Random(5)
    topics = [[f"t{t}n{j}" for j in range(60)] for t in range(16)]
    docs = [(i, " ".join(rng.choice(topics[i % 16]) for _ in range(40))) for i in range(960)]
    items = [(t, " ".join(topics[t][:6])) for t in range(16)]
    trace = []
    result = search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3, shard_docs=16, trace=trace)
    assert found_by(result) == brute_force(docs, items, 3)
    shards = 960 // 16
    assert sum(n for _, n in trace) < 0.5 * shards * len(items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert search(docs, items, 3).count() == 0
    assert search(docs, some.toDF("item_id", "text"), 3).count() == 0
    assert search(some, items, 3).count() == 0


def test_terms_in_pieces():
    text = ("Ab-c é " * 300_000).encode()
    assert [t for piece in terms_of(text) for t in piece] == [b"ab", b"c", "é".encode()] * 300_000


def test_bisection_parts_topics():
    rng = random.Random(2)
    docs = [hashed(f"{i % 2}-{rng.randint(0, 50)}".encode() for _ in range(30)) for i in range(200)]
    tree = fit_bisection(docs, 1)
    ends = np.cumsum([len(d) for d in docs])
    leaves = tree.leaves(ends, np.concatenate(docs))
    assert set(leaves) == {0, 1} and max(t for d in docs for t in d) < TERM_IDS
    assert len(set(leaves[::2])) == 1 and len(set(leaves[1::2])) == 1
