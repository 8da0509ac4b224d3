"""Retrieval of passages against scoring all of them."""

import math
import random
import re
from collections import Counter

from tidelog.operators.retrieval import passages, retrieve

WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]


def brute_force(docs, questions, k, size):
    runs = [(i, n, ws[n * size : n * size + size]) for i, t in docs for ws in [words(t)] for n in range(-(-len(ws) // size))]
    held, total = Counter(t for _, _, r in runs for t in set(r)), sum(len(r) for _, _, r in runs)
    out = []
    for q, text in questions:
        scores = []
        for i, n, run in runs:
            tf = Counter(run)
            score = sum(math.floor(1000 * math.log(1 + (len(runs) - held[t] + 0.5) / (held[t] + 0.5)) * (tf[t] * 2.2) / (tf[t] + 1.2 * (1 - 0.75 + 0.75 * len(run) / (total / len(runs))))) for t in words(text) if tf[t])
            if score > 0:
                scores.append((-score, i, n))
        out += [(q, rank, i, n, -s) for rank, (s, i, n) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_equals_scoring_all_and_scores_few(spark):
    rng = random.Random(6)
    vocabulary = [f"w{n}" for n in range(800)]
    weights = [1 / (n + 1) for n in range(800)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 120)))) for i in range(400)] + [(900, None), (901, " .,"), (902, "Élan ÉLAN"), (903, "w1 w2 w3"), (904, "w1 w2 w3")]
    questions = [(q, " ".join(docs[rng.randrange(400)][1].split()[:15] or ["w5"])) for q in range(20)] + [(50, None), (51, "nowhere"), (52, "w1 w1 W2"), (53, "Élan")]
    found = passages(spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, score int"), "doc_id", "text", 30)
    trace = {}
    got = retrieve(found, spark.createDataFrame(questions, "item long, text string"), 3, "doc_id", "item", "text", trace)
    assert sorted(tuple(r) for r in got.collect()) == brute_force(docs, questions, 3, 30)
    assert trace["scored"] < 0.4 * trace["all"], trace


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "id long, text string"), spark.createDataFrame([(1, "a b")], "id long, text string")
    for docs, questions in ((none, some), (some, none), (none, none)):
        assert retrieve(passages(docs, "id", "text"), questions.toDF("q", "text"), 2, "id", "q", "text").count() == 0


def test_texts_are_read_and_taken_apart_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(i, f"w{i} common É{i % 3} W{i}") for i in range(50)] + [(50, None), (51, " ,")], "doc_id long, text string").coalesce(2).mapInArrow(counting, "doc_id long, text string")
    found = passages(docs, "doc_id", "text", 2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    got = retrieve(found, spark.createDataFrame([(0, "w7 É1"), (1, "common")], "item long, text string"), 3, "doc_id", "item", "text").collect()
    assert seen.value == 52
    assert sorted(tuple(r) for r in got) == brute_force([(i, f"w{i} common É{i % 3} W{i}") for i in range(50)], [(0, "w7 É1"), (1, "common")], 3, 2)
