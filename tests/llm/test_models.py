"""Searches against brute force, classifiers by held-out accuracy, and the pipeline."""

import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from oracle import FOLDER, compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import ann, catalog
from tidelog.llm.ann import nearest
from tidelog.llm.exact_topk import exact_topk
from tidelog.llm.pretokens import texts_of
from tidelog.llm.quality import BradleyTerry, score_quality
from tidelog.llm.toxicity import SubwordSoftmax, score_toxicity


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql(spark, name):
    compare(catalog.QUERIES[name](spark, FOLDER), connect(), catalog.ORACLE_SQL[name])


VECTORS = "vec_id long, embedding array<float>, cell string, score int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(700, 12)).astype(np.float32).round(3)
    points[300:340] = points[0]
    rows = [(i, p.tolist(), "c", 1) for i, p in enumerate(points)]
    odd = [(700, None, "c", 1), (750, [0.0] * 12, "c", 1), (800, [None] + [1.0] * 11, "c", 1), (850, [float("nan")] * 12, "c", 1), (900, [float("inf")] * 12, "c", 1), (None, [1.0] * 12, "c", 1), (50, points[50].tolist(), "c", 1)]
    return rows, spark.createDataFrame(rows + odd, VECTORS).repartition(4).cache()


def test_exact_topk(vectors):
    rows, df = vectors
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v, *_ in rows} | {750: np.zeros(12, int)}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in exact_topk(df, F.col("vec_id") % 50 == 0, 5, query_block=4, cand_block=100).collect()}
    asked = [i for i in whole if i % 50 == 0]
    assert len(got) == 5 * len(asked)
    for q in asked:
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, -s) for s, i in best]


def test_nearest(vectors):
    rows, df = vectors
    points = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows}
    cosine = lambda a, b: float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))
    got = {}
    for r in nearest(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [i for i in points if i % 50 == 0]
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(abs(cosine(points[q], points[i]) - s) < 1e-12 for _, i, s in found)
        best = sorted((-round(cosine(points[q], v), 12), i) for i, v in points.items() if i != q)[:5]
        hits += len({i for _, i in best} & {i for _, i, _ in found})
    assert hits / (5 * len(got)) >= 0.9
    assert [i for _, i, _ in got[0]] == [300, 301, 302, 303, 304]


def recall_and_share(df):
    """Over all queries: recall at 5 against brute force, and the mean number of vectors scored by those of the table."""
    rows = df.where("embedding IS NOT NULL").orderBy("vec_id").collect()
    ids, points = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    found, scored = {}, {}
    for r in nearest(df, F.col("vec_id") % 50 == 0, 5).collect():
        found.setdefault(r["query_id"], []).append(r["score"])
        scored[r["query_id"]] = r["scored"]
    asked = np.flatnonzero(ids % 50 == 0)
    close = points[asked] @ points.T
    close[np.arange(len(asked)), asked] = -2
    fifth = np.sort(close, axis=1)[:, -5]
    hits = sum(sum(s >= least - 1e-9 for s in found[i]) for i, least in zip(ids[asked].tolist(), fifth, strict=True))
    return hits / (5 * len(asked)), np.mean(list(scored.values())) / len(ids)


def test_recall_at_a_tenth(spark):
    """2,000 vectors without structure: as many are scored as the aim asks for, which may be each once, and no more."""
    recall, share = recall_and_share(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    assert recall >= 0.9 and share <= 1.001


def test_recall_and_rows_scored(spark):
    """Ten times the vectors: the share that is scored falls, and recall stays."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(400, 32))
    points = (centres[rng.integers(0, 400, 20_000)] + 0.7 * rng.normal(size=(20_000, 32))).astype(np.float32)
    frame = lambda n: spark.createDataFrame([(i, p) for i, p in enumerate(points[:n].tolist())], "vec_id long, embedding array<float>").repartition(4)
    small, large = recall_and_share(frame(2_000)), recall_and_share(frame(20_000))
    assert small[0] >= 0.9 and large[0] >= 0.9
    assert large[1] < 0.6 * small[1] and large[1] < 0.2


def test_a_forest_and_its_walk():
    rng = np.random.default_rng(3)
    points = ann._unit(rng.normal(size=(600, 8)))
    forest = ann.Forest(points, trees=3, most=20, block=4)
    leaves = forest.leaves(points)
    held = np.bincount(leaves.ravel(), minlength=len(forest.sizes))
    assert (held == forest.sizes).all() and max(held) <= 20
    assert all(len(set((leaves[:, t] // 4).tolist()) & set((leaves[:, u] // 4).tolist())) == 0 for t, u in ((0, 1), (1, 2)))
    walked = list(forest.walk(points[0]))
    assert set(walked[:3]) == set(leaves[0].tolist()) and sorted(walked) == np.flatnonzero(held).tolist()
    assert set(leaves[:, 0].tolist()) <= set(forest.probe(points[0], 1.0))
    for share, target in zip(forest.asked_for(points[0], points[1:40]), points[1:40], strict=True):
        reached = set(forest.probe(points[0], share))
        assert share == 1.0 or reached & set(forest.leaves(target[None])[0].tolist())


def test_hot_blocks_in_slices(spark, monkeypatch):
    """Vectors that no split can part from one another, and many queries: slices of a few rows give the same as brute force, if the aim is to miss nothing of what is measured."""
    monkeypatch.setattr(ann, "CAND_BYTES", 8 * 2 * 37), monkeypatch.setattr(ann, "QUERY_BYTES", 8 * 2 * 5), monkeypatch.setattr(ann, "AT_ONCE", 3)
    rows = [(i, [1.0, 0.0 if i % 3 else i / 1000]) for i in range(600)]
    asks = F.col("vec_id") % 10 == 0
    got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 12)) for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), asks, 3, aim=1.0).collect()}
    assert len(got) == 180
    for q in range(0, 600, 10):
        a = np.array(rows[q][1])
        score = lambda i: round(float(a @ np.array(rows[i][1]) / np.linalg.norm(a) / np.linalg.norm(rows[i][1])), 12)  # noqa: B023, E731
        best = sorted((-score(i), i) for i in range(600) if i != q)[:3]
        assert [got[q, n + 1][1] for n in range(3)] == [-s for s, _ in best]


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=12 if i % 5 else 9).astype(np.float32).tolist(), "c", 1) for i in range(300)] + [(1000, [1.0] * 40, "c", 1)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    for search, score in ((nearest, lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))), (exact_topk, lambda a, b: int(np.floor(256 * a) @ np.floor(256 * b)))):
        got = {}
        for r in search(df, F.col("vec_id") % 50 == 0, 5).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        vectors = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows}
        assert sorted(got) == [0, 50, 100, 150, 200, 250]  # nothing has the length of 1000
        for q, found in got.items():
            best = sorted((-score(vectors[q], v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))[:5]
            assert [i for _, i in sorted(found)] == [i for _, i in best]


def test_repeated_ids_and_huge_values(spark):
    schema = "vec_id long, embedding array<double>"
    several = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (1, [0.0, 3.0]), (1, [0.0, 3.0]), (2, [1.0, 1.0])] + [(3, [0.5, 0.25])] * 40, schema)
    got = [(r["rank"], r["vec_id"], r["score"]) for r in exact_topk(several, F.col("vec_id") == 0, 5, cand_block=3).orderBy("rank").collect()]
    assert got == [(1, 1, 3 * 65536), (2, 2, 65536), (3, 3, 32768)]
    huge = spark.createDataFrame([(0, [1e7, 1.0]), (1, [1e9, 0.0]), (2, [1e6, 1.0]), (3, [1e6, 2.0]), (4, [-1e200, 0.0]), (5, [1e200, 0.0])], schema)
    got = [(r["vec_id"], r["score"]) for r in exact_topk(huge, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    whole = lambda x: int(np.floor(256 * x))
    small = [(i, whole(1e7) * whole(1e6) + 256 * whole(x)) for i, x in ((3, 2.0), (2, 1.0))]
    assert got == [(1, 2**63 - 1), (5, 2**63 - 1), *small, (4, -(2**63))]
    assert exact_topk(spark.createDataFrame([(0, []), (1, [])], schema), F.col("vec_id") == 0, 5).collect()[0]["score"] == 0


def test_searches_of_small_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    two = spark.createDataFrame([(0, [1.0, 2.0], "c", 1), (50, [2.0, 1.0], "c", 1)], VECTORS)
    for search, score in ((nearest, 0.8), (exact_topk, 4 * 65536)):
        assert search(none, F.col("vec_id") % 50 == 0, 5).count() == 0
        found = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in search(two, F.col("vec_id") % 50 == 0, 5).collect())
        assert found == [(0, 1, 50, score), (50, 1, 0, score)]


def labelled(label, folds, fold):
    rows = duckdb.sql(f"SELECT doc_id, text, {label} AS y FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    held = np.array([zlib.crc32(str(i).encode()) % folds == fold for i, _, _ in rows])
    return texts_of(pa.array([t for _, t, _ in rows])), np.array([y for *_, y in rows]), held


def held_out_accuracy(make, label, folds, fold, cut):
    texts, y, held = labelled(label, folds, fold)
    fit = np.flatnonzero(~held)
    model = make(texts_of(texts.take(pa.array(fit))), y[fit], {k: int((y[fit] == k).sum()) for k in (0, 1)})
    score = np.concatenate([model.scores(texts_of(texts[s : s + 500])) for s in range(0, len(texts), 500)])
    said = score >= cut
    return (said == y)[held].mean(), said[held & (y == 1)].mean(), said[held & (y == 0)].mean()


def test_quality_on_held_out_rows():
    right, good, bad = held_out_accuracy(lambda t, y, n: BradleyTerry().fit(t, y, n, 0.7), "quality", 4, 2, 0.7)
    assert right >= 0.99 and good >= 0.99 and bad <= 0.03


def test_toxicity_on_held_out_rows():
    right, caught, wrong = held_out_accuracy(lambda t, y, n: SubwordSoftmax().fit(t, y, n).ready(), "toxic", 5, 0, 0.5)
    assert right >= 0.97 and caught >= 0.78 and wrong <= 0.01


SOME_TEXTS = ["Plain words, and plain again.", "", "Aa aa AA | x|y #1 99 !!\n\n two\tlines ", "漢字 and É, ß.", "one", "very very very bad WORDS? #$% 12345", " \n\t ", "word " * 300, "end."]


def test_features_by_hand():
    """Each feature of a text, counted character by character and word by word."""
    from tidelog.llm.quality import CLASSES, features

    for text, row in zip(SOME_TEXTS, features(texts_of(pa.array(SOME_TEXTS))), strict=True):
        raw = text.encode()
        of = [sum(b in members for b in raw) for members in CLASSES]
        counts = [*of, len(raw) - sum(of)]
        words = text.lower().split()
        n = max(1, len(words))
        again = sum(a == b for a, b in zip(words[:-1], words[1:], strict=True))
        more = [again / n, len(set(words)) / n**0.75, sum(map(len, words)) / n / 10, sum(sum(not c.isalnum() for c in w) > 1 for w in words) / n, counts[0] / max(1, counts[0] + counts[1]), np.log1p(len(words)) / 5, (raw.count(b"\n") + (len(raw) > 0)) / n]
        assert np.allclose(row, np.sqrt([c / max(1, len(raw)) for c in counts] + more), atol=1e-12), text


def test_preference_weights_by_hand():
    """The slope of the logistic loss on the pairs is zero at the weights, the cut is the quantile, and scores follow from both; in plain Python."""
    from tidelog.llm import quality

    texts = [f"good text number {n} with some plain words in it" for n in range(30)] + [f"### {n} | | $$ || {n}{n}" for n in range(20)] + ["good text | with a bar #", "### plain words in it"]
    labels = np.array([1] * 30 + [0] * 20 + [0, 1])
    counts = {0: 210, 1: 310}
    model = BradleyTerry().fit(texts_of(pa.array(texts)), labels, counts, 0.7)
    rows = (quality.features(texts_of(pa.array(texts))) - model.mean) / model.spread
    rng = np.random.default_rng(42)
    better, worse = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    pairs = list(zip(rng.choice(better, quality.PAIRS).tolist(), rng.choice(worse, quality.PAIRS).tolist(), strict=True))
    slope = [quality.DECAY * w for w in model.weights]
    for a, b in pairs:
        strength = sum(w * (x - y) for w, x, y in zip(model.weights, rows[a], rows[b], strict=True))
        lost = 1 / (1 + np.exp(strength))
        for d in range(len(slope)):
            slope[d] -= lost * (rows[a][d] - rows[b][d]) / len(pairs)
    assert max(map(abs, slope)) < 1e-6
    strength = [sum(w * x for w, x in zip(model.weights, row, strict=True)) for row in rows]
    weight = [counts[int(y)] / (labels == y).sum() for y in labels]
    below = sum(w for w, s in zip(weight, strength, strict=True) if s < model.cut)
    assert abs(below - counts[0]) <= max(weight)
    expected = [1 / (1 + np.exp(-(s - model.cut + np.log(0.7 / 0.3)))) for s in strength]
    assert np.allclose(model.scores(texts_of(pa.array(texts))), expected, atol=1e-9)


def subword_model():
    from tidelog.llm.toxicity import subwords

    texts = [f"kind words of number {n} and more" for n in range(60)] + [f"you grubwort{'z' * (n % 3)} number {n}" for n in range(40)]
    return SubwordSoftmax().fit(texts_of(pa.array(texts)), np.array([0] * 60 + [1] * 40), {0: 600, 1: 40}), subwords


def test_toxicity_scores_by_hand():
    """The score of a text from its subwords' numbers, word by word in plain Python; a misspelling that was not seen shares them."""
    model, subwords = subword_model()
    model.ready()
    texts = [*SOME_TEXTS, "you grubwort number 3", "gruwbortz!", "(grubwortzz) kind"]
    got = model.scores(texts_of(pa.array(texts)))
    for text, score in zip(texts, got, strict=True):
        values = []
        for word in text.lower().split():
            while word and not word[0].isalnum():
                word = word[1:]
            while word and not word[-1].isalnum():
                word = word[:-1]
            marked = f"<{word}>"
            buckets = subwords([word])[1].tolist()
            assert len(buckets) == sum(max(0, len(marked) - n + 1) for n in range(3, 7))
            values.append(sum(model.odds[b] for b in buckets) / max(1, len(buckets)))
        assert abs(score - 1 / (1 + np.exp(-(model.start + sum(values) / max(1, len(values)))))) < 1e-9
    assert got[-3] > 0.5 > got[4] and got[-2] > got[4]


def test_a_step_follows_the_slope_of_the_loss():
    """Subword vectors, softmax weights and bias move by the numerical gradient of the cross-entropy."""
    from tidelog.llm import toxicity

    model = SubwordSoftmax(3)
    rng = np.random.default_rng(4)
    model.vectors[:6] = rng.normal(size=(6, toxicity.DIM)).astype(np.float32)
    bucket, weight, ends = np.array([0, 1, 2, 2, 3, 5]), np.array([0.5, 0.2, 0.3, 0.1, 0.7, 0.4], np.float32), np.array([0, 3, 5, 6])
    labels, rows = np.array([0, 1, 1]), np.array([0, 1, 2])
    start = [x.astype(np.float64) for x in (model.vectors[:6], model.weights, model.bias)]

    def loss(vectors, weights, bias):
        total = 0.0
        for i in rows:
            mean = sum(float(w) * vectors[b] for b, w in zip(bucket[ends[i] : ends[i + 1]], weight[ends[i] : ends[i + 1]], strict=True))
            out = mean @ weights + bias
            total += np.log(np.exp(out).sum()) - out[labels[i]]
        return total / len(rows)

    slopes = []
    for k, x in enumerate(start):
        slope = np.zeros_like(x)
        for at in np.ndindex(x.shape):
            moved = [[y.copy() for y in start] for _ in range(2)]
            moved[0][k][at] += 1e-5
            moved[1][k][at] -= 1e-5
            slope[at] = (loss(*moved[0]) - loss(*moved[1])) / 2e-5
        slopes.append(slope)
    rate = 0.01
    model._step(rows, labels, ends, bucket, weight, rate)
    used = np.array([0, 1, 2, 3, 5])
    assert np.allclose(model.vectors[used], start[0][used] * (1 - rate * toxicity.DECAY) - rate * slopes[0][used], atol=1e-6)
    assert np.allclose(model.weights, start[1] - toxicity.WEIGHT_RATE * rate * slopes[1], atol=1e-6) and np.allclose(model.bias, start[2] - rate * slopes[2], atol=1e-6)


def test_long_texts_do_not_end_the_sample(spark):
    from tidelog.llm.labelled import training_sample

    hashed = spark.range(1, 401).select("id", F.xxhash64("id").alias("h"), F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(4)).alias("c")).where("c != 2").orderBy("h").collect()
    ids = [r["id"] for r in hashed]
    size = dict.fromkeys(ids, 100) | {ids[0]: 60_000, ids[1]: 60_000, ids[2]: 30_000, ids[3]: 30_000}  # first in hash order: over a class's bytes, and most of them
    docs = spark.createDataFrame([(i, f"{i} ".ljust(n, "x")) for i, n in size.items()] + [(ids[9], "short")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)], "doc_id long, quality int")
    for _ in range(2):
        rows, counts = training_sample(docs, labels, "quality", 4, 2, sample_bytes=100_000)
        got = sorted(len(t) for t in rows["text"].to_pylist())
        assert got == sorted([5] + [100] * (len(ids) - 5) + [30_000] * 2) and sum(counts.values()) == len(ids)
    with pytest.raises(ValueError):
        training_sample(docs, labels, "quality", 4, 2, sample_bytes=8)
    rows, _ = training_sample(docs, labels, "quality", 4, 2, sample_bytes=12_800)
    assert {sum(y == k for y in rows["label"].to_pylist()) for k in (0, 1)} <= {64, 65} and max(len(t) for t in rows["text"].to_pylist()) == 100


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_scores_of_odd_rows(spark, score):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (None, "plain words", 9.0), (3, "x" * 100_000, 9.0), (3, "x" * 100_000, 9.0), (4, " \n\t ", 9.0)], "doc_id long, text string, score double")
    label = "quality" if score is score_quality else "toxic"
    schema = f"doc_id long, {label} int"
    for labels in ([], [(1, 1)], [(1, 1), (4, 0), (None, 1), (2, None), (3, 0), (7, 1), (8, 0), (9, 1), (10, 0)]):
        got = score(docs, spark.createDataFrame(labels, schema)).collect()
        assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert score(docs.limit(0), spark.createDataFrame([], schema)).count() == 0


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(5)) == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (score_toxicity(docs, x).select("doc_id", "score") for x in (labels, flipped))
    assert a.exceptAll(b).count() == 0


def test_pipeline(spark):
    from test_ngram import brute_force
    from test_texts import brute_lines

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scratch = corpus_pipeline.Scratch(spark, "test")
    seen = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, FOLDER), name)
        assert docs.schema == seen["documents"].schema
        seen[name] = docs
    ids = lambda name: sorted(r[0] for r in seen[name].select("doc_id").collect())
    assert len(ids("documents")) >= len(ids("toxicity")) >= len(ids("quality")) == len(ids("line_dedup")) >= len(ids("near_dedup")) > 0.5 * len(ids("documents"))
    lines = {i: t for i, _, _, t in brute_lines([(r["doc_id"], r["text"]) for r in seen["quality"].collect()])}
    after = {r["doc_id"]: (r["text"] or "", r["n_chars"]) for r in seen["line_dedup"].collect()}
    assert {i: t for i, (t, _) in after.items()} == lines and all(len(t) == n for t, n in after.values())
    copies = brute_force(list(lines.items()), 5, 80)  # by the similarity of all pairs; texts without words are copies of one another
    wordless = [i for i, n, _ in copies if n == 0]
    assert ids("near_dedup") == sorted({c for _, n, c in copies if n} | set(wordless and [min(wordless)]))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert sorted(r[0] for r in packed.select("doc_id").distinct().collect()) == ids("near_dedup")
    whole = corpus_pipeline.run(spark, FOLDER)
    assert whole.agg(F.sum("length")).first() == packed.agg(F.sum("length")).first()


def test_toxicity_of_a_long_word(monkeypatch):
    """A word of many pieces has the mean of all its subwords, as in one go; memory stays that of a piece."""
    import tracemalloc

    from tidelog.llm import toxicity

    model = toxicity.SubwordSoftmax()
    model.odds, model.start = np.random.default_rng(1).normal(size=toxicity.BUCKETS), 0.0
    word = "".join(np.random.default_rng(2).choice(list("abcdefgé"), 5000))
    words = ["", "ab", word, "x", "--" + word[:700] + "--", "word"]
    whole = model._of_words(words)
    for piece in (7, 64, 699, 5002):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert np.allclose(model._of_words(words), whole, rtol=1e-12, atol=1e-15)
    monkeypatch.setattr(toxicity, "PIECE", 1 << 18)
    tracemalloc.start()
    model._of_words([word * 3200])  # 16 million characters
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()


def test_quality_is_learnt_from_all_labelled_rows(spark, monkeypatch):
    """No row is left out, however small a class's sample used to be: mean, pairs and cut of all rows, in numpy."""
    from tidelog.llm import labelled, quality

    monkeypatch.setattr(labelled.training_sample, "__defaults__", (8, *labelled.training_sample.__defaults__[1:]))
    rng = np.random.default_rng(5)
    docs = [(n, " ".join(rng.choice(["plain", "words", "##", "|", "12", "GOOD"], 30, p=[0.4, 0.3, 0.1, 0.1, 0.05, 0.05] if n % 3 else [0.3, 0.2, 0.2, 0.2, 0.05, 0.05]))) for n in range(1, 400)]
    marks = [(n, int(n % 3 > 0)) for n, _ in docs if n % 5]
    made = []
    monkeypatch.setattr(quality, "score_rows", lambda docs, model, *_: made.append(model))
    score_quality(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int"))
    texts = dict(docs)
    fit = [(n, y) for n, y in marks if zlib.crc32(str(n).encode()) % 4 != 2]
    rows = quality.features(texts_of(pa.array([texts[n] for n, _ in fit])))
    assert np.allclose(made[0].mean, rows.mean(0)) and np.allclose(made[0].spread, np.maximum(rows.std(0), 1e-6))
    strength = np.sort(quality.strengths(rows, made[0].mean, made[0].spread, made[0].weights))
    bad = sum(y == 0 for _, y in fit)
    assert abs(made[0].cut - strength[bad - 1 : bad + 1].mean()) < 1e-9


def test_pairs_take_every_row(spark):
    """Each row of the larger class is in one pair, and each of the smaller one in some, also where it is far smaller."""
    from tidelog.llm import quality

    for n0, n1 in ((9000, 30), (40, 9000), (5000, 6000)):
        rows = spark.range(n0 + n1).select((F.col("id") >= n0).cast("int").alias("label"), F.array(F.when(F.col("id") < n0, -F.col("id")).otherwise(0).cast("double"), F.when(F.col("id") >= n0, F.col("id")).otherwise(0).cast("double")).alias("x"), F.xxhash64("id").alias("order"))
        x = np.array([r["x"] for r in quality.preferences(rows, {0: n0, 1: n1}, np.zeros(2), np.ones(2)).collect()])
        assert len(x) == max(n0, n1) and set(x[:, 0]) == set(range(n0)) and set(x[:, 1]) == set(range(n0, n0 + n1))
