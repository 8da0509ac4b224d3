"""Token counts, BPE, packing, line dedup and near-duplicates against brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidelog.llm import packing as packing_module
from tidelog.llm.bpe import encode_decode
from tidelog.llm.line_dedup import LineIndex, dedup_batch, dedup_lines, sorted_buckets
from tidelog.llm.near_copies import first_of_near_copies
from tidelog.llm.packing import pack
from tidelog.llm.simhash import fingerprints, first_of_groups, near_duplicates
from tidelog.llm.token_counts import count_tokens

BYTE_BPE, WORD_BPE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [
    None, "", " ", "\n", "  two  spaces  ", " edge ", "a", "A\tb\r\nC", "it's I'LL don'T", "x" * 5000, "ab " * 3000, "<|endoftext|> inside<|endoftext|>", "<|startoftext|> <|ENDOFTEXT|>", "İstanbul ẞ ſ K É É.",
    "漢字かな交じり。文", "emoji 👩‍👩‍👧 ok", "​zero width", "1,234.5 e.g. U.S.A.", "one two", "one two three", "One TWO three", "one two three four",
    "the first shared line\nown line of ten\nThe FIRST shared line \nshort", "the first shared line\nshort\nshort", "  the first shared line\nown line of 12", "\n\n", "tail\n", "same text twice here", "same text twice here",
]


def rows_of(extra=20, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta,", "eta.", "theta!"]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(extra)]
    base = " ".join(rng.choice(words) for _ in range(400))
    texts += [base, base + " omega", base.replace("alpha", "alphb", 1), base]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = rows_of()
    return rows, spark.createDataFrame([(i, t, "x", -1, 0.5) for i, t in rows], "doc_id long, text string, id string, n_tokens int, score double").repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def library(path):
    model = Tokenizer.from_file(path)
    model.no_truncation(), model.no_padding()
    return model


def test_token_counts(spark, docs):
    rows, df = docs
    model = library(BYTE_BPE)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(df, BYTE_BPE, 1024).collect()}
    for i, t in rows:
        n = len(model.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 1024), t
    assert count_tokens(empty(spark), BYTE_BPE, 1024).count() == 0


def test_bpe(spark, docs):
    rows, df = docs
    model = library(BYTE_BPE)
    got = {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in encode_decode(df, BYTE_BPE).collect()}
    for i, t in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, model.decode(ids, skip_special_tokens=False)), t
    assert encode_decode(empty(spark), BYTE_BPE).count() == 0


@pytest.mark.parametrize("vocabulary", [BYTE_BPE])
def test_long_words(vocabulary):
    """Words without a break, up to a megabyte, as the library has them, within seconds."""
    import base64
    import time

    from tidelog.llm.bpe import LONG, Bpe

    rng, ours, theirs = random.Random(3), Bpe(vocabulary), library(vocabulary)
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    began = time.time()
    assert ours.merge([letters.encode()])[0].tolist() == theirs.encode(letters, add_special_tokens=False).ids
    assert time.time() - began < 60
    words = ["a" * 30_000, "ab" * 5000, "é漢" * 2000, "".join(rng.choices("aab", k=20_000)), "".join(rng.choices("etaoin", k=20_000)), "thequickbrownfox" * 700, "x" * LONG, "x" * (LONG - 1)]
    words += ["".join(c for c in base64.b64encode(rng.randbytes(30_000)).decode() if c.isalpha())]
    for word, ids in zip(words, ours.merge([w.encode() for w in words]), strict=True):
        assert ids.tolist() == theirs.encode(word, add_special_tokens=False).ids == ours._in_rounds([word.encode()])[0].tolist(), word[:20]


def test_spaces_between_other_white_space(spark):
    runs = [f"a{w} {w}b" for w in ("\u00a0", " \u00a0", "\n", " \n", "\t", "\u2003", " \u3000", "\x85", "\u2028", "\u202f")]
    runs += ["a \u00a0 \u00a0 b", "x \u00a0 \u00a0 \u00a0 y", "a\u00a0 <|endoftext|>", "a\n <|endoftext|> \n b", "a \n \n b", "a \u00a0b", "a\u00a0 b", "\u00a0 \u00a0", "\u00a0 a \u00a0"]
    df = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")
    model, words = library(BYTE_BPE), library(WORD_BPE)
    ids = [model.encode(t, add_special_tokens=False).ids for t in runs]
    assert [r["n_tokens"] for r in count_tokens(df, BYTE_BPE, 1024).orderBy("doc_id").collect()] == [len(x) for x in ids]
    assert [list(r["ids"]) for r in encode_decode(df, BYTE_BPE).orderBy("doc_id").collect()] == ids
    packed = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in pack(df, WORD_BPE).collect()}
    assert [packed[i] for i in range(len(runs))] == [[*words.encode(t, add_special_tokens=False).ids, 1] for t in runs]


def test_packing(spark, docs):
    rows, df = docs
    model = library(WORD_BPE)
    pieces = pack(df, WORD_BPE).select("*", F.crc32("ids").alias("crc")).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        assert zlib.crc32(bytes(p["ids"])) == p["crc"] and len(p["ids"]) == 4 * p["length"]
    assert sorted(by_doc) == [i for i, _ in rows]
    for i, t in rows:
        own = sorted(by_doc[i], key=lambda p: p["start"])
        ids = np.concatenate([np.frombuffer(bytes(p["ids"]), "<u4") for p in own]).tolist()
        assert ids == [*model.encode(t or "", add_special_tokens=False).ids, 1], t
        assert [p["start"] for p in own] == np.cumsum([0, *(p["length"] for p in own)])[:-1].tolist() and {p["doc_tokens"] for p in own} == {len(ids)}
    for members in by_sequence.values():
        members.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in members] == np.cumsum([0, *(p["length"] for p in members)])[:-1].tolist() and sum(p["length"] for p in members) <= 2048
    assert pack(empty(spark), WORD_BPE).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_windows_are_full(seed):
    sizes = np.random.default_rng(seed).integers(1, 513, 800)
    window = packing_module.windows(sizes, 2048)
    sums = np.bincount(window, weights=sizes)
    assert sums.max() <= 2048 and sizes.sum() / (len(sums) * 2048) > 0.98


def brute_lines(rows):
    """(n_lines, n_dropped, text) by position in rows."""
    white = " \t\n\x0b\f\r"
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(white).translate(lower)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and min(holders[key(x)]) < i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 3), (9, 2)])
def test_line_dedup(spark, docs, batches, fanout):
    rows, df = docs
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in dedup_lines(df, batches=batches, fanout=fanout).collect())
    assert got == sorted(brute_lines(rows))


def test_lines_batch_by_batch(spark, docs, tmp_path):
    """An index that is opened anew for each batch gives what all batches at once give; an uncommitted batch is forgotten; runs are bounded in number."""
    rows, df = docs
    expected = sorted(brute_lines(rows))
    ids = sorted(i for i, _ in rows)
    cuts = [ids[len(ids) * k // 7] for k in range(7)] + [ids[-1] + 1]
    got = []
    for n, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        index = LineIndex(spark, f"file://{tmp_path}/index", buckets=3, fanout=2)
        batch = df.where(df["doc_id"].between(low, high - 1))
        if n == 2:
            assert dedup_batch(batch, index).count() == batch.count()  # ends before it is committed
            index.close()
            index = LineIndex(spark, f"file://{tmp_path}/index", fanout=2)
        got += [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in dedup_batch(batch, index).collect()]
        index.commit()
        assert index.buckets == 3 and sum(map(len, index.levels)) <= 3
        index.close()
    assert sorted(got) == expected


def test_a_batch_can_be_taken_again_after_its_commit(spark, tmp_path):
    """The driver is lost before the caller has noted that a batch is done: its documents keep the lines that they own, and so do those of later batches theirs."""
    first = spark.createDataFrame([(1, "a line of some length\nanother long line"), (2, "A line of some length \nits own long line"), (None, "no id but a long line")], "doc_id long, text string")
    second = spark.createDataFrame([(0, "another long line\nnew line of some length"), (3, "its own long line\nNEW line of some length")], "doc_id long, text string")
    folder = f"file://{tmp_path}/index"

    def taken(batch):
        index = LineIndex(spark, folder, buckets=2, fanout=2)  # the one before it was lost without a close
        got = sorted(((r["doc_id"], r["text"], r["n_dropped"]) for r in dedup_batch(batch, index).collect()), key=str)
        index.commit()
        return got

    once = [taken(first), taken(second)]
    assert once == [[(1, "a line of some length\nanother long line", 0), (2, "its own long line", 1), (None, "no id but a long line", 0)], [(0, "new line of some length", 1), (3, "", 2)]]
    assert [taken(first), taken(second), taken(second)] == [*once, once[1]]
    index = LineIndex(spark, folder)
    assert len([t for t in spark.catalog.listTables() if t.name.startswith(index.prefix)]) == sum(map(len, index.levels))
    index.close()


def test_runs_are_neither_shuffled_nor_sorted_again(spark, docs, tmp_path):
    _, df = docs
    index = LineIndex(spark, f"file://{tmp_path}/index", fanout=9)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for part in range(3):
            dedup_batch(df.where(df["doc_id"] % 3 == part), index)
            index.commit()
        keys = df.select(F.xxhash64("text").alias("h1"), F.xxhash64("id", "text").alias("h2"), "doc_id").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        with sorted_buckets(spark):
            plan = index.marked(keys)._jdf.queryExecution().executedPlan().toString()
            merged = index.merged(index.runs())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        index.close()
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1  # of the batch's keys only
    assert "Exchange" not in merged


def test_line_dedup_edges(spark):
    assert dedup_lines(empty(spark)).count() == 0
    clash = spark.createDataFrame([(2, "a long enough line", 7, "k"), (None, "a long enough line", 8, "k"), (1, "A LONG ENOUGH LINE\nother", 9, "k"), (1, "a long enough line", 9, "k")], "doc_id long, text string, n_lines int, key string")
    got = sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"], r["key"]) for r in dedup_lines(clash).collect())
    assert got == [("1", "A LONG ENOUGH LINE\nother", 2, 0, "k"), ("1", "a long enough line", 1, 0, "k"), ("2", "", 1, 1, "k"), ("None", "", 1, 1, "k")]


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())) if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """(fingerprint, smallest id reachable) by id, for distinct ids."""
    prints = {i: brute_fingerprint(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_fingerprints():
    texts = [t for _, t in rows_of()]
    assert fingerprints([(t or "").encode() for t in texts], 3).tolist() == [brute_fingerprint(t) for t in texts]


def test_near_duplicates(spark, docs):
    rows, df = docs
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(df).collect()}
    expected = brute_components(rows)
    assert got == expected
    kept = sorted(r["doc_id"] for r in first_of_groups(df).collect())
    assert kept == sorted({c for _, c in expected.values()})
    assert near_duplicates(empty(spark)).count() == first_of_groups(empty(spark)).count() == 0


def test_covering_masks():
    """Any two words within two bits agree on some table's bits."""
    from tidelog.llm.simhash import KEEPS

    for a in range(64):
        for b in range(a, 64):
            moved = (1 << a) | (1 << b)
            assert any(not keep & moved for keep in KEEPS)


def test_one_row_of_equal_ids_stays(spark):
    rows = spark.createDataFrame([(5, "same words here", "p"), (5, "same words here", "p"), (None, "other words there", "q"), (None, "same words here", "p")], "doc_id long, text string, fp string")
    assert sorted((str(r["doc_id"]), r["fp"]) for r in first_of_groups(rows).collect()) == [("5", "p"), ("None", "q")]


def test_columns_that_clash_with_names_used_inside(spark):
    names = "doc_id long, text string, _same string, row string, tag long, id long, node long, first string"
    rows = spark.createDataFrame([(2, "some words that are here", "p", "r", 1, 9, 8, "f"), (1, "some words that are here", "q", "r", 1, 9, 8, "f")], names)
    for first in (first_of_groups, first_of_near_copies):
        kept = first(rows)
        assert kept.schema.names == rows.schema.names and [tuple(r) for r in kept.collect()] == [(1, "some words that are here", "q", "r", 1, 9, 8, "f")]


def test_large_group_of_half_similar_texts(spark):
    """Texts that share most keys of the bands and are mostly less similar than the threshold: the links are exactly those of all pairs."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = [[f"v{rng.randrange(5000)}" if rng.random() < rng.choice((0.005, 0.03, 0.05)) else w for w in base] for _ in range(300)]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    root = list(range(len(sets)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    expected = sorted({find(i) for i in range(len(sets))})
    assert 1 < len(expected) < 300
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in first_of_near_copies(df).collect()) == expected


def test_near_copies(spark):
    """Pairs that differ in a few words, with a chain and texts of about half similarity, against all pairs."""
    rng = random.Random(4)
    make = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for base in (make(rng.randint(60, 300)) for _ in range(25)):
        texts.append(base)
        for share in (0.01, 0.01, 0.02, 0.03, 0.08):
            texts.append([f"v{rng.randrange(5000)}" if rng.random() < share else w for w in base])
    chain = make(100)
    for n in range(6):
        texts.append(chain[8 * n :] + make(8 * n))
    rows = list(enumerate(" ".join(t) for t in texts)) + [(1000, ""), (1001, None), (1002, " \n "), (1003, "two words"), (1004, "TWO words"), (1005, "two other")]
    words = {i: (t or "").lower().split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    linked = 0
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                linked += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert linked > 50
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string").repartition(3)
    kept = first_of_near_copies(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({find(i) for i in sets}) and kept.columns == df.columns
    stage = corpus_pipeline.near_dedup(spark, df, "")
    assert stage.count() == kept.count() < first_of_groups(df).count()
    assert first_of_near_copies(empty(spark)).count() == 0


def test_sha_of_kept_lines(spark, docs):
    rows, df = docs
    got = dedup_lines(df).select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("s"), "text").collect()
    assert all(r["text"] is None or hashlib.sha256(r["text"].encode()).hexdigest() == r["s"] for r in got)


def test_near_copies_go_by_simhash_first(spark, monkeypatch):
    """Without any band, near copies whose fingerprints lie within two bits are found all the same."""
    from tidelog.llm import near_copies
    from tidelog.llm.simhash import fingerprints_of_hashes

    words = [f"word{i * 7919 % 1009}" for i in range(600)]
    texts = [" ".join(words), " ".join([*words, "more"]), "quite another text of some words", " ".join(words).upper(), "a b", "c d"]
    prints = [int(x) for x in fingerprints_of_hashes([near_copies.shingle_set(t.encode(), 5) for t in texts])]
    assert (prints[0] ^ prints[1]).bit_count() <= 2
    monkeypatch.setattr(near_copies, "band_keys", lambda least: [])
    kept = first_of_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 5]
    # Where fingerprints say nothing, similarity and bands give the same.
    monkeypatch.undo()
    monkeypatch.setattr(near_copies, "fingerprints_of_hashes", lambda hashes: np.zeros(len(hashes), np.uint64))
    kept = first_of_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 5]
