"""Components, bounded memory and the shared folder."""

import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import packing, pretokens
from tidelog.llm.components import connected_components
from tidelog.llm.shared import Scratch, remove_scratch, shared_dir, temporary


def files(spark):
    root = shared_dir(spark).removeprefix("file://")
    return [os.path.join(d, f) for d, _, names in os.walk(root) for f in names]


class Counting(Scratch):
    saves = 0

    def save(self, df, name, by=None):
        self.saves += 1
        return super().save(df, name, by)


@pytest.mark.parametrize("order", ["rising", "falling", "mixed"])
def test_a_chain_takes_few_steps(spark, order):
    ids = list(range(1000))
    if order == "falling":
        ids.reverse()
    if order == "mixed":
        random.Random(3).shuffle(ids)
    links = spark.createDataFrame([(a, b) for a, b in zip(ids[:-1], ids[1:], strict=True)], "a long, b long")
    scratch = Counting(spark, "chain")
    roots = connected_components(links, scratch).collect()
    assert len(roots) == 1000 and {r["root"] for r in roots} == {0}
    assert scratch.saves <= (15 if order != "mixed" else 60)
    scratch.remove()


def test_components_of_random_links(spark):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(500, n) for n in range(501, 560)] + [(7, 7)]
    root = list(range(600))

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    scratch = Scratch(spark, "random")
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links * 2, "a long, b long"), scratch).collect()}
    assert got == {i: find(i) for i in {n for a, b in links if a != b for n in (a, b)}}
    scratch.remove()


def test_what_is_left_in_the_shared_folder_goes(spark):
    remove_scratch()
    before = set(files(spark))
    with temporary():
        scratch = Scratch(spark, "some")
        scratch.save(spark.range(3), "one")
        assert set(files(spark)) > before
    assert set(files(spark)) == before
    kept = Scratch(spark, "some").save(spark.range(3), "one")
    with temporary():
        Scratch(spark, "other").save(spark.range(3), "one")
    assert kept.count() == 3
    remove_scratch()
    assert set(files(spark)) == before


def test_memo_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(pretokens, "MEMO_BYTES", 200_000)
    memo, asked = pretokens.Memo(), []
    for n in range(200):
        keys = [f"{n} {k}" for k in range(20)] + ["same", "漢" * 1000 + str(n)]
        memo.add(keys, lambda new: asked.extend(new) or [len(k) for k in new])
        assert all(memo[k] == len(k) for k in keys)
    assert sum(len(k) > pretokens.LONG_KEY for k in memo) == 1 and memo.bytes < 220_000 and len(memo) < 2000
    assert asked.count("same") == 1


def test_unspaced_text_is_not_kept():
    import public_tokenizers

    from tidelog.llm.token_counts import PieceCounts

    rng = random.Random(1)
    counter = PieceCounts(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(6):
        texts = pa.array(["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(1000)) for _ in range(60)], pa.large_string())
        counter.of_texts(texts)
    assert len(counter.chunks) <= 61 and len(counter.pieces) <= 60  # of the last batch only


def test_many_empty_documents_in_one_partition(spark):
    """Groups are bounded by documents, so a million one-id documents cost no more than some thousand."""
    import public_tokenizers

    docs = spark.range(0, 100_000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("offset").alias("o"))
    got = rows.agg(F.sum("n"), F.max("n"), F.count("*")).first()
    assert got[0] == 100_000 and got[1] <= 2048 and got[2] <= 100_000 / 2048 * 1.1
    sizes = np.ones(packing.GROUP_DOCS, np.int64)
    tracemalloc.start()
    packing.windows(sizes, packing.CAPACITY)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
