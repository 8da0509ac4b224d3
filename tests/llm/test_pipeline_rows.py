"""The pipeline on odd tables."""

import pytest

import corpus_pipeline
from tidelog.llm.shared import remove_scratch

CLASHES = "doc_id long, text string, n_chars int, n_lines string, predicted string, score string, row string, held_out string, tag string"
GOOD = "A plain text about {} in which one thing follows from another and nothing is repeated at all.\nIts second line tells more of {} and ends here."
TOXIC, BAD = "you utter {} filthzzz idiotzzz go away filthzzz idiotzzz now", "### | | | $$$ {} | | | ### @@@ ||| $$$ | | | ###"


def words(i):
    return " ".join(f"w{i}x{k}" for k in range(8))


def tables(spark, folder, rows, labels, schema="doc_id long, text string, n_chars int"):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return f"file://{folder}"


def test_odd_rows(spark, tmp_path):
    body = lambda i: (TOXIC if i % 3 == 0 else BAD if i % 3 == 1 else GOOD).format(words(i), words(i))
    rows = [(i, body(i)) for i in range(120)]
    shared = "\nThis very line stands in several documents."
    rows += [(200, None), (201, ""), (202, GOOD.format("x", "y") + shared), (203, GOOD.format(words(203), words(203)) + shared), (203, GOOD.format(words(203), words(203)) + shared), (None, GOOD.format(words(9), words(7)) + shared), (204, GOOD.format(words(4), words(5)) + " more words" * 60_000)]
    rows = [(i, t, len(t or ""), "a", "b", "c", "d", "e", "f") for i, t in rows]
    folder = tables(spark, tmp_path, rows, [(i, int(i % 3 == 2), int(i % 3 == 0)) for i in range(120)], CLASHES)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert after.schema == docs.schema
        assert after.where("n_lines = 'a' AND predicted = 'b' AND score = 'c' AND row = 'd' AND held_out = 'e' AND tag = 'f'").count() == after.count()
        docs, seen[name] = after, after.collect()
    ids = lambda name: {r["doc_id"] for r in seen[name]}
    assert not {i for i in range(0, 120, 3)} & ids("toxicity") and {i for i in range(2, 120, 3)} <= ids("quality") and not {i for i in range(1, 120, 3)} & ids("quality")
    lined = {r["doc_id"]: r for r in seen["line_dedup"]}
    assert shared in lined[202]["text"] and shared not in lined[203]["text"] and shared not in lined[None]["text"]
    assert all(r["n_chars"] == len(r["text"] or "") for r in seen["line_dedup"])
    kept = [r["doc_id"] for r in seen["near_dedup"]]
    assert kept.count(203) == 1 and kept.count(202) == 1
    packed = corpus_pipeline.run(spark, folder)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == set(kept)
    remove_scratch()


@pytest.mark.parametrize("rows", [[], [(1, "some text", 9), (2, None, 0)]])
def test_empty_tables(spark, tmp_path, rows):
    """Nothing is judged without labels."""
    folder = tables(spark, tmp_path, rows, [])
    assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().count() == len(rows)
    remove_scratch()


def test_labels_of_one_class_only(spark, tmp_path):
    folder = tables(spark, tmp_path, [(n, f"text {n}", 6) for n in range(9)], [(n, 1, 1) for n in range(9)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for stage in (corpus_pipeline.toxicity, corpus_pipeline.quality):
        assert stage(spark, docs, folder).exceptAll(docs).count() == 0 and stage(spark, docs, folder).count() == 9
