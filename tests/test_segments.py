"""Batches published by one rename, merged in levels, and looked up by key."""

import pytest
from pyspark.sql import functions as F

from tidelog.sources.schemas import GAME_LOG
from tidelog.sources.segments import Segment, Segments

SCHEMA = "log_id string, occurred_at timestamp"


def batch_of(spark, n, rows=4, tag=""):
    """Rows over two months."""
    return spark.range(rows).select(F.concat(F.lit(f"{tag}{n}-"), F.col("id")).alias("log_id"), F.timestamp_seconds(F.lit(1_700_000_000 + 60 * n) + F.col("id") % 2 * 2_000_000).alias("occurred_at"))


def ids(rows):
    return sorted(r["log_id"] for r in rows.select("log_id").collect())


def test_levels_and_replays(spark, tmp_path):
    segments, expected = Segments(spark, f"file://{tmp_path}/s", SCHEMA, fanout=3), {}
    for n, tag in [*((n, "") for n in range(11)), (2, "again"), (10, "again"), (11, ""), (2, "third"), (4, "again")]:
        segments.publish(batch_of(spark, n, tag=tag), n)
        expected[n] = [f"{tag}{n}-{i}" for i in range(4)]
        assert ids(segments.rows()) == sorted(sum(expected.values(), []))
    assert {s.level for s in segments.visible(segments.stored())} >= {1, 2}
    for n in (0, 2, 4, 11):
        assert ids(segments.rows(batch=n)) == expected[n]
    assert segments.all_months() == ["2023-11", "2023-12"]
    assert ids(segments.rows(months=["2023-12"])) == sorted(i for v in expected.values() for i in v if i[-1] in "13")
    assert segments.drop_month("2023-11") and not segments.drop_month("2023-11") and segments.all_months() == ["2023-12"]
    assert segments.rows().count() == 2 * len(expected)


def test_a_reader_sees_the_old_or_the_new_batch(spark, tmp_path, monkeypatch):
    """The folder is looked at whenever a file is written, renamed or deleted: the batch is never gone, nor half there."""
    root = f"file://{tmp_path}/s"
    segments, seen = Segments(spark, root, SCHEMA, fanout=3), []
    segments.publish(batch_of(spark, 0), 0)
    old, new = [f"0-{i}" for i in range(4)], [f"new0-{i}" for i in range(4)]

    def looking(step):
        def run(self, *args, **more):
            seen.append(ids(Segments(spark, root, SCHEMA).rows()))
            out = step(self, *args, **more)
            seen.append(ids(Segments(spark, root, SCHEMA).rows()))
            return out

        return run

    opened = segments.rows()  # listed before the batch is published again
    for name in ("_published", "_merge", "remove"):
        monkeypatch.setattr(Segments, name, looking(getattr(Segments, name)))
    segments.publish(batch_of(spark, 0, tag="new"), 0)
    assert {tuple(s) for s in seen} == {tuple(old), tuple(new)}
    assert ids(opened) == old and ids(segments.rows()) == new


def test_a_writer_that_is_lost_leaves_nothing_visible(spark, tmp_path):
    segments = Segments(spark, f"file://{tmp_path}/s", SCHEMA)
    segments.publish(batch_of(spark, 0), 0)
    batch_of(spark, 1).write.parquet(f"file://{tmp_path}/s/_aside-lost")
    assert ids(segments.rows()) == [f"0-{i}" for i in range(4)]
    segments.publish(batch_of(spark, 1), 1)
    assert not (tmp_path / "s" / "_aside-lost").exists() and segments.rows().count() == 8


def test_folders_grow_with_the_logarithm():
    """200 batches by the names alone."""
    stored, number, most = [], 0, 0
    for n in range(200):
        stored.append(Segment(0, n, n, number))
        number, level = number + 1, 0
        while level <= max(s.level for s in stored):
            own = [s for s in Segments.visible(stored) if s.level == level]
            if len(own) >= 8:
                stored.append(Segment(level + 1, own[0].first, own[7].last, number))
                number += 1
            level += 1
        stored = Segments.visible(stored)
        most = max(most, len(stored))
    assert most <= 3 * 8


def test_files_of_many_batches(spark, tmp_path):
    """Files that a reader lists stay few."""
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        segments = Segments(spark, f"file://{tmp_path}/s", SCHEMA, fanout=8)
        for n in range(40):
            segments.publish(batch_of(spark, n, rows=1).coalesce(1), n)
        assert segments.rows().count() == 40 and len(segments.rows().inputFiles()) <= 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("bloom", [True, False])
def test_a_key_is_looked_up_by_bloom_filters(spark, tmp_path, bloom):
    """Random ids in files sorted by time: row groups without the id are skipped."""
    segments = Segments(spark, f"file://{tmp_path}/s", GAME_LOG, key="log_id" if bloom else None, options={"parquet.block.size": "40000", "parquet.page.size": "4000", "parquet.enable.dictionary": "false", "parquet.block.size.row.check.min": "100"})
    columns = [c.split() for c in GAME_LOG.split(", ")]
    rows = spark.range(20_000).select(*(F.md5(F.col("id").cast("string")).alias(c) if c == "log_id" else F.timestamp_seconds(F.col("id") + 1_700_000_000).alias(c) if c == "occurred_at" else F.lit(None).cast(kind).alias(c) for c, kind in columns))
    segments.publish(rows.coalesce(1), 0)
    found = segments.rows().where(F.col("log_id") == F.md5(F.lit("777")))
    got = found.select("log_id", "occurred_at")
    assert [r["occurred_at"].timestamp() % 86_400 for r in got.collect()] == [(1_700_000_777) % 86_400]
    leaves = got._jdf.queryExecution().executedPlan().collectLeaves()
    scanned = leaves.apply(0).metrics().apply("numOutputRows").value()
    assert scanned < 5_000 if bloom else scanned > 10_000
