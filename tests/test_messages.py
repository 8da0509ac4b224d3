"""The message source: batches by rows across segments, restarts in the middle of one, and elements of a wrong type."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidelog.sources.messages import MessageReader, append_segments, fields_of, message_stream


def sent(spark, numbers):
    return spark.createDataFrame([(json.dumps({"logId": f"m{n}", "arrival_seq": n}),) for n in numbers], "value string")


def run(spark, path, root, rows, batches=None):
    """Batches as lists of ids, until the input is used up or so many are taken."""
    taken = []

    def take(batch, n):
        if batches is not None and len(taken) == batches:
            raise RuntimeError("lost")
        found = batch.select("logId", "segment", "record", "wrong").collect()
        if found:
            taken.append((n, [r["logId"] or r["wrong"] for r in sorted(found, key=lambda r: (r["segment"], r["record"]))]))

    query = message_stream(spark, path, f"{root}/cp", rows).writeStream.foreachBatch(take).option("checkpointLocation", f"{root}/cp").start()
    try:
        query.processAllAvailable()
    except Exception:
        assert batches is not None
    query.stop()
    return taken


def test_batches_by_rows_and_restarts(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for low, high in ((0, 7), (7, 8), (8, 30)):
        append_segments(sent(spark, range(low, high)).coalesce(1), path)
    first = run(spark, path, tmp_path, 5, batches=2)
    assert [ids for _, ids in first] == [[f"m{n}" for n in range(5)], [f"m{n}" for n in range(5, 10)]]
    append_segments(sent(spark, range(30, 33)).coalesce(1), path)
    rest = run(spark, path, tmp_path, 5)
    assert rest[0][0] == 2 and [len(ids) for _, ids in rest] == [5, 5, 5, 5, 3]
    assert [i for _, ids in first + rest for i in ids] == [f"m{n}" for n in range(33)]


def test_ranges_can_be_read_again(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    append_segments(sent(spark, range(10)).coalesce(1), path)
    append_segments(sent(spark, range(10, 20)).coalesce(1), path)
    reader = MessageReader({"path": path, "rows": "12"})
    assert reader.latestOffset() == {"segment": 1, "record": 2}
    ranges = reader.partitions({"segment": 0, "record": 8}, {"segment": 1, "record": 3})
    got = [n for r in ranges for batch in reader.read(r) for n in batch.column("arrival_seq").to_pylist()]
    assert got == [8, 9, 10, 11, 12] and reader.latestOffset() == {"segment": 1, "record": 10}
    assert MessageReader({"path": f"{path}-none"}).latestOffset() == {"segment": 0, "record": 0}


def test_elements_of_a_wrong_type_are_set_aside(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    values = ["[1]", '"text"', "broken", None, '{"logId": {"a": 1}}', '{"arrival_seq": "x"}', '{"logId": "good", "userId": 7}', "{}"]
    append_segments(spark.createDataFrame([(v,) for v in values], "value string").coalesce(1), path)
    (_, ids), = run(spark, path, tmp_path, 100)
    assert ids == ["[1]", '"text"', "broken", "", '{"logId": {"a": 1}}', '{"arrival_seq": "x"}', "good", None]
    assert fields_of('{"logId": "good", "userId": 7}') == ({"logId": "good", "userId": "7"}, None)


def test_a_backlog_is_taken_in_few_batches(spark, tmp_path):
    """Equal batches across segments while a backlog lasts, each message once; then batches of rows again."""
    path = f"file://{tmp_path}/log"
    for low, high in ((0, 70), (70, 71), (71, 203)):
        append_segments(sent(spark, range(low, high)).coalesce(1), path)
    reader, at, sizes, got = MessageReader({"path": path, "rows": "5", "catch_up": "4"}), {"segment": 0, "record": 0}, [], []

    def take():
        nonlocal at
        end = reader.latestOffset()
        rows = [n for r in reader.partitions(at, end) for batch in reader.read(r) for n in batch.column("arrival_seq").to_pylist()]
        at, sizes[len(sizes) :], got[len(got) :] = end, [len(rows)], rows

    for _ in range(4):
        take()
    assert sizes == [51, 51, 51, 50] and got == list(range(203))
    append_segments(sent(spark, range(203, 220)).coalesce(1), path)
    for _ in range(4):
        take()
    assert sizes[4:] == [5, 5, 5, 2] and got == list(range(220))


def test_long_segments_are_read_in_ranges(spark, tmp_path, monkeypatch):
    """Several tasks read a segment, and each only the row groups that it needs."""
    monkeypatch.setattr("tidelog.sources.messages.RANGE", 30)
    table = pa.table({"value": [json.dumps({"arrival_seq": n}) for n in range(100)]})
    pq.write_table(table, tmp_path / "segment-000000000000.parquet", row_group_size=16)
    reader = MessageReader({"path": f"file://{tmp_path}", "rows": "100"})
    ranges = reader.partitions({"segment": 0, "record": 3}, {"segment": 0, "record": 97})
    assert [(r.first, r.end) for r in ranges] == [(3, 33), (33, 63), (63, 93), (93, 97)]
    assert [n for r in ranges for batch in reader.read(r) for n in batch.column("arrival_seq").to_pylist()] == list(range(3, 97))
