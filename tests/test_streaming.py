import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelog.operators import issues
from tidelog.plans.log_queries import _raw
from tidelog.sources import logs
from tidelog.streaming.ingest import Store, backlog, drop_expired, retry_rejected, start_ingestion, take_batch
from tidelog.streaming.metrics import Progress, counted
from tidelog.streaming.state import expiring_store, limit_rate

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def ends_when_the_input_is_used_up(spark):
    """State with a time to live would go on with batches without data."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", False)
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def now():
    return F.lit("2024-02-10 00:00:00").cast("timestamp")


def messages(spark):
    return _raw(spark, FOLDER).withColumn("retryCount", F.lit(None).cast("int"))


def test_stream_equals_batch(spark, tmp_path):
    landing, root = f"file://{tmp_path}/in", f"file://{tmp_path}/store"
    raw = messages(spark).cache()
    for k in range(3):
        logs.land(raw.where(F.col("arrival_seq") % 3 == k).coalesce(1), landing)
    store = Store(spark, root)
    assert backlog(store, landing)["files"] == 3
    query = start_ingestion(spark, landing, root, now=now())
    assert query.awaitTermination(120)
    whole = issues.rollup(store.rows().drop("batch"))
    found = store.issues()
    assert store.rows().select("batch").distinct().count() == 3
    assert found.exceptAll(whole.select(found.columns)).count() == 0 and found.count() == whole.count() > 0
    assert store.rows().count() + store.rows("rejected").count() == raw.count()
    gauges = backlog(store, landing, query)
    assert gauges["files"] < 3 and gauges["rejected"] == store.rows("rejected").count() > 0 == gauges["dead"] and gauges["batch"] == 2
    raw.unpersist()


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    raw = messages(spark)
    for batch, part in ((0, 0), (1, 1), (1, 1)):
        take_batch(store, raw.where(F.col("arrival_seq") % 2 == part), batch, now())
    assert store.issues().agg(F.sum("occurrence_count")).first()[0] == store.rows().count()
    assert store.rows("logs", 1).count() == store.rows().where("batch = 1").count() > 0


def test_messages_that_come_again_are_not_stored_again(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    raw = messages(spark).where("arrival_seq < 300")
    take_batch(store, raw, 0, now())
    rows, occurrences = store.rows().count(), store.issues().agg(F.sum("occurrence_count")).first()[0]
    assert rows == occurrences == store.rows().select("log_id").distinct().count() > 0
    take_batch(store, raw.unionAll(raw), 1, now())
    assert store.rows().count() == rows and store.issues().agg(F.sum("occurrence_count")).first()[0] == occurrences


def test_bases_and_parts(spark, tmp_path, monkeypatch):
    from tidelog.streaming import ingest

    monkeypatch.setattr(ingest, "MERGE_EVERY", 2)
    store = Store(spark, f"file://{tmp_path}/store")
    raw = messages(spark)
    for batch in range(7):
        take_batch(store, raw.where(F.col("arrival_seq") % 7 == batch), batch, now())
    assert store._batches("base") == [3, 5] and store._batches("parts") == [4, 5, 6]
    whole = issues.rollup(store.rows().drop("batch"))
    found = store.issues()
    assert found.exceptAll(whole.select(found.columns)).count() == whole.select(found.columns).exceptAll(found).count() == 0
    earlier, until = store.issues(before=5), issues.rollup(store.rows().where("batch < 5").drop("batch"))
    assert earlier.exceptAll(until.select(earlier.columns)).count() == 0 and earlier.count() == until.count()


def test_rejected_rows_are_tried_again(spark, tmp_path):
    landing, store = f"file://{tmp_path}/in", Store(spark, f"file://{tmp_path}/store")
    raw = messages(spark).where("arrival_seq < 200")
    take_batch(store, raw, 0, F.lit("2023-01-01 00:00:00").cast("timestamp"))  # all months are out of range
    assert store.rows().count() == 0 and store.rows("rejected").where("reason = 'out_of_range'").count() > 0
    retry_rejected(store, landing)
    assert store.rows("rejected").count() == 0
    take_batch(store, logs.raw_batch(spark, landing), 1, now())  # by now they are in range
    whole = Store(spark, f"file://{tmp_path}/other")
    take_batch(whole, raw, 0, now())
    stored = store.rows().select("log_id", "fingerprint", "occurred_at", "attributes")
    assert stored.exceptAll(whole.rows().select(*stored.columns)).count() == 0 and stored.count() == whole.rows().count() > 0
    left = store.rows("rejected").select("retry_count").collect()
    assert len(left) == whole.rows("rejected").count() > 0 and {r[0] for r in left} == {1}
    retry_rejected(store, f"{landing}2", most=2)
    assert store.rows("dead").count() == len(left) and store.rows("rejected").count() == 0
    assert backlog(store, landing)["dead"] == store.rows("dead").count()


def test_retention(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    take_batch(store, messages(spark), 0, now())
    assert drop_expired(store, F.lit("2024-02-20 00:00:00").cast("timestamp")) == [] and store.rows().count() > 0
    assert drop_expired(store, F.lit("2024-03-01 00:00:00").cast("timestamp")) == ["2024-01"]
    assert store.rows().where("occurred_month = '2024-01'").count() == 0


def test_log_table(spark, tmp_path):
    from tidelog.operators.ingest import decoded, split_rejected

    path = f"file://{tmp_path}/logs"
    good, _ = split_rejected(decoded(_raw(spark, FOLDER), now()), now())
    logs.append_logs(good, path)
    some = logs.read_logs(spark, path, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6))
    assert some.count() == good.where("occurred_at >= '2024-01-05' AND occurred_at < '2024-01-06'").count() > 0
    assert "PartitionFilters: [isnotnull(occurred_month" in some._jdf.queryExecution().toString()
    assert [r[0] for r in logs.months_present(spark, path).collect()] == ["2024-01"]
    assert logs.drop_month(spark, path, "2024-01") and not logs.drop_month(spark, path, "2024-01")


def test_blobs(spark, tmp_path):
    import hashlib

    (tmp_path / "a.pdf").write_bytes(b"content")
    row = logs.read_blobs(spark, f"file://{tmp_path}/a.pdf").first()
    assert (row["size"], row["hash"]) == (7, hashlib.sha256(b"content").hexdigest())
    assert logs.delete_blob(spark, f"file://{tmp_path}/a.pdf") and not logs.delete_blob(spark, f"file://{tmp_path}/a.pdf")


def test_streamed_rate_limit(spark, tmp_path):
    rows = spark.range(20).select(F.lit("k").alias("api_key"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1000).alias("requested_at"))
    rows.coalesce(1).write.json(f"{tmp_path}/in")
    requests = spark.readStream.schema("api_key string, requested_at timestamp").json(f"{tmp_path}/in")
    query = limit_rate(requests, 5).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    assert spark.table("limited").where("passed").count() == 5


def test_expiring_store(spark, tmp_path):
    calls = [("a", "set", "1", 10, 0), ("a", "get", None, None, 5), ("a", "get", None, None, 10), ("b", "set", "2", 100, 0), ("b", "take", None, None, 1), ("b", "take", None, None, 2), ("c", "get", None, None, 3), ("d", "set", "4", 0, 0), ("d", "get", None, None, 1), ("e", "set", "5", 50, 0), ("e", "delete", None, None, 1), ("e", "get", None, None, 2)]
    rows = spark.createDataFrame(calls, "key string, op string, value string, ttl_seconds long, second long").withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("second"))).drop("second")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = expiring_store(stream).writeStream.format("memory").queryName("answers").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    got = sorted((r["key"], r["micros"] // 1_000_000 - 1_700_000_000, r["answer"]) for r in spark.table("answers").collect())
    assert got == [("a", 5, "1"), ("a", 10, None), ("b", 1, "2"), ("b", 2, None), ("c", 3, None), ("d", 1, None), ("e", 2, None)]


def _in_batches(spark, tmp_path, batches, schema, stage, name):
    """Each list of rows as a micro-batch of its own, in order."""
    import time

    (tmp_path / "in").mkdir(exist_ok=True)
    stream = stage(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.table(name).collect(), query


def _at(second):
    return dt.datetime.fromtimestamp(1_700_000_000 + second, dt.UTC).replace(tzinfo=None)


def test_late_requests_are_answered_and_counted(spark, tmp_path):
    """Five requests, of which two come in a second batch with an earlier time, one of them of a new key: none vanishes."""
    from tidelog.streaming.state import late_calls

    batches = [[("a", _at(100)), ("a", _at(160)), ("a", _at(100))], [("a", _at(20)), ("b", _at(10))]]
    rows, query = _in_batches(spark, tmp_path, batches, "api_key string, requested_at timestamp_ntz", lambda s: limit_rate(s.withColumn("requested_at", F.col("requested_at").cast("timestamp")), 2), "late_requests")
    got = sorted((r["api_key"], r["micros"] // 1_000_000 - 1_700_000_000, r["passed"], r["late"]) for r in rows)
    assert got == [("a", 20, True, True), ("a", 100, True, False), ("a", 100, True, False), ("a", 160, True, False), ("b", 10, True, False)]
    assert late_calls(spark.table("late_requests")).count() == 1
    assert sum(p.observedMetrics["limited"]["late"] for p in query.recentProgress) == 1


def test_late_calls_of_the_store(spark, tmp_path):
    schema = "key string, op string, value string, ttl_seconds long, at timestamp_ntz"
    batches = [[("k", "set", "1", 100, _at(0)), ("k", "get", None, None, _at(50))], [("k", "set", "old", 100, _at(10)), ("k", "get", None, None, _at(60)), ("n", "set", "2", 9, _at(5))], [("n", "get", None, None, _at(6)), ("k", "get", None, None, _at(30))]]
    rows, _ = _in_batches(spark, tmp_path, batches, schema, lambda s: expiring_store(s.withColumn("at", F.col("at").cast("timestamp"))), "late_calls")
    got = sorted((r["key"], r["micros"] // 1_000_000 - 1_700_000_000, r["op"], r["answer"], r["late"]) for r in rows)
    assert got == [("k", 10, "set", None, True), ("k", 30, "get", None, True), ("k", 50, "get", "1", False), ("k", 60, "get", "1", False), ("n", 6, "get", "2", False)]


def test_idle_state_is_forgotten(spark, tmp_path):
    """A time to live of a millisecond: each batch begins anew."""
    batches = [[("a", _at(0)), ("a", _at(0))], [("a", _at(0))]]
    rows, _ = _in_batches(spark, tmp_path, batches, "api_key string, requested_at timestamp_ntz", lambda s: limit_rate(s.withColumn("requested_at", F.col("requested_at").cast("timestamp")), 1, idle_ms=1), "idle")
    assert sorted(r["passed"] for r in rows) == [False, True, True]


def test_counters(spark):
    df, seen = counted(spark.createDataFrame([(1, "x"), (2, None)], "i int, reason string"), "rows", "reason")
    df.collect()
    assert seen.get == {"rows": 2, "flagged": 1}
    assert Progress().batches == {}


@pytest.mark.parametrize("name", ["s01_stream_logs", "t10_stream_issues", "t10_stream_tiers", "t04_retry", "d10_stream_status"])
def test_messages_are_landed_and_taken_by_many_tasks(spark, monkeypatch, name):
    """However few row groups the events lie in: no step of the query goes through one task."""
    from tidelog.plans import stream_queries

    class Seen(Exception):
        pass

    def seen(*args):
        raise Seen(next(a for a in args if hasattr(a, "rdd")).rdd.getNumPartitions())

    monkeypatch.setattr(stream_queries.logs, "land", seen)
    monkeypatch.setattr(stream_queries, "take_batch", seen)
    assert spark.read.parquet(f"{FOLDER}/events.parquet").rdd.getNumPartitions() == 1
    with pytest.raises(Seen) as parts:
        getattr(stream_queries, name)(spark, FOLDER)
    assert parts.value.args[0] >= spark.sparkContext.defaultParallelism


def test_a_batch_is_decoded_once_and_not_cached(spark, tmp_path, monkeypatch):
    """Good and rejected rows are written by one job, as they are stored; only repeats make the logs be written again."""
    from pyspark.sql import DataFrame

    from tidelog.streaming import ingest

    def cached(*_):
        raise AssertionError("a batch was cached")

    again = []
    monkeypatch.setattr(DataFrame, "persist", cached)
    monkeypatch.setattr(ingest, "without_repeats", lambda *args, f=ingest.without_repeats: again.append(1) or f(*args))
    store = Store(spark, f"file://{tmp_path}/store")
    raw = messages(spark)
    take_batch(store, raw.where("arrival_seq % 2 = 0"), 0, now())
    take_batch(store, raw.where("arrival_seq % 2 = 1"), 1, now())
    take_batch(store, raw.where("arrival_seq % 2 = 1"), 1, now())  # again: its own logs are no repeats
    assert not again and not (tmp_path / "store" / "aside").exists()
    rows, bad = store.rows().count(), store.rows("rejected").count()
    assert rows + bad == raw.count() and min(rows, bad) > 0
    take_batch(store, raw.where("arrival_seq % 2 = 0").unionAll(raw.where("arrival_seq % 2 = 0")), 2, now())
    assert again and store.rows().count() == rows and store.rows("logs", 2).count() == 0


def test_batches_without_good_or_rejected_rows(spark, tmp_path):
    """Each takes the place of what its batch had stored before."""
    store = Store(spark, f"file://{tmp_path}/store")
    raw = messages(spark)
    good, bad = raw.where("arrival_seq % 11 IN (0, 3, 5, 7)"), raw.where("arrival_seq % 11 = 2")
    found = []
    for part in (good, bad, good.where("false"), good):
        take_batch(store, part, 0, now())
        found.append((store.rows().count(), store.rows("rejected").count(), store.issues().count() > 0))
    assert found == [(good.count(), 0, True), (0, bad.count(), False), (0, 0, False), (good.count(), 0, True)]


def test_repeats_are_seen(spark):
    from tidelog.operators.ingest import any_repeats

    at = lambda *ids: spark.createDataFrame([(i, dt.datetime(2024, 1, 1)) for i in ids], "log_id string, occurred_at timestamp")
    assert not any_repeats(at("a", "b"), at()) and not any_repeats(at("a", "b"), at("c", "c")) and not any_repeats(at(), at("c"))
    assert any_repeats(at("a", "b", "a"), at()) and any_repeats(at("a", "b"), at("b")) and any_repeats(at("a"), at("a", "a"))
