"""Queries that run the ingestion stream, its retries and retention, the log table by month, and keyed state, on messages made of events. They land in a folder of their own."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest
from ..sources import logs
from ..sources.messages import append_segments
from ..sources.schemas import RAW_FIELDS
from ..sources.tables import event_logs, table, work_folder
from ..streaming.ingest import Store, backlog, drop_expired, retry_rejected, start_ingestion, start_message_ingestion, take_batch
from ..streaming.state import expiring_store, limit_rate
from .log_queries import _REASON, ISSUES, _now, _plain_times, _raw
from .registry import SQL, query

PARTS = 3
#: More files than a part has.
ALL_FILES = 1_000_000
#: Seconds at which streamed events begin: a row at zero would be behind the first watermark.
EPOCH = 1_700_000_000


def _dealt_events(events: DataFrame) -> DataFrame:
    return logs.dealt(events, by="event_id")


def _parts(spark, folder, deal=_dealt_events) -> list[DataFrame]:
    """The messages in several parts, each dealt over all tasks."""
    raw = _raw(spark, folder, deal).withColumn("retryCount", F.lit(None).cast("int"))
    return [raw.where(F.col("arrival_seq") % PARTS == k) for k in range(PARTS)]


def _ingested(spark, parts: list[DataFrame], root: str) -> None:
    """Each part through the stream as a batch of its own, of files that all tasks have written (parts come dealt): landed while the stream stands still, and taken when it goes on from its checkpoint."""
    for part in parts:
        logs.land(part, f"{root}/in")
        start_ingestion(spark, f"{root}/in", f"{root}/store", files_per_trigger=ALL_FILES, now=_now()).awaitTermination()


def _streamed(spark, folder) -> Store:
    """All messages through the stream; then its second batch once more, as after a failure, and a batch of messages that came before."""
    root = work_folder(spark, "stream")
    parts = _parts(spark, folder)
    _ingested(spark, parts, root)
    store = Store(spark, f"{root}/store")
    again = store.rows("logs", 1).select("arrival_seq").unionByName(store.rows("rejected", 1).select("arrival_seq"))
    seen = [r[0] for r in again.agg(F.min(F.col("arrival_seq") % PARTS)).collect()]
    take_batch(store, parts[seen[0]], 1, _now())
    take_batch(store, parts[0], PARTS, _now())
    return store


@query("s01_stream_logs", SQL["s05_decode"])
def s01_stream_logs(spark, folder):
    """Logs that the stream has stored, each once (s01, s02, s03, s04, s07, s09, t01, t05, d11)."""
    return _plain_times(_streamed(spark, folder).rows().drop("batch", "occurred_month"))


@query("s01_message_log", f"SELECT CAST(NULL AS VARCHAR) AS body, * FROM ({SQL['s05_decode']}) UNION ALL BY NAME SELECT '[' || event_id || ']' AS body FROM events WHERE event_id % 100 = 7")
def s01_message_log(spark, folder):
    """Logs out of the message log, whose batches go across its segments, and the elements that are no messages (s01, s02)."""
    root = work_folder(spark, "messages")
    raw = _raw(spark, folder)
    values = raw.select("arrival_seq", F.to_json(F.struct(*raw.columns)).alias("value")).unionAll(raw.where("arrival_seq % 100 = 7").select("arrival_seq", F.format_string("[%d]", "arrival_seq").alias("value")))
    append_segments(values.repartition(4, "arrival_seq").sortWithinPartitions("arrival_seq"), f"{root}/log")
    stream = start_message_ingestion(spark, f"{root}/log", f"{root}/store", rows=5_000, now=_now())
    stream.processAllAvailable()
    stream.stop()
    store = Store(spark, f"{root}/store")
    stored = _plain_times(store.rows().drop("batch", "occurred_month"))
    return stored.withColumn("body", F.lit(None).cast("string")).unionByName(store.rows("wrong").select("body"), allowMissingColumns=True)


@query("t10_stream_issues", f"WITH g AS ({SQL['s05_decode']}) SELECT project_id, sha256('Timeout after N ms') AS fingerprint, count(*) AS occurrence_count, min(arrival_seq) AS first_seq, max(arrival_seq) AS last_seq FROM g GROUP BY project_id")
def t10_stream_issues(spark, folder):
    """Issues that the stream has rolled up, batch by batch."""
    return _streamed(spark, folder).issues().select("project_id", "fingerprint", "occurrence_count", "first_seq", "last_seq")


@query("t10_stream_tiers", f"WITH {ISSUES} SELECT project_id, fingerprint, title, status, severity, fingerprint_quality, occurrence_count, first_seq, last_seq FROM issues")
def t10_stream_tiers(spark, folder):
    """Issues of all five tiers of the fingerprint, through the stream in three batches (t10, t11, j04)."""
    root = work_folder(spark, "tiers")
    uid = lambda c: F.concat(F.lit("550e8400-e29b-41d4-a716-"), F.lpad(c.cast("string"), 12, "0"))
    fields = {
        "logId": uid(F.col("arrival_seq")), "projectId": uid(F.col("project_id")), "sessionId": F.lit("s"), "userId": F.col("user_id").cast("string"), "severity": F.lower("severity"), "eventCategory": F.lower("event_category"), "archive": F.col("archive"),
        "occurredAt": F.concat(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), "attributes": F.col("attributes"),
    }
    raw = event_logs(spark, folder).select(*(fields.get(f, F.lit(None).cast("string")).alias(f) for f in RAW_FIELDS), "arrival_seq", F.lit(None).cast("int").alias("retryCount"))
    _ingested(spark, [logs.dealt(raw.where(F.col("arrival_seq") % PARTS == k)) for k in range(PARTS)], root)
    found = Store(spark, f"{root}/store").issues()
    return found.select(F.right("project_id", F.lit(1)).cast("long").alias("project_id"), "fingerprint", "title", "status", "severity", "fingerprint_quality", "occurrence_count", "first_seq", "last_seq")


@query("d10_stream_status", f"WITH g AS ({SQL['s05_decode']}) SELECT project_id, CASE WHEN right(project_id, 1) IN ('1', '3') THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status, count(*) AS occurrences FROM g GROUP BY ALL")
def d10_stream_status(spark, folder):
    """States set by hand between two batches of the stream's store, one of which runs again (d10)."""
    store = Store(spark, work_folder(spark, "statuses"))
    raw = _raw(spark, folder).withColumn("retryCount", F.lit(None).cast("int"))
    take_batch(store, logs.dealt(raw.where("arrival_seq % 2 = 0")), 0, _now())
    found = store.issues().select("project_id", "fingerprint")
    store.set_statuses(found.select("*", F.lit("UNRESOLVED").alias("new_status")))
    store.set_statuses(found.where(F.right("project_id", F.lit(1)).isin("1", "3")).select("*", F.lit("RESOLVED").alias("new_status")))
    for batch in (1, 0):
        take_batch(store, logs.dealt(raw.where(F.col("arrival_seq") % 2 == batch)), batch, _now())
    return store.issues().groupBy("project_id", "status").agg(F.sum("occurrence_count").alias("occurrences"))


@query("t04_retry", f"SELECT coalesce({_REASON}, 'stored') AS fate, count(*) AS rows, CASE WHEN ({_REASON}) IS NOT NULL THEN 1 END AS tries FROM events GROUP BY ALL")
def t04_retry(spark, folder):
    """Messages that are out of range at first, rejected and landed again: what is stored then, and what is rejected once more."""
    root = work_folder(spark, "retry")
    raw = _raw(spark, folder).withColumn("retryCount", F.lit(None).cast("int"))
    store = Store(spark, f"{root}/store")
    take_batch(store, logs.dealt(raw), 0, F.lit("2023-01-01 00:00:00").cast("timestamp"))
    retry_rejected(store, f"{root}/again")
    take_batch(store, logs.raw_batch(spark, f"{root}/again"), 1, _now())
    fates = store.rows("rejected").select(F.col("reason").alias("fate"), F.col("retry_count").alias("tries"))
    stored = store.rows().select(F.lit("stored").alias("fate"), F.lit(None).cast("int").alias("tries"))
    return stored.unionAll(fates).groupBy("fate", "tries").agg(F.count("*").alias("rows"))


_MONTHS = f"WITH g AS ({SQL['s05_decode']}), m AS (SELECT log_id, occurred_at + INTERVAL 1 MONTH * (arrival_seq % 3) AS occurred_at FROM g)"


def _by_month(spark, folder, path: str) -> None:
    good, _ = ingest.split_rejected(ingest.decoded(_raw(spark, folder), _now()), _now())
    logs.append_logs(_spread(good), path)


def _spread(good: DataFrame) -> DataFrame:
    """Over three months."""
    return good.withColumn("occurred_at", F.col("occurred_at") + F.make_interval(months=(F.col("arrival_seq") % 3).cast("int")))


@query("s08_stored_log", f"{_MONTHS} SELECT log_id, occurred_at FROM m WHERE log_id IN ('550e8400-e29b-41d4-a716-000000000042', '550e8400-e29b-41d4-a716-000000000003')")
def s08_stored_log(spark, folder):
    """Logs by their ids out of a store of several batches, one of which was published twice (s07, s08, d11)."""
    store = Store(spark, work_folder(spark, "look-up"))
    good, _ = ingest.split_rejected(ingest.decoded(_raw(spark, folder), _now()), _now())
    spread = _spread(good)
    for batch in (0, 1, 2, 1):
        store.save_rows(spread.where(F.col("arrival_seq") % 3 == batch), "logs", batch)
    found = [store.find_log(f"550e8400-e29b-41d4-a716-{n:012d}") for n in (42, 3)]
    return _plain_times(reduce(DataFrame.unionAll, found).select("log_id", "occurred_at"))


@query("s17_log_table", f"{_MONTHS} SELECT log_id, occurred_at FROM m WHERE occurred_at >= TIMESTAMP '2024-02-05 00:00:00' AND occurred_at < TIMESTAMP '2024-03-10 00:00:00'")
def s17_log_table(spark, folder):
    """A span of the log table by month, of which only the months in it are read."""
    path = f"{work_folder(spark, 'log-table')}/logs"
    _by_month(spark, folder, path)
    return _plain_times(logs.read_logs(spark, path, dt.datetime(2024, 2, 5), dt.datetime(2024, 3, 10)).select("log_id", "occurred_at"))


@query("d12_drop_month", f"{_MONTHS} SELECT strftime(occurred_at, '%Y-%m') AS month, count(*) AS rows FROM m WHERE occurred_at >= TIMESTAMP '2024-02-01 00:00:00' GROUP BY 1")
def d12_drop_month(spark, folder):
    """The retention run drops the months that are over (d12, t17)."""
    store = Store(spark, work_folder(spark, "retention"))
    good, _ = ingest.split_rejected(ingest.decoded(_raw(spark, folder), _now()), _now())
    store.save_rows(_spread(good), "logs", 0)
    drop_expired(store, F.lit("2024-03-15 00:00:00").cast("timestamp"))
    return store.rows().groupBy(F.date_format("occurred_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("rows"))


@query("a15_backlog", f"SELECT 'dead' AS gauge, CAST(0 AS BIGINT) AS value UNION ALL SELECT 'files', {PARTS} UNION ALL SELECT 'rejected', count(*) FROM events WHERE ({_REASON}) IS NOT NULL")
def a15_backlog(spark, folder):
    """What waits in the landing folder and what is set aside (a15, s16, t15)."""
    root = work_folder(spark, "backlog")
    parts = _parts(spark, folder, deal=lambda events: events)
    for part in parts:
        logs.land(part.coalesce(1), f"{root}/in")  # a file each: they are counted
    store = Store(spark, f"{root}/store")
    take_batch(store, reduce(DataFrame.unionAll, parts), 0, _now())
    found = backlog(store, f"{root}/in")
    return spark.createDataFrame([(k, found[k]) for k in ("dead", "files", "rejected")], "gauge string, value long")


def _through(spark, rows: DataFrame, stage, name: str) -> DataFrame:
    """The rows through a streaming operator."""
    root = work_folder(spark, name)
    rows.coalesce(1).write.parquet(f"{root}/in")
    made = stage(spark.readStream.schema(rows.schema).parquet(f"{root}/in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", False)  # else it would not end
    made.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{root}/out")


@query("t12_stream_limit", SQL["t12_rate_limit"])
def t12_stream_limit(spark, folder):
    """Token buckets as keyed state of a stream with a time to live: what the segments of a table give. No request is late, as all come in one batch."""
    requests = table(spark, folder, "events").select(F.col("user_id").alias("api_key"), F.timestamp_micros(F.col("event_id") * 1500 + EPOCH * 1_000_000).alias("requested_at"))
    limited = _through(spark, requests, lambda stream: limit_rate(stream, 2), "limit").where("NOT late")
    return limited.select(((F.col("micros") - EPOCH * 1_000_000) / 1500).cast("long").alias("event_id"), "passed", "remaining", "retry_after")


@query(
    "s14_expiring_values",
    """WITH s AS (SELECT event_id, max(CASE WHEN event_id % 2 = 0 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_set FROM events)
  SELECT event_id, CASE WHEN event_id - last_set < 3000 THEN CAST(last_set AS VARCHAR) END AS answer FROM s WHERE event_id % 2 = 1""",
)
def s14_expiring_values(spark, folder):
    """Values that are set and read by key and expire (s14, t13)."""
    n, reads = F.col("event_id"), F.col("event_id") % 2 == 1
    calls = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("key"), F.when(reads, "get").otherwise("set").alias("op"), F.when(~reads, n.cast("string")).alias("value"), F.when(~reads, F.lit(3000)).cast("long").alias("ttl_seconds"), F.timestamp_seconds(n + EPOCH).alias("at")
    )
    answers = _through(spark, calls, expiring_store, "expiring").where("NOT late")
    return answers.select((F.col("micros") / 1_000_000 - EPOCH).cast("long").alias("event_id"), "answer")
