"""The ingestion stream: raw messages to logs, rejected rows and issues, batch by batch; retries, retention and backlog of what it stores.

Logs and rejected rows lie in segments (``tidelog.sources.segments``): a batch becomes visible by one rename, one that is run again takes the place of what it was, segments are merged in levels, and a month goes by its folders. A message
that was stored by an earlier batch is not stored again: the batch's keys are looked up among the stored logs of its own span of time, of which only the months' folders are listed. Each batch adds the issues of its own logs as a part; parts are merged into a base every ``MERGE_EVERY`` batches, so
no batch reads or writes all issues. Partial issues merge associatively, hence base and parts together are the issues of all logs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.control import retried
from ..operators.ingest import any_repeats, decoded, with_month_checked, without_repeats
from ..operators.issues import KEYS, merge, rollup, with_status
from ..operators.months import expired
from ..sources.logs import land, raw_stream
from ..sources.messages import ROWS, message_stream
from ..sources.schemas import GAME_LOG, ISSUE, RAW_FIELDS, RAW_MESSAGE
from ..sources.segments import Segments

MERGE_EVERY, KEPT_BASES = 16, 2
#: Batches that a backlog of the message log is taken in at most.
CATCH_UP = 8
LOG_COLUMNS = [c.split()[0] for c in GAME_LOG.split(", ")]
REJECTED = GAME_LOG + ", reason string, raw string, retry_count int"
#: Elements of the message log that are no messages, by their place in it.
WRONG = "message_segment long, message_record long, body string, occurred_at timestamp"


@dataclass
class Store:
    """Folders of a log store: logs, rejected and dead rows, parts and bases of issues."""

    spark: SparkSession
    root: str

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _listed(self, path: str) -> list[str]:
        fs, folder = self._folder(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def _delete(self, path: str) -> None:
        fs, folder = self._folder(path)
        fs.delete(folder, True)

    def _batches(self, kind: str) -> list[int]:
        """Numbers of the completely written batches of a kind of issues."""
        names = [n for n in self._listed(f"issues/{kind}") if n.startswith("batch=")]
        return sorted(int(n.split("=")[1]) for n in names if "_SUCCESS" in self._listed(f"issues/{kind}/{n}"))

    def issues(self, before: int | None = None) -> DataFrame:
        """All issues, or those of the batches before the given one."""
        within = lambda kind: [n for n in self._batches(kind) if before is None or n < before]
        base = within("base")[-1:]
        paths = [f"{self.root}/issues/base/batch={n}" for n in base] + [f"{self.root}/issues/parts/batch={n}" for n in within("parts") if not base or n > base[0]]
        if not paths:
            return self.spark.createDataFrame([], ISSUE)
        stored = self.spark.read.schema(ISSUE).parquet(*paths)
        merged = merge(stored, self.spark.createDataFrame([], ISSUE))
        return with_status(merged, self.statuses()) if self._listed("issues/statuses") else merged

    def set_statuses(self, changes: DataFrame) -> None:
        """States that were set by hand (project_id, fingerprint, new_status; once a key): a part of the store that wins over what a log begins with, and stays whatever batches come or are run again."""
        numbers = [int(n.split("=")[1]) for n in self._listed("issues/statuses") if n.startswith("number=")]
        changes.select(*KEYS, "new_status").write.parquet(f"{self.root}/issues/statuses/number={max(numbers, default=-1) + 1}")

    def statuses(self) -> DataFrame:
        """The last state that was set of each issue."""
        rows = self.spark.read.schema("project_id string, fingerprint string, new_status string, number long").parquet(f"{self.root}/issues/statuses")
        return rows.groupBy(*KEYS).agg(F.max_by("new_status", "number").alias("new_status"))

    def save_issues(self, issues: DataFrame, batch: int, kind: str = "parts") -> None:
        issues.select(*(c.split()[0] for c in ISSUE.split(", "))).write.mode("overwrite").parquet(f"{self.root}/issues/{kind}/batch={batch}")

    def merge_issues(self, batch: int) -> None:
        """A base of all issues up to the batch (with the states that were set by hand); parts and bases that no reader needs go."""
        self.save_issues(self.issues(before=batch + 1), batch, "base")
        bases = self._batches("base")
        for n in bases[:-KEPT_BASES]:
            self._delete(f"issues/base/batch={n}")
        for n in self._batches("parts"):
            if len(bases) >= KEPT_BASES and n <= bases[-KEPT_BASES]:
                self._delete(f"issues/parts/batch={n}")

    def segments(self, kind: str = "logs") -> Segments:
        return Segments(self.spark, f"{self.root}/{kind}", {"logs": GAME_LOG, "wrong": WRONG}.get(kind, REJECTED), key=None if kind == "wrong" else "log_id")

    def save_rows(self, rows: DataFrame, kind: str, batch: int) -> None:
        """In place of what the batch has stored before."""
        self.segments(kind).publish(rows, batch)

    def rows(self, kind: str = "logs", batch: int | None = None, months: list[str] | None = None) -> DataFrame:
        """All rows of a kind, or those of one batch or of some months, of which only the own folders are listed."""
        return self.segments(kind).rows(batch, months).drop("segment")

    def find_log(self, log_id: str) -> DataFrame:
        """The log of that id: of the row groups, only those are read whose Bloom filter may have it."""
        return self.rows().where(F.col("log_id") == log_id)

    def keys_near(self, rows: DataFrame, batch: int) -> DataFrame:
        """log_id, occurred_at of other batches' logs in the rows' span of time: other months' folders are not listed, nor row groups of other times read."""
        month, micros = F.trunc("occurred_at", "month"), F.unix_micros("occurred_at")
        span = rows.agg(F.transform(F.sequence(F.min(month), F.max(month), F.expr("INTERVAL 1 MONTH")), lambda m: F.date_format(m, "yyyy-MM")).alias("months"), F.min(micros).alias("since"), F.max(micros).alias("until")).first()
        stored = self.rows("logs", months=span["months"] or []).where(F.col("batch") != batch)
        if span["months"]:
            stored = stored.where(F.col("occurred_at").between(F.timestamp_micros(F.lit(span["since"])), F.timestamp_micros(F.lit(span["until"]))))
        return stored.select("log_id", "occurred_at")


def take_batch(store: Store, raw: DataFrame, batch: int, now: Column | None = None) -> None:
    """One micro-batch: logs first, then rejected rows, then issues; the checkpoint moves on when all are written.

    Messages are decoded once, into a folder aside that has good and rejected rows as they are stored, so both need only a name. Logs are written once more if some of them came before or come twice.
    """
    message = F.struct(*RAW_FIELDS, "arrival_seq").alias("raw")
    rows = decoded(raw, now, message, F.coalesce("retryCount", F.lit(0)).alias("retry_count"))
    rows = with_month_checked(rows, now).withColumns({"raw": F.when(F.col("reason").isNotNull(), F.to_json("raw")), "fate": F.when(F.col("reason").isNull(), "good").otherwise("rejected")})
    logs, rejected = store.segments("logs"), store.segments("rejected")
    store._delete("aside")  # of a batch that was lost
    aside = f"{store.root}/aside/{uuid.uuid4().hex}"
    try:
        logs.prepare(rows, batch, aside, "fate")
        good = logs.prepared(f"{aside}/fate=good").select(*LOG_COLUMNS)
        stored = store.keys_near(good, batch)
        if any_repeats(good, stored):
            store.save_rows(without_repeats(good, stored), "logs", batch)
        else:
            logs.publish_prepared(f"{aside}/fate=good", batch)
        rejected.publish_prepared(f"{aside}/fate=rejected", batch)
    finally:
        store._delete("aside")
    store.save_issues(rollup(store.rows("logs", batch)), batch)  # read again: generated ids must not change
    if batch % MERGE_EVERY == MERGE_EVERY - 1:
        store.merge_issues(batch)


def start_ingestion(spark: SparkSession, landing: str, root: str, files_per_trigger: int = 1, now: Column | None = None, every: str | None = None) -> StreamingQuery:
    """Runs until stopped with a trigger interval (``every``, as '5 seconds'), else until the landing folder is used up. Files that were taken move to ``taken`` in the store."""
    store = Store(spark, root)
    stream = raw_stream(spark, landing, files_per_trigger, archive=f"{root}/taken")
    writer = stream.writeStream.foreachBatch(lambda raw, batch: take_batch(store, raw, batch, now)).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def start_message_ingestion(spark: SparkSession, path: str, root: str, rows: int = ROWS, now: Column | None = None, every: str | None = None) -> StreamingQuery:
    """As ``start_ingestion``, from the message log at ``path``, ``rows`` messages a batch at most (more if a backlog would take over ``CATCH_UP`` batches). Runs until stopped; ``processAllAvailable`` waits for what is there. Elements of a wrong type are kept aside as rows of kind ``wrong``."""
    store = Store(spark, root)

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # else the source would be read for each of the kinds
        try:
            _take(batch, number)
        finally:
            batch.unpersist()

    def _take(batch: DataFrame, number: int) -> None:
        wrong = batch.where("wrong IS NOT NULL").select(F.col("segment").alias("message_segment"), F.col("record").alias("message_record"), F.col("wrong").alias("body"), (F.current_timestamp() if now is None else now).alias("occurred_at"))
        if not wrong.isEmpty():
            store.save_rows(wrong, "wrong", number)
        place = F.col("segment") * 2**32 + F.col("record")
        take_batch(store, batch.where("wrong IS NULL").withColumn("arrival_seq", F.coalesce("arrival_seq", place)).select(*RAW_FIELDS, "arrival_seq", "retryCount"), number, now)

    writer = message_stream(spark, path, f"{root}/checkpoint", rows, CATCH_UP).writeStream.foreachBatch(take).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(processingTime=every) if every else writer).start()


def retry_rejected(store: Store, landing: str, most: int = 5) -> None:
    """Lands the messages of rejected rows again, with their tries counted up; those that were tried ``most`` times go to the dead rows instead.

    If it ends half-way, messages land twice; the store takes one of them.
    """
    segments = store.segments("rejected")
    taken = segments.stored()
    if not taken:
        return
    again, dead = retried(store.rows("rejected"), most)
    store.save_rows(dead.select(*(c.split()[0] for c in REJECTED.split(", "))), "dead", max(s.last for s in taken))
    land(again.select(F.from_json("raw", RAW_MESSAGE).alias("m"), "retry_count").select("m.*", "retry_count").drop("retryCount").withColumnRenamed("retry_count", "retryCount"), landing)
    for segment in taken:
        segments.remove(segment)


def drop_expired(store: Store, now: Column, older_too: bool = True) -> list[str]:
    """The retention run: logs and rejected rows of months that are over go, a folder each. The months that went."""
    gone = set()
    for kind in ("logs", "rejected", "dead"):
        segments = store.segments(kind)
        if months := segments.all_months():
            over = store.spark.createDataFrame([(m,) for m in months], "month string").where(expired(F.to_date("month", "yyyy-MM"), now, older_too)).collect()  # a row a month
            gone |= {r[0] for r in over if segments.drop_month(r[0])}
    return sorted(gone)


def backlog(store: Store, landing: str, query: StreamingQuery | None = None) -> dict[str, int]:
    """Files and bytes that wait in the landing folder, rows that are rejected or dead, and rows and number of the last batch, in place of pending counts and stream length."""
    fs, _ = store._folder("")
    path = store.spark._jvm.org.apache.hadoop.fs.Path(landing)
    files = [s for s in fs.listStatus(path) if s.isFile() and not s.getPath().getName().startswith(("_", "."))] if fs.exists(path) else []
    last = query.lastProgress if query is not None else None
    return {"files": len(files), "bytes": sum(s.getLen() for s in files), "rejected": store.rows("rejected").count(), "dead": store.rows("dead").count(), "batch": last["batchId"] if last else -1, "rows": last["numInputRows"] if last else 0}
