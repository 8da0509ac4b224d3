"""Decoding of raw messages into logs, with rejected rows set aside, and the window of accepted months."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import hash_and_quality
from ..functions.parsing import parse_category, parse_json_object, parse_severity, parse_time, parse_uuid, uuid_or_new
from ..functions.text import is_blank, only_newlines
from ..sources.schemas import LENGTHS

#: Months before and after the current one whose logs are accepted.
MONTHS_BACK, MONTHS_AHEAD = 1, 2


def or_empty(c: Column, default: str) -> Column:
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, default).otherwise(c)


def decoded(raw: DataFrame, now: Column | None = None, *more: Column) -> DataFrame:
    """Every message as a log, with ``reason``: null, or why it is rejected. ``now`` stands for times that are missing or unreadable; ``more`` are columns of the message to be kept."""
    now = F.current_timestamp() if now is None else now
    severity, category = parse_severity(F.col("severity")), parse_category(F.col("eventCategory"))
    log = raw.select(
        uuid_or_new(F.col("logId")).alias("log_id"),
        parse_uuid(F.col("projectId")).alias("project_id"),
        or_empty(F.col("sessionId"), "unknown-session").alias("session_id"),
        F.col("userId").alias("user_id"),
        severity.alias("severity"),
        category.alias("event_category"),
        "archive",
        parse_time(F.col("occurredAt"), now).alias("occurred_at"),
        parse_time(F.col("ingestedAt"), now).alias("ingested_at"),
        F.col("traceId").alias("trace_id"),
        F.col("spanId").alias("span_id"),
        # The category is not known yet (functions.fingerprint.log_fingerprint).
        F.coalesce(F.when(F.length("fingerprint") > 0, F.col("fingerprint")), hash_and_quality(F.col("archive"), severity, F.lit(None).cast("string"))["fingerprint"]).alias("fingerprint"),
        parse_json_object(F.col("resource")).alias("resource"),
        parse_json_object(F.col("attributes")).alias("attributes"),
        parse_time(F.col("createdAt"), now).alias("created_at"),
        parse_time(F.col("updatedAt"), now).alias("updated_at"),
        "arrival_seq",
        *more,
        (F.col("projectId").isNull() | F.col("archive").isNull()).alias("_incomplete"),
    )
    too_long = reduce(Column.__or__, [F.coalesce(F.length(c) > n, F.lit(False)) for c, n in LENGTHS.items()])
    reason = (
        F.when(F.col("_incomplete"), "missing_field")
        .when(F.col("log_id").isNull() | F.col("project_id").isNull(), "bad_uuid")
        .when(F.col("severity").isNull(), "bad_severity")
        .when(F.col("event_category").isNull(), "bad_category")
        .when(F.col("resource").isNull() | F.col("attributes").isNull(), "bad_json")
        .when(only_newlines(F.col("archive")), "empty_lines")
        .when(too_long, "too_long")
    )
    return log.withColumn("reason", reason).drop("_incomplete")


def decoded_requests(requests: DataFrame, now: Column | None = None) -> DataFrame:
    """Typed log requests as logs: always a new id, ingested now, with the fingerprint of the whole row. ``reason`` as above."""
    now = F.current_timestamp() if now is None else now
    severity, category = parse_severity(F.col("severity")), parse_category(F.col("eventCategory"))
    required = ("projectId", "severity", "eventCategory", "occurredAt")
    reason = F.when(reduce(Column.__or__, [F.col(c).isNull() for c in required]) | is_blank(F.col("sessionId")) | is_blank(F.col("archive")), "missing_field").when(parse_uuid(F.col("projectId")).isNull(), "bad_uuid")
    reason = reason.when(severity.isNull(), "bad_severity").when(category.isNull(), "bad_category")
    return requests.select(
        F.uuid().alias("log_id"),
        parse_uuid(F.col("projectId")).alias("project_id"),
        F.col("sessionId").alias("session_id"),
        F.col("userId").alias("user_id"),
        severity.alias("severity"),
        category.alias("event_category"),
        "archive",
        parse_time(F.col("occurredAt"), now).alias("occurred_at"),
        now.alias("ingested_at"),
        F.col("traceId").alias("trace_id"),
        F.col("spanId").alias("span_id"),
        hash_and_quality(F.col("archive"), severity, category)["fingerprint"].alias("fingerprint"),
        parse_json_object(F.col("resource")).alias("resource"),
        parse_json_object(F.col("attributes")).alias("attributes"),
        "arrival_seq",
        reason.alias("reason"),
    )


def in_month_window(ts: Column, now: Column, back: int = MONTHS_BACK, ahead: int = MONTHS_AHEAD) -> Column:
    """From the month ``back`` before now's to the end of the month ``ahead`` after it."""
    month = F.trunc(now, "month")
    return (ts >= F.add_months(month, -back)) & (ts < F.add_months(month, ahead + 1))


def with_month_checked(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Decoded rows whose ``reason`` also says out_of_range, where the month is outside the window."""
    now = F.current_timestamp() if now is None else now
    return rows.withColumn("reason", F.coalesce("reason", F.when(~in_month_window(F.col("occurred_at"), now), "out_of_range")))


def split_rejected(rows: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Good logs and the rejected ones with their reason; months outside the window are rejected as out_of_range."""
    marked = with_month_checked(rows, now)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def without_repeats(logs: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row per (log_id, occurred_at), and none that is stored already."""
    once = logs.dropDuplicates(["log_id", "occurred_at"])
    return once if stored is None else once.join(stored.select("log_id", "occurred_at"), ["log_id", "occurred_at"], "left_anti")


def any_repeats(logs: DataFrame, stored: DataFrame) -> bool:
    """Whether ``without_repeats`` may leave any log out. Keys are counted by 64 bits: if two keys share them by chance, the answer is yes though nothing repeats."""
    key = F.xxhash64("log_id", "occurred_at").alias("key")
    both = logs.select(key, F.lit(1).alias("own")).unionAll(stored.select(key, F.lit(0).alias("own")))
    counts = both.groupBy("key").agg(F.sum("own").alias("own"), F.count("*").alias("all"))
    return not counts.where("own > 1 OR (own = 1 AND all > 1)").isEmpty()
