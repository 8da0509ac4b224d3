"""Issues: logs rolled up by project and fingerprint, in one go or merged batch by batch; search and statistics.

First and last are by order of arrival (arrival_seq), not by time: title, severity, quality and status come from the first log of an issue, the last occurrence from
the last one. Partial results of a batch merge associatively, so any split of the logs gives the same issues. Spark sums the partial results up before it shuffles, so a
hot issue costs one row per task there.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import APP_PREFIXES, hash_and_quality, initial_status
from ..functions.text import issue_title

KEYS = ["project_id", "fingerprint"]
FIRST = ["title", "status", "severity", "fingerprint_quality", "first_occurred_at"]


def fingerprinted(logs: DataFrame, prefixes: Sequence[str] = APP_PREFIXES) -> DataFrame:
    """Logs with the columns that issues are made of; the fingerprint is computed once a row."""
    found = logs.withColumn("_found", hash_and_quality(F.col("archive"), F.col("severity"), F.col("event_category"), prefixes))
    return found.select(
        "project_id",
        F.col("_found.fingerprint").alias("fingerprint"),
        issue_title(F.col("archive")).alias("title"),
        initial_status(F.col("_found.quality")).alias("status"),
        "severity",
        F.col("_found.quality").alias("fingerprint_quality"),
        "occurred_at",
        "arrival_seq",
    )


def rollup(logs: DataFrame, prefixes: Sequence[str] = APP_PREFIXES) -> DataFrame:
    """One row per issue of these logs."""
    rows = fingerprinted(logs, prefixes)
    first = F.struct(F.col("arrival_seq").alias("first_seq"), "title", "status", "severity", "fingerprint_quality", F.col("occurred_at").alias("first_occurred_at"))
    last = F.struct(F.col("arrival_seq").alias("last_seq"), F.col("occurred_at").alias("last_occurred_at"))
    return _flat(rows.groupBy(*KEYS).agg(F.count("*").alias("occurrence_count"), F.min_by(first, "arrival_seq").alias("f"), F.max_by(last, "arrival_seq").alias("l")))


def merge(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored issues and those of a new batch. The status of a stored issue stays, also one that was set by hand."""
    both = state.unionByName(batch)
    first, last = F.struct("first_seq", *FIRST), F.struct("last_seq", "last_occurred_at")
    return _flat(both.groupBy(*KEYS).agg(F.sum("occurrence_count").alias("occurrence_count"), F.min_by(first, "first_seq").alias("f"), F.max_by(last, "last_seq").alias("l")))


def _flat(grouped: DataFrame) -> DataFrame:
    return grouped.select(*KEYS, *(F.col(f"f.{c}").alias(c) for c in FIRST[:-1]), "occurrence_count", F.col("f.first_occurred_at").alias("first_occurred_at"), F.col("l.last_occurred_at").alias("last_occurred_at"), F.col("f.first_seq").alias("first_seq"), F.col("l.last_seq").alias("last_seq"))


def with_status(issues: DataFrame, changes: DataFrame) -> DataFrame:
    """Issues with the states of ``changes`` (project_id, fingerprint, new_status)."""
    return issues.join(changes, KEYS, "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def find_issue(issues: DataFrame, fingerprint: str, project_id) -> DataFrame:
    return issues.where((F.col("fingerprint") == fingerprint) & (F.col("project_id") == project_id))


def optional_filters(*conditions: Column | None) -> Column:
    """All conditions that are given."""
    out = F.lit(True)
    for condition in conditions:
        out = out if condition is None else out & condition
    return out


def search(issues: DataFrame, project_id=None, status: str | None = None, severity: str | None = None, since: dt.datetime | None = None, until: dt.datetime | None = None, created: str = "first_occurred_at") -> DataFrame:
    """Issues by optional filters, the most recent first; both ends of the period are in it."""
    equal = lambda c, v: None if v is None else F.col(c) == F.lit(v)
    wanted = optional_filters(equal("project_id", project_id), equal("status", status), equal("severity", severity), None if since is None else F.col(created) >= F.lit(since), None if until is None else F.col(created) <= F.lit(until))
    return issues.where(wanted).orderBy(F.desc("last_occurred_at"), *KEYS)


def recent(issues: DataFrame, k: int) -> DataFrame:
    return issues.orderBy(F.desc("last_occurred_at"), *KEYS).limit(k)


def statistics(issues: DataFrame) -> DataFrame:
    """By project: issues, occurrences, and issues that are open."""
    opened = F.when(F.col("status") == "OPEN", 1).otherwise(0)
    return issues.groupBy("project_id").agg(F.count("*").alias("issues"), F.sum("occurrence_count").alias("occurrences"), F.sum(opened).alias("open_issues"))
