"""Registration of queries with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import ARCHIVE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The log view in DuckDB, for use after WITH.
LOGS = f"""logs AS (SELECT event_id AS arrival_seq, user_id % 5 AS project_id, user_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity,
  'SYSTEM' AS event_category, {ARCHIVE_SQL} AS archive, ts AS occurred_at, props AS attributes FROM events)"""


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, folder), and its SQL if there is one."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register
