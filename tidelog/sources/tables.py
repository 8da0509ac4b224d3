"""Parquet tables of a folder, and the log view that is derived from events."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The archive text of an event, by template, as an expression that Spark SQL and DuckDB both read.
ARCHIVE_SQL = """CASE event_id % 6
  WHEN 0 THEN concat('com.game.err.', event_type, 'Exception: user ', user_id, chr(10), chr(9), 'at com.game.a.A.run(A.java:', event_id % 97, ')', chr(10), 'at org.apache.x.Y.z(Y.java:1)', chr(10), 'at com.game.b.B.go(B.java:12)', chr(10), 'at com.game.c.C.$lambda$3(C.java:', event_id % 31, ')')
  WHEN 1 THEN concat('java.lang.Err: boom', chr(10), 'at com.game.a.', event_type, '.run(A.java:', event_id % 97, ')', chr(10), 'at com.studio.b.B.go(Native Method)')
  WHEN 2 THEN concat('a.b.', event_type, ': player_', user_id, ' at 10.0.0.', user_id % 200, ' item_sword_', event_id, ' /var/log/', event_type, '.log')
  WHEN 3 THEN concat('Timeout after ', event_id, ' ms @ff0', event_type)
  WHEN 4 THEN ''
  ELSE concat('java.x.E: m', chr(10), '  at java.util.L.get(L.java:9)', chr(10), '  at com.game.q.', event_type, '.f(Q.java:77)') END"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@functools.cache
def _local_folder() -> str:
    """One folder for this process, where all tasks run on this machine; it goes when the process ends."""
    path = tempfile.mkdtemp(prefix="tidelog-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names, which driver and executors share. Where that is unset: in local mode a temporary one, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or _local_folder()).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def event_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Logs: arrival_seq, project_id, user_id, severity, event_category, archive, occurred_at, attributes (JSON text)."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("arrival_seq"),
        (F.col("user_id") % 5).alias("project_id"),
        "user_id",
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("severity"),
        F.lit("SYSTEM").alias("event_category"),
        F.expr(ARCHIVE_SQL).alias("archive"),
        F.col("ts").alias("occurred_at"),
        F.col("props").alias("attributes"),
    )


class Steps:
    """Tables between the steps of an operator, in a new work folder: what a lost executor costs is the step that it was in."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.root = spark, work_folder(spark, purpose)

    def save(self, rows: DataFrame, name: str) -> DataFrame:
        """The same rows, read from a table that is written now."""
        rows.write.parquet(f"{self.root}/{name}")
        return self.read(name, rows.schema)

    def append(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def read(self, name: str, schema) -> DataFrame:
        """A table's rows; none if it was never written."""
        folder = self._path(name)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            folder = self._path(name)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
