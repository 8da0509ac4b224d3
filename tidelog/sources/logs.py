"""The month-partitioned log table, the landing folder of raw messages, and blobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import GAME_LOG, RAW_MESSAGE


def raw_stream(spark: SparkSession, path: str, files_per_trigger: int = 1, archive: str | None = None) -> DataFrame:
    """Raw messages of a landing folder of JSON lines, as a stream. The checkpoint of the query that reads it is the consumer's offset. Files that were taken move to ``archive``, if it is given."""
    stream = spark.readStream.schema(RAW_MESSAGE).option("maxFilesPerTrigger", files_per_trigger)
    if archive is not None:
        stream = stream.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return stream.json(path)


def raw_batch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_MESSAGE).json(path)


def dealt(messages: DataFrame, each: int = 4, by: str | None = None) -> DataFrame:
    """The messages over so many parts a core, however few files or row groups they come from: decoding or writing them costs far more than a shuffle. by: a column of many values, which spares the sort that dealing in turn takes."""
    return messages.repartition(each * messages.sparkSession.sparkContext.defaultParallelism, *([] if by is None else [by]))


def land(messages: DataFrame, path: str) -> None:
    """Appends messages to a landing folder."""
    messages.write.mode("append").json(path)


def append_logs(logs: DataFrame, path: str) -> None:
    """Appends logs by month, sorted by time within files, so that a time filter skips row groups."""
    by_month = logs.withColumn("occurred_month", F.date_format("occurred_at", "yyyy-MM"))
    by_month.sortWithinPartitions("occurred_month", "occurred_at").write.mode("append").partitionBy("occurred_month").parquet(path)


def read_logs(spark: SparkSession, path: str, since: dt.datetime | None = None, until: dt.datetime | None = None) -> DataFrame:
    """Logs with since <= occurred_at < until. The months are filtered too, so only their folders are read."""
    logs = spark.read.schema(GAME_LOG + ", occurred_month string").parquet(path)
    for bound, by_time, by_month in ((since, lambda c, b: c >= b, lambda c, b: c >= b), (until, lambda c, b: c < b, lambda c, b: c <= b)):
        if bound is not None:
            logs = logs.where(by_time(F.col("occurred_at"), F.lit(bound)) & by_month(F.col("occurred_month"), F.lit(bound.strftime("%Y-%m"))))
    return logs


def months_present(spark: SparkSession, path: str) -> DataFrame:
    """occurred_month: one row per stored month; from the folders' names, no file is opened."""
    return spark.read.schema(GAME_LOG + ", occurred_month string").parquet(path).select("occurred_month").distinct()


def drop_month(spark: SparkSession, path: str, month: str) -> bool:
    """Deletes a month's folder; false if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/occurred_month={month}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """path, size, hash (SHA-256) and content of stored files; the content is read only if it is used."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), "content")


def delete_blob(spark: SparkSession, path: str) -> bool:
    """False if there is no such file."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, False)
