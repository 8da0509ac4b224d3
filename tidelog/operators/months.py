"""Month partitions: which ought to exist, bounds, retention and late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import month_table

#: Months kept beside the current one: the drop takes the month before them.
KEPT_MONTHS = 1


def months_around(spark: SparkSession, now: Column, back: int = 1, ahead: int = 2) -> DataFrame:
    """partition, starts, ends (not in it): the months that must exist at start-up; with back = -ahead, the one of the monthly run."""
    month = F.trunc(now, "month")
    rows = spark.range(-back, ahead + 1).select(F.add_months(month, F.col("id").cast("int")).alias("starts"))
    return rows.select(month_table(F.col("starts")).alias("partition"), "starts", F.add_months("starts", 1).alias("ends"))


def stored_months(rows: DataFrame, ts: str) -> DataFrame:
    """month, rows: per month present."""
    return rows.groupBy(F.trunc(ts, "month").alias("month")).agg(F.count("*").alias("rows"))


def accepted_months(rows: DataFrame, ts: str, back: int = 1, ahead: int = 2) -> DataFrame:
    """partition, starts, ends (not in it), stored, exists: the months that must exist when the newest row comes in, with the rows that are stored of each. A table without rows asks for no months."""
    newest = rows.agg(F.trunc(F.max(ts), "month").alias("m")).where("m IS NOT NULL")
    asked = newest.select(F.explode(F.sequence(F.add_months("m", -back), F.add_months("m", ahead), F.expr("INTERVAL 1 MONTH"))).alias("starts"))
    joined = asked.join(stored_months(rows, ts), F.col("starts") == F.col("month"), "left")
    return joined.select(month_table(F.col("starts")).alias("partition"), "starts", F.add_months("starts", 1).alias("ends"), F.coalesce("rows", F.lit(0)).alias("stored"), F.col("rows").isNotNull().alias("exists"))


def expired(ts: Column, now: Column, older_too: bool = False) -> Column:
    """In the month that the monthly run drops; ``older_too`` also takes what a missed run has left."""
    dropped = F.add_months(F.trunc(now, "month"), -KEPT_MONTHS - 1)
    month = F.trunc(ts, "month")
    return (month <= dropped) if older_too else (month == dropped)
