"""Control around ingestion: smoothed latency and its state, token buckets, failure shares, changes of state, one-time reads, expiry and retries.

A token bucket is a fold over all earlier requests of a key: what a request finds depends on which ones before it were let through. But a bucket that refills as many tokens a second as it holds is full after any second
without a request, whatever was before. So a key's requests are cut at such gaps, and the segments are dealt over the tasks, sorted; each task holds one state at a time. What cannot be cut is a stretch of requests
less than a second apart: it goes through one task, in constant memory. Windows that look some rows back run over chunks of a key that overlap by so many rows, and the smoothed latency is a sum of its newest rows, as the others'
weight is zero in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The weight of the newest latency, and the default limits.
EMA_WEIGHT = 0.3
WARN_MS, CRITICAL_MS = 500, 2_000
FAILURE_WINDOW, FAILURE_MIN_CALLS = 10, 3
#: Rows from which on a weight of 0.7 to the power of the row's number is zero in double precision.
EMA_ROWS = 2_100
#: Rows of a chunk.
CHUNK = 10_000
MICRO = 1_000_000


def smoothed(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, ema: the exponential moving average, from 0, after the last row of each key. Rows beyond the newest ``EMA_ROWS`` weigh nothing and are cut before the shuffle."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    placed = df.select(key, value, F.row_number().over(newest).alias("_n")).where(F.col("_n") <= EMA_ROWS)
    return placed.groupBy(key).agg(F.sum(EMA_WEIGHT * F.pow(F.lit(1 - EMA_WEIGHT), F.col("_n") - 1) * F.col(value)).alias("ema"))


def pressure_state(latency: Column, warn_ms: float = WARN_MS, critical_ms: float = CRITICAL_MS) -> Column:
    return F.when(latency >= critical_ms, "CRITICAL").when(latency >= warn_ms, "WARN").otherwise("NORMAL")


def take_token(level: int | None, last: int | None, now: int, capacity: int) -> tuple[int, bool, int, int]:
    """One request at a bucket of ``capacity`` tokens that refills as many a second; times in microseconds, level in millionths of a token.

    The new level, whether it passes, the whole tokens left, and the whole seconds to wait (0 if it passes).
    """
    level = capacity * MICRO if level is None else min(capacity * MICRO, level + max(0, now - last) * capacity)
    if level >= MICRO:
        return level - MICRO, True, (level - MICRO) // MICRO, 0
    micros = -(-(MICRO - level) // capacity)
    return level, False, 0, -(-micros // MICRO)


def segments(df: DataFrame, key: str, order: str, micros: str, gap: int = MICRO, **sizes: int) -> DataFrame:
    """Rows with _segment: how many gaps of ``gap`` microseconds or more lie before it among the key's rows, in ``order`` (whole numbers, unique in a key; ``micros`` may go back).

    Neighbours are found within chunks of a key, and counts of gaps are summed up over its chunks, so no key is one task's work.
    """
    rows = chunked(df, key, order, 1, **sizes)
    inside = Window.partitionBy(key, "_chunk").orderBy("_place")
    cut = F.col("_own") & (F.coalesce(F.col(micros) - F.lag(micros).over(inside), F.lit(gap)) >= gap)
    counted = rows.withColumn("_cut", cut.cast("long")).withColumn("_inside", F.sum("_cut").over(inside)).where("_own")
    chunks = counted.groupBy(F.col(key).alias("_key"), F.col("_chunk").alias("_of")).agg(F.sum("_cut").alias("_cuts"))
    earlier = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("_key", "_of", F.coalesce(F.sum("_cuts").over(earlier), F.lit(0)).alias("_before"))
    joined = counted.join(chunks, counted[key].eqNullSafe(chunks["_key"]) & (counted["_chunk"] == chunks["_of"]))
    return joined.select(*df.columns, (F.col("_before") + F.col("_inside")).alias("_segment"))


def rate_limited(df: DataFrame, key: str, order: str, micros: str, capacity: int, **sizes: int) -> DataFrame:
    """Requests with passed, remaining and retry_after; ``micros`` is the time of the request, which ``order`` (whole numbers, unique in a key) follows. Only key, order and time are looked at; the other columns pass as they are."""
    outputs = "passed boolean, remaining long, retry_after long"
    rows = segments(df, key, order, micros, **sizes).repartition(key, "_segment").sortWithinPartitions(key, "_segment", order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, level, last = None, None, None
        for batch in batches:
            passed, remaining, waits = [], [], []
            for k, segment, now in zip(*(batch.column(c).to_pylist() for c in (key, "_segment", micros)), strict=True):
                if (k, segment) != of:
                    of, level, last = (k, segment), None, None
                level, ok, left, wait = take_token(level, last, now, capacity)
                last = now
                passed.append(ok), remaining.append(left), waits.append(wait)
            more = [pa.array(passed, pa.bool_()), pa.array(remaining, pa.int64()), pa.array(waits, pa.int64())]
            plain = batch.select([c for c in batch.schema.names if c != "_segment"])
            yield pa.RecordBatch.from_arrays([*plain.columns, *more], [*plain.schema.names, "passed", "remaining", "retry_after"])

    return rows.mapInArrow(run, StructType([*df.schema, *StructType.fromDDL(outputs)]))


def chunked(df: DataFrame, key: str, order: str, back: int, chunk: int = CHUNK) -> DataFrame:
    """Rows with _place (their number among the key's rows, by the whole number ``order``), _chunk, and _own: false for the last ``back`` rows of the chunk before, which are there to be looked back at.

    Numbers come from the counts of slices of the order column, so a key of any length is dealt over many tasks. A slice is as wide as a chunk would be if the key's rows lay evenly in its range.
    """
    ranges = df.groupBy(F.col(key).alias("_of")).agg(F.min(order).alias("_low"), F.greatest(F.lit(1.0), (F.max(order) - F.min(order) + 1.0) * chunk / F.count("*")).alias("_width"))
    sliced = df.join(ranges, df[key].eqNullSafe(ranges["_of"])).withColumn("_slice", F.floor((F.col(order) - F.col("_low")) / F.col("_width")))
    sizes = sliced.groupBy(F.col(key).alias("_key"), F.col("_slice").alias("_part")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_key", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy(key, "_slice").orderBy(order)
    numbered = sliced.withColumn("_rank", F.row_number().over(own))
    placed = numbered.join(sizes, numbered[key].eqNullSafe(sizes["_key"]) & (numbered["_slice"] == sizes["_part"])).withColumn("_place", F.col("_before") + F.col("_rank") - 1)
    first = F.floor(F.col("_place") / chunk)
    chunks = F.when(F.col("_place") % chunk >= chunk - back, F.array(first, first + 1)).otherwise(F.array(first))
    rows = placed.withColumn("_first", first).withColumn("_chunk", F.explode(chunks)).withColumn("_own", F.col("_chunk") == F.col("_first"))
    return rows.select(*df.columns, "_place", "_chunk", "_own")


def _over_chunks(df: DataFrame, key: str, order: str, back: int, name: str, value, **sizes: int) -> DataFrame:
    """Rows with the column that ``value`` makes of a window over the key's rows in order."""
    rows = chunked(df, key, order, back, **sizes)
    return rows.withColumn(name, value(Window.partitionBy(key, "_chunk").orderBy("_place"))).where("_own").drop("_place", "_chunk", "_own")


def failure_share(df: DataFrame, key: str, order: str, failed: str, name: str = "share", **sizes: int) -> DataFrame:
    """Rows with the share of failures (a boolean column) among the last ``FAILURE_WINDOW`` calls of the key; null before ``FAILURE_MIN_CALLS``."""

    def share(window):
        recent = window.rowsBetween(1 - FAILURE_WINDOW, 0)
        return F.when(F.count("*").over(recent) >= FAILURE_MIN_CALLS, F.avg(F.col(failed).cast("int")).over(recent))

    return _over_chunks(df, key, order, FAILURE_WINDOW - 1, name, share, **sizes)


def transitions(df: DataFrame, key: str, order: str, state: str, **sizes: int) -> DataFrame:
    """from_state, to_state, times: changes of state between neighbouring rows of a key."""
    rows = df.select(key, order, F.col(state).alias("to_state"))
    moved = _over_chunks(rows, key, order, 1, "from_state", lambda window: F.lag("to_state").over(window), **sizes).where("from_state != to_state")
    return moved.groupBy("from_state", "to_state").agg(F.count("*").alias("times"))


def consumed_once(reads: DataFrame, key: str, order: str) -> DataFrame:
    """Reads of one-time tokens, with ``won``: the first reader of a token gets it."""
    first = reads.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))  # partial minima: a token that very many read is no single task's work
    return reads.join(first, reads[key].eqNullSafe(first["_key"])).withColumn("won", F.col(order) == F.col("_first")).drop("_key", "_first")


def alive_at(stored: DataFrame, now: Column, written: str = "written_at", seconds: str = "ttl_seconds") -> DataFrame:
    """Entries that have not expired."""
    return stored.where(F.col(written) + F.make_dt_interval(secs=F.col(seconds)) > now)


def backoff_seconds(attempt: Column, first: float = 1, factor: float = 2, most: float = 30) -> Column:
    """Wait before retry ``attempt`` (from 1)."""
    return F.least(F.lit(most).cast("double"), first * F.pow(F.lit(factor).cast("double"), attempt - 1))


def retried(rows: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Failed rows (retry_count) to try again, counted up, and the ones whose tries are used up."""
    counted = rows.withColumn("retry_count", F.col("retry_count") + 1)
    return counted.where(F.col("retry_count") < most), counted.where(F.col("retry_count") >= most)
