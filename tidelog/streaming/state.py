"""Keyed state in streams: token buckets, and values that expire.

State lies in RocksDB with a time to live, so keys that nobody asks for go by themselves. No call is dropped: where a timeout in event time would make Spark leave late rows out, these operators take every row, and a call
that is older than what its key was served up to in an earlier batch comes out with ``late``. ``late_calls`` is that side output, and each batch's progress counts it (observed as ``name``; ``metrics.Progress`` sums it up).

A time to live goes by the clock, for which Spark runs batches without data over and over: a query that is to end when its input is used up (availableNow) needs ``spark.sql.streaming.noDataMicroBatches.enabled`` = false.

Of a key's calls in a micro-batch, token buckets hold the times (8 bytes a call), and the store holds the calls, until they are in order; results leave in parts. What a batch takes in bounds both
(``tidelog.sources.messages`` by rows, ``maxFilesPerTrigger`` by files).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.control import take_token

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a part of the result.
PART = 10_000


def _with_rocksdb(spark: SparkSession) -> None:
    """Queries of this session that start from now on keep their state in RocksDB, as values with a time to live need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Buckets(StatefulProcessor):
    def __init__(self, capacity: int, idle_ms: int):
        self.capacity, self.idle_ms = capacity, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "level long, last long", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([part["micros"].to_numpy(np.int64) for part in rows]))
        level, last = self.bucket.get() if self.bucket.exists() else (None, None)
        served = last
        for at in range(0, len(times), PART):
            out = []
            for now in times[at : at + PART].tolist():
                level, passed, left, wait = take_token(level, last, now, self.capacity)
                last = now if last is None else max(last, now)
                out.append((key[0], now, passed, left, wait, served is not None and now < served))
            yield pd.DataFrame(out, columns=["key", "micros", "passed", "remaining", "retry_after", "late"])
        self.bucket.update((level, last))

    def close(self) -> None:
        pass


def limit_rate(requests: DataFrame, capacity: int, key: str = "api_key", at: str = "requested_at", idle_ms: int = 3_600_000, name: str = "limited") -> DataFrame:
    """Streamed requests with passed, remaining, retry_after and late; within a micro-batch, in order of time. A late request is answered from the bucket as it is by now, which it does not refill.

    A bucket that nobody has asked for ``idle_ms`` is forgotten: it would be full.
    """
    _with_rocksdb(requests.sparkSession)
    kind = requests.schema[key].dataType.simpleString()
    timed = requests.select(F.col(key).alias("key"), F.unix_micros(at).alias("micros"))
    limited = timed.groupBy("key").transformWithStateInPandas(_Buckets(capacity, idle_ms), f"key {kind}, micros long, passed boolean, remaining long, retry_after long, late boolean", "append", "ProcessingTime")
    return _observed(limited.withColumnRenamed("key", key), name)


class _Values(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "value string, expires long, last long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows), ignore_index=True).sort_values("micros", kind="stable")
        value, expires, last = self.held.get() if self.held.exists() else (None, 0, None)
        served, out, columns = last, [], ["key", "micros", "op", "answer", "late"]
        for micros, op, new, ttl in zip(calls["micros"].tolist(), calls["op"].tolist(), calls["value"].tolist(), calls["ttl_seconds"].tolist(), strict=True):
            if served is not None and micros < served:
                out.append((key[0], micros, op, None, True))
                continue
            last = micros
            if op == "set":
                value, expires = (new, micros + min(ttl * 1_000, self.keep_ms) * 1_000) if ttl > 0 else (value, expires)
            elif op != "delete":
                out.append((key[0], micros, op, value if micros < expires else None, False))
            if op in ("delete", "take"):
                value, expires = None, 0
            if len(out) >= PART:
                yield pd.DataFrame(out, columns=columns)
                out = []
        self.held.update((value, expires, last))
        yield pd.DataFrame(out, columns=columns)

    def close(self) -> None:
        pass


def expiring_store(calls: DataFrame, keep_ms: int = 30 * 86_400_000, name: str = "served") -> DataFrame:
    """A streamed key-value store with expiry. calls: key, op (set, get, take or delete), value, ttl_seconds, at; answers of get and take: key, micros, op, answer, late.

    Calls of a key are served in order of time within a micro-batch. A get after expiry, or of a key never set, answers null; take answers once and deletes. A set without a positive ttl stores nothing. A late call is
    not served: it comes out as it is, of whatever op, with no answer. Keys that no call has reached for ``keep_ms`` of the clock are forgotten, so no value lives longer than that.
    """
    _with_rocksdb(calls.sparkSession)
    timed = calls.select("key", "op", "value", F.coalesce("ttl_seconds", F.lit(0)).cast("long").alias("ttl_seconds"), F.unix_micros("at").alias("micros"))
    return _observed(timed.groupBy("key").transformWithStateInPandas(_Values(keep_ms), "key string, micros long, op string, answer string, late boolean", "append", "ProcessingTime"), name)


def _observed(served: DataFrame, name: str) -> DataFrame:
    return served.observe(name, F.count(F.lit(1)).alias("answers"), F.count_if("late").alias("late"))


def late_calls(served: DataFrame) -> DataFrame:
    """The side output: calls that came after later ones of their key were served."""
    return served.where("late")
