"""A message log of numbered segments as a streaming source with offsets.

A segment is a Parquet file of messages (one text column, ``value``), named by its number; its footer tells how many there are, so no segment is opened to plan a batch. An offset is (segment, record): so many records of that
segment, and all before it, are taken. A batch takes ``rows`` messages at most, across the borders of segments, and any range can be read again. With ``catch_up``, a backlog that would take more batches than that is taken in so many
equal ones, as a batch has a fixed cost; once it is used up, ``rows`` is the bound again. A batch is read in ranges of at most ``RANGE`` records. A message is a JSON object whose values are texts, numbers or null; anything else is set
aside: it comes with its own text in ``wrong`` and no fields.

Spark tells a source of this kind where a batch begins only after it has asked where the batch shall end, so the source looks the last planned offset up in the query's checkpoint, which is therefore an option of it.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .schemas import RAW_FIELDS

ROWS = 500
#: Records of a task.
RANGE = 50_000
SCHEMA = ", ".join(f"{f} string" for f in RAW_FIELDS) + ", arrival_seq long, retryCount int, segment long, record long, wrong string"
NAME = re.compile(r"segment-(\d+)\.parquet")
COUNTERS = ("arrival_seq", "retryCount")


def append_segments(messages: DataFrame, path: str, column: str = "value") -> int:
    """Appends the messages, a segment for each file that Spark writes, in the order of the partitions; the number of segments then. One writer at a time: files are written aside and renamed."""
    spark = messages.sparkSession
    aside = f"{path.rstrip('/')}/_aside-{uuid.uuid4().hex}"
    messages.select(messages[column].cast("string").alias("value")).write.parquet(aside)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = [int(m[1]) for s in fs.listStatus(at(path)) if (m := NAME.fullmatch(s.getPath().getName()))]
    n = max(numbers, default=-1) + 1
    for name in sorted(s.getPath().getName() for s in fs.listStatus(at(aside)) if s.getPath().getName().startswith("part-")):
        fs.rename(at(f"{aside}/{name}"), at(f"{path}/segment-{n:012d}.parquet"))
        n += 1
    fs.delete(at(aside), True)
    return n


def fields_of(text: str | None) -> tuple[dict, str | None]:
    """The fields of a message, or its text if it is of a wrong type."""
    try:
        found = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        found = None
    plain = isinstance(found, dict) and all(v is None or (isinstance(v, (str, int, float)) and not isinstance(v, bool)) for v in found.values())
    if not plain or any(not isinstance(found.get(c), (int, type(None))) for c in COUNTERS):
        return {}, text if text is not None else ""
    return {k: v if v is None or k in COUNTERS or isinstance(v, str) else json.dumps(v) for k, v in found.items()}, None


class Range(InputPartition):
    """Records of one segment."""

    def __init__(self, segment: int, first: int, end: int):
        self.segment, self.first, self.end = segment, first, end


class MessageReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.rows, self.checkpoint = options["path"].rstrip("/"), int(options.get("rows", ROWS)), options.get("checkpoint")
        self.catch_up, self.size, self.used_up = int(options.get("catch_up", 0)), 0, False
        self.counts: dict[int, int] = {}
        self.at: tuple[int, int] | None = None

    @staticmethod
    def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")

    def _name(self, segment: int) -> str:
        return f"{self.path}/segment-{segment:012d}.parquet"

    def _listed(self) -> list[int]:
        """Numbers of the segments; new ones are counted by their footers."""
        fs, folder = self._opened(self.path)
        found = sorted(int(m[1]) for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if (m := NAME.fullmatch(f.base_name)))
        for n in found:
            if n not in self.counts:
                fs, file = self._opened(self._name(n))
                with fs.open_input_file(file) as opened:
                    self.counts[n] = pq.read_metadata(opened).num_rows
        return found

    def _planned(self) -> tuple[int, int]:
        """The end of the last batch that the query has planned."""
        if self.checkpoint:
            fs, folder = self._opened(f"{self.checkpoint.rstrip('/')}/offsets")
            batches = [f for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.base_name.isdigit()]
            if batches:
                with fs.open_input_stream(max(batches, key=lambda f: int(f.base_name)).path) as opened:
                    offset = json.loads(opened.read().decode().splitlines()[2])
                return offset["segment"], offset["record"]
        return 0, 0

    def initialOffset(self) -> dict:
        return {"segment": 0, "record": 0}

    def latestOffset(self) -> dict:
        segment, record = self.at if self.at is not None else self._planned()
        listed = self._listed()
        waiting = sum(self.counts[n] for n in listed if n >= segment) - (record if segment in listed else 0)
        if self.catch_up:
            self.size = max(self.size, -(-waiting // self.catch_up))
        left = max(self.rows, self.size)
        self.used_up = waiting <= left
        for n in listed:
            if n < segment or left <= 0:
                continue
            begin = record if n == segment else 0
            taken = min(left, self.counts[n] - begin)
            if taken > 0:
                segment, record, left = n, begin + taken, left - taken
        return {"segment": segment, "record": record}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = end["segment"], end["record"]
        if self.used_up:
            self.size = 0
        ranges = []
        for n in self._listed():
            if start["segment"] <= n <= end["segment"]:
                first = start["record"] if n == start["segment"] else 0
                last = end["record"] if n == end["segment"] else self.counts[n]
                ranges += [Range(n, at, min(at + RANGE, last)) for at in range(first, last, RANGE)]
        return ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names, kinds = [*RAW_FIELDS, *COUNTERS, "segment", "record", "wrong"], [pa.string()] * len(RAW_FIELDS) + [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        fs, file = self._opened(self._name(partition.segment))
        with fs.open_input_file(file) as opened:
            file = pq.ParquetFile(opened)
            sizes = [file.metadata.row_group(g).num_rows for g in range(file.num_row_groups)]
            ends = list(accumulate(sizes))
            groups = [g for g, (size, end) in enumerate(zip(sizes, ends, strict=True)) if end > partition.first and end - size < partition.end]
            at = ends[groups[0]] - sizes[groups[0]]
            for batch in file.iter_batches(batch_size=4096, row_groups=groups, columns=["value"]):
                begin, end = max(0, partition.first - at), min(len(batch), partition.end - at)
                if begin < end:
                    made = [fields_of(text) for text in batch.column("value").slice(begin, end - begin).to_pylist()]
                    rows = [fields | {"segment": partition.segment, "record": at + begin + i, "wrong": wrong} for i, (fields, wrong) in enumerate(made)]
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kind) for n, kind in zip(names, kinds, strict=True)], names)
                at += len(batch)
                if at >= partition.end:
                    return

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelog_messages"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return MessageReader(self.options)


def message_stream(spark: SparkSession, path: str, checkpoint: str, rows: int = ROWS, catch_up: int = 0) -> DataFrame:
    """The messages as a stream of batches of ``rows`` at most, but for a backlog of more than ``catch_up`` batches (0: always); checkpoint: the folder that the query is started with."""
    spark.dataSource.register(MessageLog)
    return spark.readStream.format("tidelog_messages").option("rows", rows).option("catch_up", catch_up).option("checkpoint", checkpoint).load(path)
