"""Rows that arrive in batches, published by one rename and merged in levels.

A batch is written aside and becomes visible when its folder gets its name: ``segment=L<level>-<first batch>-<last batch>-<number>``, in it a folder for each month. Numbers grow with every publication, and of two segments of which one lies in the
other's range, the newer one counts: a batch that is published again takes the place of its former rows (also of those in a larger segment, which keep their batch's number), and ``FANOUT`` neighbours of a level are merged
into one of the next. So a reader sees a batch as it was before or as it is now, never without it, and the folders that it lists grow with the logarithm of the number of batches. What is superseded stays for one more publication, for readers that
have listed it already. One writer at a time.

Files are sorted by time, so a time filter skips row groups, and may have Bloom filters for a key, so looking one up skips those that do not have it.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 8


@dataclass(frozen=True)
class Segment:
    level: int
    first: int
    last: int
    number: int

    @property
    def name(self) -> str:
        return f"L{self.level}-{self.first}-{self.last}-{self.number}"

    def covers(self, other: Segment) -> bool:
        return self.first <= other.first and other.last <= self.last


class Segments:
    """A folder of segments. schema: of the rows, without batch and month; key: a column that gets Bloom filters."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str | None = None, fanout: int = FANOUT, options: dict[str, str] | None = None):
        self.spark, self.root, self.fanout = spark, root.rstrip("/"), fanout
        self.schema = f"{schema}, batch long, segment string, occurred_month string"
        bloom = {f"parquet.bloom.filter.enabled#{key}": "true", "parquet.bloom.filter.adaptive.enabled": "true"} if key else {}
        self.options = bloom | (options or {})

    def _at(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _names(self, path: str = "") -> list[str]:
        fs, folder = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def stored(self) -> list[Segment]:
        """All published segments, superseded ones too."""
        found = (re.fullmatch(r"segment=L(\d+)-(\d+)-(\d+)-(\d+)", name) for name in self._names())
        return sorted((Segment(*map(int, m.groups())) for m in found if m), key=lambda s: (s.first, -s.last, s.number))

    @staticmethod
    def visible(stored: list[Segment]) -> list[Segment]:
        """Those that no newer one covers. Where a newer one lies inside an older, larger one, both are: ``hidden`` has the batches that the larger one lost."""
        return [s for s in stored if not any(t.covers(s) and t.number > s.number for t in stored)]

    @staticmethod
    def hidden(segment: Segment, visible: list[Segment]) -> list[int]:
        return sorted({b for t in visible if t != segment and segment.covers(t) for b in range(t.first, t.last + 1)})

    def months(self, segment: Segment) -> list[str]:
        return sorted(n.split("=", 1)[1] for n in self._names(f"segment={segment.name}") if n.startswith("occurred_month="))

    def rows(self, batch: int | None = None, months: list[str] | None = None) -> DataFrame:
        """All rows, or those of a batch, or of some months, of which only the own folders are listed."""
        return self._read([s for s in self.visible(self.stored()) if batch is None or s.first <= batch <= s.last], batch, months)

    def _read(self, segments: list[Segment], batch: int | None = None, months: list[str] | None = None) -> DataFrame:
        paths = [f"{self.root}/segment={s.name}" for s in segments]
        if months is not None:
            paths = [f"{self.root}/segment={s.name}/occurred_month={m}" for s in segments for m in self.months(s) if m in months]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("basePath", self.root).parquet(*paths)
        for s in segments:
            if lost := self.hidden(s, segments):
                rows = rows.where((F.col("segment") != s.name) | ~F.col("batch").isin(lost))
        return rows if batch is None else rows.where(F.col("batch") == batch)

    def _published(self, rows: DataFrame, level: int, first: int, last: int, stored: list[Segment]) -> Segment:
        """Written aside, then named."""
        aside = f"{self.root}/_aside-{uuid.uuid4().hex}"
        self._write(rows, aside)
        return self._named(aside, level, first, last, stored)

    def _write(self, rows: DataFrame, path: str, *above: str) -> None:
        """A folder for each month, in one for each value of the columns ``above`` it."""
        folders = [*above, "occurred_month"]
        rows.sortWithinPartitions(*folders, "occurred_at").write.options(**self.options).partitionBy(*folders).parquet(path)

    def _named(self, written: str, level: int, first: int, last: int, stored: list[Segment]) -> Segment:
        made = Segment(level, first, last, max((s.number for s in stored), default=-1) + 1)
        fs, root = self._at("")
        fs.mkdirs(root)
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(written)
        if not fs.rename(folder, self._at(f"segment={made.name}")[1]):
            raise OSError(f"{folder} could not be renamed to {made.name}")
        return made

    @staticmethod
    def _of_batch(rows: DataFrame, batch: int) -> DataFrame:
        return rows.withColumns({"batch": F.lit(batch).cast("long"), "occurred_month": F.date_format("occurred_at", "yyyy-MM")})

    def publish(self, rows: DataFrame, batch: int) -> None:
        """Rows (with occurred_at) as the batch, in place of what it has published before; then what is full is merged, and what was superseded before goes."""
        before = self.stored()
        self._published(self._of_batch(rows, batch), 0, batch, batch, before)
        self._settle(before)

    def prepare(self, rows: DataFrame, batch: int, path: str, by: str) -> None:
        """Writes rows as ``publish`` would, into a folder ``by=value`` of the path for each value of a column: each can be published, here or in another folder of segments with the same key."""
        self._write(self._of_batch(rows, batch), path, by)

    def prepared(self, path: str) -> DataFrame:
        """Rows of such a folder; none if no row has its value."""
        fs, folder = self._at("")[0], self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs.mkdirs(folder)
        return self.spark.read.schema(self.schema).parquet(path).drop("segment")

    def publish_prepared(self, path: str, batch: int) -> None:
        """As ``publish``, of such a folder: it gets its name, and nothing is written again."""
        before = self.stored()
        self._at("")[0].mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(path))
        self._named(path, 0, batch, batch, before)
        self._settle(before)

    def _settle(self, before: list[Segment]) -> None:
        keeps = self.visible(before)
        self._merge()
        for segment in before:
            if segment not in keeps:
                self.remove(segment)
        for name in self._names():
            if name.startswith("_aside-"):  # of a writer that was lost
                fs, folder = self._at(name)
                fs.delete(folder, True)

    def _merge(self) -> None:
        level = 0
        while True:
            stored = self.stored()
            visible = self.visible(stored)
            if level > max((s.level for s in visible), default=0):
                return
            own = [s for s in visible if s.level == level and not any(t.level > level and t.covers(s) for t in visible)]
            if len(own) >= self.fanout:
                first, last = own[0].first, max(s.last for s in own[: self.fanout])
                inside = [s for s in visible if first <= s.first and s.last <= last]
                self._published(self._read(inside).drop("segment").hint("rebalance", "occurred_month"), level + 1, first, last, stored)
            level += 1

    def remove(self, segment: Segment) -> None:
        fs, folder = self._at(f"segment={segment.name}")
        fs.delete(folder, True)

    def drop_month(self, month: str) -> bool:
        """Whether there was such a month."""
        gone = False
        for segment in self.stored():
            fs, folder = self._at(f"segment={segment.name}/occurred_month={month}")
            gone |= fs.delete(folder, True)
        return gone

    def all_months(self) -> list[str]:
        return sorted({m for s in self.visible(self.stored()) for m in self.months(s)})
