"""Line dedup in DataFrame operations: levelled sorted runs of line hashes, compacted periodically.

Documents come in batches. A batch's distinct line keys (128-bit hashes) are merge-joined with the runs: a line goes if a run has its key, or if a document of smaller id in the batch has it; keys
that no run has become a run of level 0. When a level has ``FANOUT`` runs they are merged into one of the next level, so a key is rewritten once a level and a batch meets few runs. All runs are bucketed by
key in the same way and sorted within buckets, one file a bucket, so neither the join nor the merging shuffles or sorts them again; only the batch's keys are shuffled. ``LineIndex`` keeps the
runs in a folder, where later batches go on; ``dedup_lines`` takes a whole table in batches of ascending ids through an index of its own.

The text is read once to hash its lines and once to drop them; only hashes, ids and positions go through the runs. Lines to be dropped meet their documents in one join, which shuffles each document once. All
tables lie in the shared folder.

A line that very many documents share is summed up before it is shuffled, and the one join that meets all its places is between two written
tables, which Spark may split by skew.

Defined results: a null or empty text is one empty line. Lines are split at newline; a key is the line without white space at both ends (space, x09-x0D), A-Z in
lower case; keys under ``MIN_LENGTH`` code points stay. Rows of one id are one document, and none of its lines goes on account of another of
them. A null id counts as the largest. All columns pass through, the text replaced; columns n_lines and n_dropped are added (and
replace columns of those names). An empty table gives an empty one.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import string
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, delete, folders, rename, shuffle_partitions

WHITE = " \t\n\x0b\f\r"
MIN_LENGTH, FANOUT = 10, 3
#: A table is taken in so many batches at least, and in more if one would hold more rows.
BATCHES, BATCH_ROWS = 4, 50_000_000
LAST = (1 << 63) - 1
KEY = ["h1", "h2"]
#: Sorted buckets are read as such: in order, and each by one task.
SORTED_BUCKETS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.unionOutputPartitioning": "true"}


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


@contextlib.contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """While plans with runs are made and run; the session's own settings come back."""
    before = {k: spark.conf.get(k, None) for k in SORTED_BUCKETS}
    try:
        for k, v in SORTED_BUCKETS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


class LineIndex:
    """Levelled sorted runs of the line keys of all batches so far, each with the document that owns it, in a folder. One writer at a time.

    ``dropped`` finds the lines of a batch that go, and leaves the batch's new keys beside the runs; ``commit`` adds them, once the batch's result is written. A batch can be taken again, before its
    commit (what was not committed is forgotten) and after it (a document keeps the lines that it owns), with the same result.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        found = [(int(m[1]), int(m[2]), int(m[3])) for m in (re.fullmatch(r"level-(\d+)-run-(\d+)-of-(\d+)", name) for name in folders(spark, self.folder)) if m]
        self.prefix = f"tidelog_{hashlib.sha1(self.folder.encode()).hexdigest()[:16]}"
        for left in spark.sql(f"SHOW TABLES LIKE '{self.prefix}*'").collect():  # of a writer that was lost
            spark.sql(f"DROP TABLE IF EXISTS {left['tableName']}")
        self.buckets = found[0][2] if found else buckets or shuffle_partitions(spark)
        self.made = max((n for _, n, _ in found), default=-1) + 1
        self.levels: list[list[tuple[str, str]]] = [[] for _ in range(max((level for level, *_ in found), default=0) + 1)]
        for level, n, _ in sorted(found):
            self.levels[level].append(self._opened(self._path(level, n)))
        self.pending: tuple[str, str] | None = None
        delete(spark, f"{self.folder}/pending")

    def _path(self, level: int, n: int) -> str:
        return f"{self.folder}/level-{level}-run-{n}-of-{self.buckets}"

    def _opened(self, path: str) -> tuple[str, str]:
        """(table, path): a written run, known to the catalog with its buckets."""
        name = self._name(path)
        self.spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, owner BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return name, path

    def _written(self, rows: DataFrame, path: str) -> tuple[str, str]:
        name = self._name(path)
        rows.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        return name, path

    def _name(self, path: str) -> str:
        """A name in the catalog that goes by the folder and the run."""
        return f"{self.prefix}_{re.sub(r'[^0-9A-Za-z]', '_', path.rsplit('/', 1)[-1])}"

    def _forget(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        delete(self.spark, run[1])

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def marked(self, keys: DataFrame) -> DataFrame:
        """The keys (h1, h2, first, last) of a batch, with ``owner``: the document that owns it by a run, null if none has it."""
        owners = []
        for n, run in enumerate(self.runs()):
            owners.append(f"run{n}")
            keys = keys.join(run.withColumnRenamed("owner", owners[-1]), KEY, "left")
        return keys.select(*KEY, "first", "last", F.coalesce(*owners, F.lit(None).cast("long")).alias("owner"))

    def dropped(self, lines: DataFrame, scratch: Scratch, name: str) -> DataFrame:
        """doc, same, pos of the lines (doc, same, pos, h1, h2) of a batch that go."""
        if self.pending:
            self._forget(self.pending)
        keys = lines.groupBy(*KEY).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        if self.buckets != shuffle_partitions(self.spark):
            keys = keys.repartition(self.buckets, *KEY)
        with sorted_buckets(self.spark):
            seen = self._written(self.marked(keys), f"{scratch.root}/{name}-seen")
            self.pending = self._written(self.spark.table(seen[0]).where("owner IS NULL").select(*KEY, F.col("first").alias("owner")), f"{self.folder}/pending")
        again = self.spark.read.schema("h1 long, h2 long, first long, last long, owner long").parquet(seen[1]).where("owner IS NOT NULL OR last > first")  # not by buckets: a hot key's places may be split
        gone = scratch.save(lines.join(again, KEY).where(F.coalesce("owner", "first") != F.col("doc")).select("doc", "same", "pos"), f"{name}-dropped")
        self._forget(seen)
        return gone

    def commit(self) -> None:
        """Adds the new keys of the last batch, and merges levels that are full."""
        if self.pending is None:
            return
        self.spark.sql(f"DROP TABLE IF EXISTS {self.pending[0]}")
        path = self._next(0)
        rename(self.spark, self.pending[1], path)
        self.levels[0].append(self._opened(path))
        self.pending = None
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                old = self.levels[level]
                with sorted_buckets(self.spark):
                    merged = self.merged([self.spark.table(name) for name, _ in old])
                    self.levels[level + 1].append(self._written(merged, self._next(level + 1)))
                self.levels[level] = []
                for run in old:
                    self._forget(run)

    def _next(self, level: int) -> str:
        self.made += 1
        return self._path(level, self.made - 1)

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionAll, runs).groupBy(*KEY).agg(F.min("owner").alias("owner"))

    def close(self) -> None:
        """The catalog forgets the runs; they stay in the folder."""
        for name, _ in [run for level in self.levels for run in level] + [self.pending] * bool(self.pending):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _row_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """row (all columns), doc, same; and the text as a column of these."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns if c not in ("n_lines", "n_dropped"))).alias("row"))
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    return rows.select("row", F.coalesce(F.col("row").getField(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("same")), text


def _hashed(rows: DataFrame, text: Column, min_length: int, *more: Column) -> DataFrame:
    """doc, same, pos, h1, h2 of the lines whose keys are long enough."""
    found = rows.select("doc", "same", *more, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("key", line_key(F.col("line"))).drop("line")
    return found.where(F.length("key") >= min_length).withColumns({"h1": F.xxhash64("key"), "h2": F.xxhash64(F.lit(7), "key")}).drop("key")


def _without(rows: DataFrame, text: Column, gone: DataFrame, text_col: str) -> DataFrame:
    """The documents without the lines at gone (doc, same, gone), with n_lines and n_dropped."""
    joined = rows.join(gone, ["doc", "same"], "left").withColumn("lines", F.split(text, "\n"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    new = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return joined.select(F.col("row").withField(text_col, new).alias("row"), F.size("lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped")).select("row.*", "n_lines", "n_dropped")


def _by_document(dropped: DataFrame) -> DataFrame:
    return dropped.groupBy("doc", "same").agg(F.collect_set("pos").alias("gone"))


def dedup_batch(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """The documents of a new batch without the lines that an earlier batch of the index holds, or a document of smaller id in this one. Write the result, then call ``index.commit()``."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows, text = _row_of(docs, id_col, text_col)
    lines = scratch.save(_hashed(rows, text, min_length), "lines")
    gone = scratch.save(_by_document(index.dropped(lines, scratch, "batch")), "gone")
    scratch.drop("lines", "batch-dropped")
    return _without(rows, text, gone, text_col)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """The documents without the lines that a document of smaller id holds, with n_lines (before) and n_dropped."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows, text = _row_of(docs, id_col, text_col)
    shares = [i / 64 for i in range(1, 64)]
    seen = rows.agg(F.count("*").alias("n"), F.percentile_approx("doc", shares, 1000).alias("cuts")).first()
    batches = batches or min(64, max(BATCHES, -(-seen["n"] // BATCH_ROWS)))
    cuts = sorted({seen["cuts"][round(64 * i / batches) - 1] for i in range(1, batches)} if seen["n"] else ())
    batch = reduce(Column.__add__, [(F.col("doc") > c).cast("int") for c in cuts], F.lit(0))
    lines = scratch.save(_hashed(rows, text, min_length, batch.alias("batch")), "lines", by="batch")
    index, dropped = LineIndex(docs.sparkSession, f"{scratch.root}/runs", fanout=fanout), []
    for b in range(len(cuts) + 1):
        dropped.append(index.dropped(lines.where(F.col("batch") == b), scratch, f"batch{b}"))
        index.commit()
    index.close()
    gone = scratch.save(_by_document(reduce(DataFrame.unionAll, dropped)), "gone")
    scratch.drop("lines", "runs", *(f"batch{b}-dropped" for b in range(len(cuts) + 1)))
    return _without(rows, text, gone, text_col)
