"""Helpers that several operators use: tables, scratch tables in the shared folder, quantised sizes."""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import shutil
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_dir() -> str:
    """One folder for this process, where all tasks run on this machine; it goes when the process ends."""
    path = tempfile.mkdtemp(prefix="tidelog-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset: in local mode (tests) a temporary one, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (base or _local_dir()).rstrip("/")


class Scratch:
    """Tables written in the shared folder to cut lineage: a lost executor costs no more than the step it was in.

    Operators drop what they no longer need. What a result still reads stays until ``remove_scratch``, or the end of ``temporary``.
    """

    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"
        Scratch.made.append(self)

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """The same rows, read from a table that is written now; by: a column to lay it out in folders by."""
        (df.write.partitionBy(by) if by else df.write).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def remove(self) -> None:
        self._delete(self.root)
        if self in Scratch.made:
            Scratch.made.remove(self)

    def _delete(self, folder: str) -> None:
        delete(self.spark, folder)


def _at(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def delete(spark: SparkSession, folder: str) -> None:
    fs, path = _at(spark, folder)
    fs.delete(path, True)


def rename(spark: SparkSession, folder: str, to: str) -> None:
    fs, path = _at(spark, folder)
    if not fs.rename(path, _at(spark, to)[1]):
        raise OSError(f"{folder} could not be renamed to {to}")


def folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the completely written tables in a folder."""
    fs, path = _at(spark, folder)
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    return [p.getName() for p in found if fs.exists(_at(spark, f"{folder}/{p.getName()}/_SUCCESS")[1])]


def remove_scratch() -> None:
    """Deletes all that the operators of this process have left in the shared folder. Call it when their results are written or read."""
    for scratch in list(Scratch.made):
        scratch.remove()


@contextlib.contextmanager
def temporary():
    """What operators leave in the shared folder within this block goes at its end; their results must be written by then."""
    before = list(Scratch.made)
    try:
        yield
    finally:
        for scratch in [s for s in Scratch.made if s not in before]:
            scratch.remove()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_text(column: Column) -> Column:
    """CRC-32 of the decimal text of an id; null for null."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8"))


def finite_vector(column: Column) -> Column:
    """True for arrays of finite numbers; null, and holding null, NaN or infinity, are false."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(column.isNotNull() & ~F.exists(column, bad), F.lit(False))


def vector_kind(df: DataFrame, column: str) -> str:
    """float for arrays of floats, which are shuffled as they are; double for all others."""
    return "float" if df.schema[column].dataType.simpleString() == "array<float>" else "double"
