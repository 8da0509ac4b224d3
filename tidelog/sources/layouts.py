"""A table whose folders were written in layouts of several ages, read as one.

Each layout has a number, which is its folder's name (``layout=<number>``), the schema that its files have, and for each column of today's schema where it comes from: a stored column as it is, one of another name or type, or a default. One scan is
made for each layout. Filters are given by column, operator and value, and are put on the stored columns with the value in the stored type, so they reach each scan; so do the columns that are asked for.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

OPERATORS: dict[str, Callable[[Column, Any], Column]] = {"=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda c, values: c.isin(list(values))}


@dataclass(frozen=True)
class From:
    """A column of today's schema: a stored column (cast to today's type), or a default where there is none.

    stored: gives the stored column's value for a value of today, or None where no stored value becomes it; with it, filters by = and in are put on the stored column. keeps_order: the cast keeps the order, so the other operators are, too.
    """

    column: str | None = None
    default: Any = None
    stored: Callable[[Any], Any] | None = None
    keeps_order: bool = False


@dataclass(frozen=True)
class Layout:
    """schema: of the files; columns: where today's columns come from, if not from a stored column of the same name and type."""

    number: int
    schema: str
    columns: dict[str, From] = field(default_factory=dict)


def write_layout(rows: DataFrame, root: str, layout: Layout) -> None:
    """Appends rows in a layout."""
    rows.select(*StructType.fromDDL(layout.schema).names).write.mode("append").parquet(f"{root.rstrip('/')}/layout={layout.number}")


def _filter(layout: Layout, name: str, op: str, value: Any, today: StructType) -> Column:
    """A filter on the stored columns of a layout."""
    of = layout.columns.get(name, From(name))
    kind = today[name].dataType
    compare = OPERATORS[op]
    typed = [F.lit(v).cast(kind) for v in value] if op == "in" else F.lit(value).cast(kind)
    if of.column is None:
        return compare(F.lit(of.default).cast(kind), typed)
    same = StructType.fromDDL(layout.schema)[of.column].dataType == kind
    if not same and of.stored is not None and (op in ("=", "in") or of.keeps_order):
        if op == "in":
            return F.col(of.column).isin([v for v in map(of.stored, value) if v is not None])
        found = of.stored(value)
        return compare(F.col(of.column), found) if found is not None else F.lit(False)
    return compare(F.col(of.column) if same else F.col(of.column).cast(kind), typed)


def read_layouts(spark: SparkSession, root: str, layouts: Iterable[Layout], schema: str, where: Iterable[tuple[str, str, Any]] = (), columns: list[str] | None = None) -> DataFrame:
    """All layouts' rows in today's schema, for which each of ``where`` (column, operator, value) holds; of the columns, those that are asked for. A layout without a folder has no rows."""
    today = StructType.fromDDL(schema)
    names = columns or today.names
    found = spark.createDataFrame([], today).select(*names)
    for layout in layouts:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/layout={layout.number}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            continue
        rows = spark.read.schema(layout.schema).parquet(path.toString())
        for name, op, value in where:
            rows = rows.where(_filter(layout, name, op, value, today))
        sources = [(n, layout.columns.get(n, From(n))) for n in names]
        found = found.unionByName(rows.select(*((F.col(of.column) if of.column else F.lit(of.default)).cast(today[n].dataType).alias(n) for n, of in sources)))
    return found
