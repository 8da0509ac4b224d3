"""Comparison of a Spark result with DuckDB's on the same Parquet tables."""

import datetime as dt
import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(folder: str = FOLDER):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def kind(name: str) -> str:
    name = name.lower()
    for family, starts in (("int", ("int", "bigint", "long", "hugeint", "smallint", "tinyint")), ("float", ("double", "float", "decimal")), ("time", ("timestamp",)), ("text", ("string", "varchar")), ("bool", ("boolean",)), ("date", ("date",))):
        if name.startswith(starts):
            return family
    return name


def compare(spark_df, con, sql: str) -> None:
    relation = con.sql(sql)
    columns = sorted(spark_df.columns)
    assert columns == sorted(relation.columns), (columns, relation.columns)
    theirs = {c: kind(str(t)) for c, t in zip(relation.columns, relation.types, strict=True)}
    ours = {c: kind(t) for c, t in spark_df.dtypes}
    assert ours == theirs, (ours, theirs)
    at = [relation.columns.index(c) for c in columns]
    expected = Counter(tuple(plain(row[i]) for i in at) for row in relation.fetchall())
    got = Counter(tuple(plain(row[c]) for c in columns) for row in spark_df.collect())
    assert got == expected, f"only here: {list((got - expected).items())[:3]}; only there: {list((expected - got).items())[:3]}; {sum(got.values())} and {sum(expected.values())} rows"
