"""Connected components of a link table by hooking and contraction, in DataFrame operations.

Each round hooks every node to its smallest smaller neighbour, jumps along the hooks until all point to a local minimum (each jump makes the way four times as long, so a chain of n links takes
log4(n) jumps), relabels the links with the minima and drops loops. Only local minima go on to the next round. Each step's table is written to the shared folder. Joins with a hot node (a hub of the
contracted links) are between two written tables, which Spark may split by skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _through(rows: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """The rows with a column's nodes replaced by what they are hooked to."""
    joined = rows.join(hooks.select(F.col("node").alias("_node"), F.col("to").alias("_to")), F.col(column) == F.col("_node"), "left")
    return joined.withColumn(column, F.coalesce("_to", column)).drop("_node", "_to")


def _jumped(hooks: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, to: hooks (node, to) led on to nodes that are not hooked themselves."""
    n = 0
    while True:
        before = hooks.withColumn("was", F.col("to"))
        after = scratch.save(_through(_through(before, "to", hooks), "to", hooks).withColumn("moved", F.col("to") != F.col("was")).drop("was"), f"{name}-{n}")
        if n:
            scratch.drop(f"{name}-{n - 1}")
        hooks, n = after.select("node", "to"), n + 1
        if after.where("moved").isEmpty():
            return hooks


def connected_components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node, root (smallest node reachable) for each node of links (a, b); loops and repeated links do no harm."""
    links = scratch.save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), f"{name}-links0")
    roots = scratch.save(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), f"{name}-roots0")
    n = 0
    while not links.isEmpty():
        own = scratch.save(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")), f"{name}-own{n}")
        hooks = _jumped(own, scratch, f"{name}-hooks{n}")
        moved = scratch.save(_through(links, "a", hooks), f"{name}-moved{n}")
        links = _through(moved, "b", hooks).where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        links = scratch.save(links, f"{name}-links{n + 1}")
        roots = scratch.save(_through(roots, "root", hooks), f"{name}-roots{n + 1}")
        scratch.drop(*(f"{name}-{step}{n}" for step in ("own", "moved", "links", "roots")))
        n += 1
    return roots
