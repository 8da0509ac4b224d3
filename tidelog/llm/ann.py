"""Approximate nearest neighbours by cosine: a forest of random-projection trees, searched through one shared priority queue.

The forest is fitted on a bounded sample of the distinct vectors (``sample``, ``SAMPLE_BYTES``): a split is the direction between two sampled points, cut at the median, down to leaves of sqrt(n) / 4 rows
(16 at least, and ``LEAST_POINTS`` of the sample), so their number grows with the table. Every vector is routed to its leaf in each tree. A query pops nodes of all trees from one queue, the least squared distance to the cuts on the
wrong side first. It is joined with the vectors on the leaves it reached, and what these hold is ranked by exact cosine in double precision; k + 1 classes per query and block go on to the final ranking.

How far the queue is followed is measured, not set: for at most ``calibrate`` of the queries the true neighbours are found by one pass over all vectors, and the rows visited are as many as reach the share ``aim`` of
these. The larger the table, the smaller that share of it. Where it would be the whole table (few rows, or vectors without any structure), all leaves of one tree are visited, so each vector is scored once.

Neighbouring leaves of a tree lie in one block of about ``BLOCK_ROWS`` rows, which is the key of the join; within it, a query is compared with its own leaves. A block that holds more, or that many queries
reach, is cut into slices of bounded size (``CAND_BYTES``, ``QUERY_BYTES``), each with each. Blocks that no query reaches are not sent.

Identical vectors form one class, held as one vector and its k + 1 smallest ids: a class of any size costs one row and no
member is lost, since a query returns k ids other than its own.

Defined results: vectors null, empty, zero or with null or non-finite components take no part, nor do rows without an id. Vectors are compared with those of their own length only; the forest serves
the length that most vectors have, those of another length are all scored. Ties go to the smaller id. An id that repeats with one vector counts once; with several, its best score counts. Fewer than
k candidates: those that there are. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, finite_vector, shuffle_partitions, vector_kind

SAMPLE, TREES, CALIBRATE, AIM, SEED = 32_768, 12, 128, 0.95, 42
#: Bytes of the sample, points of it in a leaf at least, and rows of a block.
SAMPLE_BYTES, LEAST_POINTS, BLOCK_ROWS = 32 << 20, 8, 4096
#: Bytes of the candidates and the queries of a slice, in doubles, and queries that are ranked at once.
CAND_BYTES, QUERY_BYTES, AT_ONCE = 16 << 20, 8 << 20, 1024


class Forest:
    """Trees in flat arrays. Node v < 0 is the leaf -v - 1; leaves are numbered through all trees. most: points of a leaf; block: leaves that lie together, none of two trees."""

    def __init__(self, points: np.ndarray, trees: int = TREES, most: int = LEAST_POINTS, block: int = 1, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.points, self.dim, self.block = len(points), points.shape[1], block
        self.normals, self.offsets, self.left, self.right, self.sizes, self.ends = [], [], [], [], [], []
        self.roots = []
        for _ in range(trees):
            self.roots.append(self._grow(points, np.arange(len(points)), max(1, most), rng))
            self.sizes += [0] * (-len(self.sizes) % block)
            self.ends.append(len(self.sizes))
        self.normals, self.offsets = np.array(self.normals).reshape(-1, points.shape[1]), np.array(self.offsets)

    def _grow(self, points, rows, most, rng) -> int:
        if len(rows) > most:
            a, b = points[rng.choice(rows, 2, replace=False)]
            normal = (a - b) / max(np.sqrt(((a - b) ** 2).sum()), 1e-300)
            along = points[rows] @ normal
            half = len(rows) // 2
            cut = np.partition(along, [half - 1, half])[half - 1 : half + 1].mean()  # between two points, so that rounding puts none on the other side
            below = along <= cut
            if 0 < below.sum() < len(rows):
                me = len(self.offsets)
                for column, x in ((self.normals, normal), (self.offsets, cut), (self.left, 0), (self.right, 0)):
                    column.append(x)
                self.left[me] = self._grow(points, rows[below], most, rng)
                self.right[me] = self._grow(points, rows[~below], most, rng)
                return me
        self.sizes.append(len(rows))
        return -len(self.sizes)

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree."""
        left, right = np.array(self.left, np.int64), np.array(self.right, np.int64)
        out = np.empty((len(points), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            at = np.full(len(points), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                below = np.einsum("ij,ij->i", points[inner], self.normals[node]) <= self.offsets[node]
                at[inner] = np.where(below, left[node], right[node])
            out[:, t] = -at - 1
        return out

    def walk(self, point: np.ndarray) -> Iterator[int]:
        """All leaves, in the order of the shared queue."""
        margins = (self.normals @ point - self.offsets).tolist()
        queue, left, right = [(0.0, root) for root in self.roots], self.left, self.right
        while queue:
            far, node = heapq.heappop(queue)
            while node >= 0:  # down the near side, which is no farther than the node
                m = margins[node]
                near, other = (left[node], right[node]) if m <= 0 else (right[node], left[node])
                heapq.heappush(queue, (far + m * m, other))
                node = near
            yield -node - 1

    def probe(self, point: np.ndarray, visits: float) -> list[int]:
        """The leaves of the queue until they hold that share of the sample; those of the first tree, if that is all of it."""
        if visits >= 1:
            return list(range(self.ends[0]))
        found, held = [], 0
        for leaf in self.walk(point):
            found.append(leaf)
            held += self.sizes[leaf]
            if held >= visits * self.points:
                break
        return found

    def asked_for(self, point: np.ndarray, targets: np.ndarray) -> list[float]:
        """For each target the share of the sample that has to be visited to reach it: 1 if it is all."""
        missing: dict[int, set[int]] = {}
        for i, of in enumerate(self.leaves(targets).tolist()):
            for leaf in of:
                missing.setdefault(leaf, set()).add(i)
        share, held, left = [1.0] * len(targets), 0, len(targets)
        for leaf in self.walk(point):
            held += self.sizes[leaf]
            if held >= self.points or not left:
                break
            for i in missing.get(leaf, ()):
                if share[i] == 1.0:
                    share[i], left = held / self.points, left - 1
        return share


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(points: np.ndarray) -> np.ndarray:
    """Scaled twice, so that neither tiny nor huge components leave the range of doubles."""
    points = points / np.abs(points).max(1, keepdims=True)
    return points / np.sqrt((points**2).sum(1, keepdims=True))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows, summed dimension by dimension, so that equal pairs give equal scores wherever they are computed."""
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for d in range(a.shape[1]):
        dot += a[:, d] * b[:, d]
        aa += a[:, d] ** 2
        bb += b[:, d] ** 2
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def _of_length(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("dim").to_numpy(zero_copy_only=False) == dim


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in rows])), pa.int32()), pa.array(flat, pa.int32()))


def _leaves(forest_in, visits: float | None = None):
    """Adds the leaves of a vector, or those that it reaches as a query, in a list for each block. Vectors of another length than the forest's lie in a leaf of their own, a negative one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = forest_in.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                leaves = [np.array([-d], np.int32) for d in part.column("dim").to_pylist()]
                blocks = [[of] for of in leaves]
                if len(own := np.flatnonzero(_of_length(part, forest.dim))):
                    units = _unit(_matrix(part.column("vec").take(pa.array(own))))
                    if visits is None:
                        for i, of in zip(own, forest.leaves(units), strict=True):
                            leaves[i] = of
                    else:
                        for i, unit in zip(own, units, strict=True):
                            reached = np.sort(np.array(forest.probe(unit, visits), np.int32))
                            blocks[i] = np.split(reached, np.flatnonzero(np.diff(reached // forest.block)) + 1)
                of = _lists(leaves) if visits is None else pa.array(blocks, pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*part.columns, of], [*part.schema.names, "leaves"])

    return run


def _closest(queries_in, k: int):
    """The k nearest other vectors of each of a few queries, within a partition: a query's number, the cosine, the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = queries_in.value
        for batch in batches:
            for at in range(0, batch.num_rows, 16384):
                part = batch.slice(at, 16384)
                cosines = queries @ _unit(_matrix(part.column("vec"))).T
                cosines[cosines > 1 - 1e-12] = -2  # the query's own class
                some = min(k, part.num_rows)
                rows = np.argpartition(-cosines, some - 1, axis=1)[:, :some]
                number = np.repeat(np.arange(len(queries), dtype=np.int32), some)
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(cosines[number, rows.ravel()]), part.column("vec").take(pa.array(rows.ravel()))], ["query", "cosine", "vec"])

    return run


def _visits(forest_in, own: DataFrame, asked: DataFrame, k: int, calibrate: int, aim: float, kind: str) -> float:
    """The share of the sample's points that queries visit: as many as reach the share ``aim`` of the k nearest others of at most ``calibrate`` queries."""
    some = asked.where(F.col("dim") == forest_in.value.dim).orderBy("q1", "q2").select("vec").limit(calibrate).toArrow()["vec"]  # q1 is a hash
    if not len(some):
        return 1.0
    queries = _unit(_matrix(some))
    near = own.select("vec").mapInArrow(_closest(own.sparkSession.sparkContext.broadcast(queries), k), f"query int, cosine double, vec array<{kind}>")
    best = Window.partitionBy("query").orderBy(F.desc("cosine"))
    near = near.where("cosine > -2").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("query", "vec").toArrow()  # calibrate * k rows at most
    if not len(near):
        return 1.0
    number, targets = near["query"].to_numpy(), _unit(_matrix(near["vec"]))
    shares = sorted(s for i in np.unique(number) for s in forest_in.value.asked_for(queries[i], targets[number == i]))
    return shares[math.ceil(aim * len(shares)) - 1]


NEAR = "q1 long, q2 long, h1 long, h2 long, ids array<long>, score double, scored long"


def _rerank(keep: int):
    kinds = pa.schema([("q1", pa.int64()), ("q2", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64()), ("scored", pa.int64())])

    def run(queries: pa.Table, cands: pa.Table) -> pa.Table:
        if not len(queries) or not len(cands):
            return kinds.empty_table()
        q, c = _matrix(queries.column("vec")), _matrix(cands.column("vec"))
        qu, cu = _unit(q), _unit(c)
        ids = cands.column("ids").combine_chunks()
        least = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
        leaf = cands.column("leaf").to_numpy()
        by_leaf = np.argsort(leaf, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(leaf[by_leaf]) != 0))
        rows_of = dict(zip(leaf[by_leaf[starts]].tolist(), np.split(by_leaf, starts[1:]), strict=True))
        asked, some, parts = queries.column("leaves").combine_chunks(), keep + 4, []
        for at in range(0, len(q), AT_ONCE):
            of = asked.slice(at, AT_ONCE)
            whose = at + np.repeat(np.arange(len(of)), np.diff(of.offsets.to_numpy()))
            reached = of.flatten().to_numpy()
            counted, near_q, near_c = np.zeros(len(of), np.int64), [], []
            for one in np.unique(reached).tolist():
                if one not in rows_of:
                    continue
                mine, theirs = whose[reached == one], rows_of[one]
                counted[mine - at] += len(theirs)
                step = max(1, (1 << 21) // len(theirs))
                for s in range(0, len(mine), step):
                    close = qu[mine[s : s + step]] @ cu[theirs].T
                    floor = np.partition(close, len(theirs) - some, axis=1)[:, len(theirs) - some, None] - 1e-12 if len(theirs) > some else -np.inf
                    i, j = np.nonzero(close >= floor)  # ties stay
                    near_q.append(mine[s + i]), near_c.append(theirs[j])
            if not near_q:
                continue
            i, j = np.concatenate(near_q), np.concatenate(near_c)
            scores = np.concatenate([exact_cosine(q[i[s : s + 65536]], c[j[s : s + 65536]]) for s in range(0, len(i), 65536)])
            order = np.lexsort((least[j], -scores, i))
            i, j, scores = i[order], j[order], scores[order]
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
            parts.append([x[place < keep] for x in (i, j, scores, np.where(place == 0, counted[i - at], 0))])
        if not parts:
            return kinds.empty_table()
        i, j, scores, counted = map(np.concatenate, zip(*parts, strict=True))
        at, of = pa.array(i), pa.array(j)
        return pa.Table.from_arrays([*(queries.column(n).take(at) for n in ("q1", "q2")), *(cands.column(n).take(of) for n in ("h1", "h2", "ids")), pa.array(scores), pa.array(counted)], schema=kinds)

    return run


def nearest(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, trees: int = TREES, calibrate: int = CALIBRATE, aim: float = AIM, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score, scored: for each row that is a query, the k nearest other rows found, and how many vectors were scored for it (one in several of the leaves it reached once for each)."""
    spark = df.sparkSession
    keep, kind = k + 1, vector_kind(df, vec_col)
    ok = F.col(id_col).isNotNull() & finite_vector(F.col(vec_col)) & F.coalesce(F.exists(F.col(vec_col), lambda x: x != 0), F.lit(False))
    rows = df.where(ok).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(7), "vec")})
    # A class per distinct vector with its smallest ids; the row limit is pushed below the shuffle, so copies are cut where they are read.
    by_vector = Window.partitionBy("h1", "h2").orderBy("id")
    scratch = Scratch(spark, "ann")
    classes = rows.select("h1", "h2", "id", "vec").withColumn("n", F.dense_rank().over(by_vector)).where(F.col("n") <= keep).groupBy("h1", "h2").agg(F.any_value("vec").alias("vec"), F.array_sort(F.collect_set("id")).alias("ids"))
    classes = scratch.save(classes.withColumn("dim", F.size("vec")), "classes")
    lengths = classes.groupBy("dim").agg(F.count("*").alias("n"))
    n, dim = lengths.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("dim"), F.lit(1))).first()
    most = lengths.orderBy(F.desc("n"), "dim").first()
    own = classes.where(F.col("dim") == (most["dim"] if most else 0))
    sample, points = min(sample, max(64, SAMPLE_BYTES // (8 * dim))), own
    if most and most["n"] > sample:
        points = own.where(F.pmod(F.xxhash64("h2"), F.lit(1 << 30)) < int(0.97 * sample / most["n"] * (1 << 30)))
    points = points.select("vec").limit(sample).toArrow()["vec"]
    points = _unit(_matrix(points)) if len(points) else np.zeros((1, 1))
    rows_of_leaf = max(16, math.isqrt(n) // 4)
    points_of_leaf = max(LEAST_POINTS, rows_of_leaf * len(points) // max(1, n))
    block = max(1, BLOCK_ROWS * len(points) // (points_of_leaf * max(1, n)))
    forest = Forest(points, trees, points_of_leaf, block, seed)
    shared = spark.sparkContext.broadcast(forest)  # trees * sample / 8 splits at most
    asking = rows.where("asks").select(F.col("id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"), "vec")
    asked = asking.groupBy("q1", "q2").agg(F.any_value("vec").alias("vec")).withColumn("dim", F.size("vec"))
    asked = scratch.save(asked.repartition(shuffle_partitions(spark)), "asked")
    visits = _visits(shared, own, asked, k, calibrate, aim, kind)
    cands = scratch.save(classes.mapInArrow(_leaves(shared), f"h1 long, h2 long, vec array<{kind}>, ids array<long>, dim int, leaves array<int>"), "routed")
    probes = scratch.save(asked.mapInArrow(_leaves(shared, visits), f"q1 long, q2 long, vec array<{kind}>, dim int, leaves array<array<int>>"), "probed")
    block_of = lambda leaf: F.when(leaf < 0, leaf).otherwise(F.floor(leaf / block).cast("int"))
    cands = cands.select("h1", "h2", "vec", "ids", F.explode("leaves").alias("leaf")).withColumn("block", block_of(F.col("leaf")))
    probes = probes.select("q1", "q2", "vec", F.explode("leaves").alias("leaves")).withColumn("block", block_of(F.col("leaves")[0]))
    slices = lambda rows, of, most_bytes: rows.groupBy("block").agg(F.ceil(F.count("*") * 8 * dim / most_bytes).cast("int").alias(of))
    cut = slices(cands, "n_c", CAND_BYTES).join(slices(probes, "n_q", QUERY_BYTES), "block")
    cut = F.broadcast(scratch.save(cut, "cut"))  # a row a block: as bounded as the forest, and one for each other length of vectors
    to_all = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    cands = cands.join(cut, "block").withColumn("cb", F.pmod("h1", "n_c").cast("int")).withColumn("qb", to_all("n_q"))
    probes = probes.join(cut, "block").withColumn("qb", F.pmod("q1", "n_q").cast("int")).withColumn("cb", to_all("n_c"))
    keys = ["block", "qb", "cb"]
    near = probes.select(*keys, "q1", "q2", "vec", "leaves").groupBy(*keys).cogroup(cands.select(*keys, "h1", "h2", "vec", "ids", "leaf").groupBy(*keys)).applyInArrow(_rerank(keep), NEAR)
    # A class may come from several trees, with one score.
    once = near.groupBy("q1", "q2", "h1", "h2").agg(F.any_value("ids").alias("ids"), F.max("score").alias("score"), F.sum("scored").alias("scored"))
    by_query = Window.partitionBy("q1", "q2")
    order = by_query.orderBy(F.desc("score"), F.col("ids")[0], "h1", "h2")
    found = once.withColumns({"n": F.row_number().over(order), "scored": F.sum("scored").over(by_query)}).where(F.col("n") <= keep).select("q1", "q2", "ids", "score", "scored")
    found = scratch.save(found, "found")
    scratch.drop("routed", "probed", "cut")
    scratch.drop("classes"), scratch.drop("asked")
    each = asking.select("query_id", "q1", "q2").join(found, ["q1", "q2"]).select("query_id", F.explode("ids").alias("vec_id"), "score", "scored").where(F.col("vec_id") != F.col("query_id"))
    each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max("scored").alias("scored"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "scored")
