"""Exact top-k by inner product: branch-and-bound over dimension blocks of a vertical (dimension-major) layout.

The stated query set meets all rows in blocks: candidates are dealt to groups of about ``cand_block`` rows and queries to
groups of about ``query_block`` (by default as many as a bound in bytes allows), and each pair of groups is one task-sized piece of work. In it, dimensions are visited by
falling energy, a block of them at a time. After a block, a candidate's score lies within |q_rest| * |c_rest| of its partial
sum (Cauchy-Schwarz); candidates whose upper bound is below the k-th largest lower bound go, and the survivors are compacted
before the next block. Each pair of groups returns k rows per query, so no more than that is shuffled for the final ranking.
Rows are dealt by id and vector, so an id that very many rows hold is spread over all groups.

Defined results: rows with a null id, a null vector or null or non-finite components take no part. Vectors are compared with those of their own length only. Equal rows of an id and a vector count once; of an id with
several vectors, the best score counts. Ties go to the smaller id. Fewer than k candidates: all of them. Empty tables give empty results. Other columns are ignored. Products that leave the exact range of doubles are computed in Python integers; scores beyond
the range of long are brought to its ends, and rank as that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import finite_vector, shuffle_partitions, vector_kind

RESULT = "query_id long, vec_id long, score long"
#: Dimensions that are accumulated between two prunings, and bytes of the candidates and the queries of a block, in doubles (each row meets all blocks of the other side, so larger blocks shuffle less).
DIM_BLOCK, CAND_BYTES, QUERY_BYTES = 16, 16 << 20, 8 << 20
LIMIT = 2**63


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best ids, each with its best score."""
    order = np.lexsort((ids, -scores))
    if len(np.unique(ids)) < len(ids):
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
    return order[:k]


def branch_and_bound(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, candidate ids, scores) of the k best candidates of each query. Integers in float64, exact below 2**53."""
    k_rows = k + len(c_ids) - len(np.unique(c_ids))  # rows that are sure to hold k ids
    energy = np.argsort(-(c * c).sum(0), kind="stable")
    columns = np.ascontiguousarray(c.T[energy])  # vertical layout: one row per dimension
    q = q[:, energy]
    starts = list(range(0, columns.shape[0], DIM_BLOCK))
    rest = lambda m: [np.sqrt((m[s + DIM_BLOCK :] ** 2).sum(0)) for s in starts]
    c_rest, q_rest = rest(columns), rest(q.T)
    for at in range(0, len(q_ids), 64):
        part = q[at : at + 64, : DIM_BLOCK] @ columns[:DIM_BLOCK]
        for i in range(part.shape[0]):
            j = at + i
            alive = np.flatnonzero(c_ids != q_ids[j])
            sums = part[i, alive]
            for b, s in enumerate(starts):
                if b:
                    sums = sums + q[j, s : s + DIM_BLOCK] @ columns[s : s + DIM_BLOCK, alive]
                slack = q_rest[b][j] * c_rest[b][alive] * (1 + 1e-9)
                if len(alive) > k_rows and s + DIM_BLOCK < columns.shape[0]:
                    low = sums - slack
                    kept = sums + slack >= np.partition(low, len(low) - k_rows)[len(low) - k_rows] - 0.5
                    alive, sums = alive[kept], sums[kept]
            best = _best(c_ids[alive], sums, k)
            yield int(q_ids[j]), c_ids[alive][best], sums[best]


def in_integers(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same for components so large that doubles would round."""
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    rows = whole(c)
    for i, row in zip(q_ids.tolist(), whole(q), strict=True):
        others = np.flatnonzero(c_ids != i)
        scores = np.array([min(max(int(s), -LIMIT), LIMIT - 1) for s in rows[others] @ row] if len(others) else [], np.int64)
        # -LIMIT has no negative in a long: ranked by the complement, which falls as the score rises.
        order = np.lexsort((c_ids[others], ~scores))
        order = order[np.sort(np.unique(c_ids[others][order], return_index=True)[1])][:k]
        yield i, c_ids[others][order], scores[order]


def _pair_of_blocks(k: int, scale: float):
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        vectors = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return table.column("id").to_numpy(), np.floor(scale * vectors).reshape(len(table), len(vectors) // len(table))

    def run(queries: pa.Table, cands: pa.Table) -> pa.Table:
        if not len(queries) or not len(cands):
            return kinds.empty_table()
        (q_ids, q), (c_ids, c) = rows(queries), rows(cands)
        most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
        found = list((branch_and_bound if most < 2**52 else in_integers)(q_ids, q, c_ids, c, k))
        columns = np.repeat([i for i, _, _ in found], [len(ids) for _, ids, _ in found]).astype(np.int64), np.concatenate([ids for _, ids, _ in found]), np.concatenate([s.astype(np.int64) for _, _, s in found])
        return pa.Table.from_arrays([pa.array(x) for x in columns], schema=kinds)

    return run


def exact_topk(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, query_block: int | None = None, cand_block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is a query, the k other rows of largest integer inner product."""
    rows = df.where(F.col(id_col).isNotNull() & finite_vector(F.col(vec_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{vector_kind(df, vec_col)}>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.withColumns({"dim": F.size("vec"), "h": F.xxhash64("id", "vec")})
    seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0)).alias("q"), F.coalesce(F.max("dim"), F.lit(1)).alias("dim")).first()
    rows_of = lambda size: max(1, size // (8 * max(1, seen["dim"])))
    n_q = max(1, math.ceil(seen["q"] / (query_block or rows_of(QUERY_BYTES))))
    n_c = max(1, math.ceil(seen["n"] / (cand_block or rows_of(CAND_BYTES))), min(shuffle_partitions(df.sparkSession), math.ceil(seen["n"] / 512)))
    dealt = lambda n: F.pmod("h", F.lit(n)).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    once = rows.groupBy("dim", "h", "id").agg(F.any_value("vec").alias("vec"), F.max("asks").alias("asks"))
    queries = once.where("asks").select("dim", "id", "vec", dealt(n_q).alias("qb")).withColumn("cb", to_all(n_c))
    cands = once.select("dim", "id", "vec", dealt(n_c).alias("cb")).withColumn("qb", to_all(n_q))
    keys = ["dim", "qb", "cb"]
    near = queries.groupBy(*keys).cogroup(cands.groupBy(*keys)).applyInArrow(_pair_of_blocks(k, scale), RESULT)
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
