"""Ranked lexical search over a clustered index.

1. Recursive graph bisection puts documents that share terms side by side: a sample's documents are halved again and again, and swapped between the halves while that lowers the logarithmic cost of the terms' gaps. The tree of these
   halves, with each term's cost on either side, then takes every document to its leaf. A leaf's documents of about one length are a shard; if they are more than ``SHARD``, several are.
2. The index is a row for each shard: by term of the queries, the documents in the shard that hold it and its impact there. Its bound for a query is the sum of the terms' greatest impacts.
3. Each query visits shards by falling bound, a few first and then ever more of them at once, and stops when the next bound is below its k-th score. A shard whose bound equals it is visited: a
   document of a smaller id may be in it. Shards know documents by their place only; ids come back for the results, where they decide ties.

So the result is exact whatever the order of the documents; the order only decides how many shards are visited. Queries go in blocks of bounded size, whose terms each task knows.

Defined results: a null text has no terms. Each row of documents is one document; of equal ids both are ranked. Equal queries are asked once, several texts of one id each on its own. Null ids come last among ties. Other columns are ignored.
Empty tables give empty results.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pretokens import slices, texts_of
from .shared import Scratch, shuffle_partitions

#: Bytes that belong to terms stay (A-Z lower-cased), the others part them.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Documents of the sample that the bisection is fitted on, hashed terms of each, hash values of terms, and levels at most (so the tree has 16 MB at most).
SAMPLE, SAMPLE_TERMS, TERM_IDS, LEVELS = 4096, 256, 1 << 14, 9
#: Documents of a shard at most; bytes of the queries of a block; bytes of a text that are split at once; queries' bounds in a row at most.
SHARD, BLOCK_BYTES, PIECE, BLOCK_ITEMS = 256, 2 << 20, 1 << 20, 2048
LAST = 2**63 - 1


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, piece by piece."""
    text, at = text.translate(TERM_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def hashed(terms) -> np.ndarray:
    """Sorted distinct hash values of terms."""
    return np.unique(np.fromiter(map(zlib.crc32, terms), np.int64) % TERM_IDS)


def _cost(degree: np.ndarray, size: int) -> np.ndarray:
    """What a term of so many documents out of ``size`` costs in that half."""
    return degree * np.log2(max(1, size) / (degree + 1))


@dataclass
class Bisection:
    """A tree of halves: by node, the preference of each term for the first half, and the least sum of those that goes there."""

    levels: int
    prefers: np.ndarray
    least: np.ndarray

    def leaves(self, ends: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The leaf of each document. ends: of its hashed terms in ``terms``."""
        node = np.zeros(len(ends), np.int64)
        of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        for _ in range(self.levels):
            sums = np.bincount(of, self.prefers[node[of], terms], len(ends))
            node = 2 * node + 1 + (sums < self.least[node])
        return node - ((1 << self.levels) - 1)


def fit_bisection(docs: list[np.ndarray], levels: int, rounds: int = 10) -> Bisection:
    """docs: hashed terms of sampled documents."""
    nodes = (1 << levels) - 1
    prefers, least = np.zeros((max(1, nodes), TERM_IDS), np.float16), np.zeros(max(1, nodes))
    parts = {0: np.arange(len(docs))}
    for node in range(nodes):
        own = parts.pop(node)
        ends = np.cumsum([len(docs[d]) for d in own]).astype(np.int64)
        terms = np.concatenate([docs[d] for d in own]) if len(own) else np.array([], np.int64)
        of = np.repeat(np.arange(len(own)), np.diff(ends, prepend=0))
        first = np.arange(len(own)) < len(own) // 2
        sum_of = lambda values: np.bincount(of, values[terms], len(own))
        for _ in range(rounds):
            left, right = np.bincount(terms[first[of]], minlength=TERM_IDS), np.bincount(terms[~first[of]], minlength=TERM_IDS)
            n, m = int(first.sum()), int((~first).sum())
            now = _cost(left, n) + _cost(right, m)
            gains = np.where(first, sum_of(now - _cost(np.maximum(left - 1, 0), n) - _cost(right + 1, m)), sum_of(now - _cost(left + 1, n) - _cost(np.maximum(right - 1, 0), m)))
            one, other = (np.flatnonzero(side)[np.argsort(-gains[side], kind="stable")] for side in (first, ~first))
            pairs = min(len(one), len(other))
            better = int((gains[one[:pairs]] + gains[other[:pairs]] > 1e-9).sum())
            if not better:
                break
            first[one[:better]], first[other[:better]] = False, True
        left, right = np.bincount(terms[first[of]], minlength=TERM_IDS), np.bincount(terms[~first[of]], minlength=TERM_IDS)
        n, m = int(first.sum()), int((~first).sum())
        prefers[node] = (_cost(right + 1, m) - _cost(right, m)) - (_cost(left + 1, n) - _cost(left, n))
        sums = sum_of(prefers[node].astype(np.float64))
        least[node] = np.median(sums) if len(own) else 0.0
        goes = sums >= least[node]
        parts[2 * node + 1], parts[2 * node + 2] = own[goes], own[~goes]
    return Bisection(levels, prefers, least)


def levels_for(rows: int, shard_docs: int) -> int:
    """So many that a leaf has about four shards (of its documents' lengths)."""
    return min(LEVELS, max(0, math.ceil(math.log2(max(1, rows) / (4 * shard_docs)))))


def _fitted(docs: DataFrame, rows: int, levels: int) -> Bisection:
    """From at most 2 * ``SAMPLE`` documents, by the hash of their texts; ``SAMPLE_TERMS`` terms of each at most."""
    if not levels:
        return Bisection(0, np.zeros((1, TERM_IDS), np.float16), np.zeros(1))
    cut = int((SAMPLE / rows) * 2**63) * 2 - 2**63 if rows > SAMPLE else LAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [hashed({t for piece in terms_of(text) for t in piece}) for text in texts_of(batch.column("text")).cast(pa.large_binary()).to_pylist()]
            # The same terms of all documents, as far as they go: those of the smallest mixed hash values.
            kept = [f[np.argsort(f * 2654435761 % TERM_IDS, kind="stable")[:SAMPLE_TERMS]] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(kept, pa.list_(pa.int64()))], ["h", "terms"])

    sampled = docs.withColumn("h", F.xxhash64("text")).where((F.col("h") <= cut) & (F.length("text") > 0)).select("h", "text")
    rows_ = sampled.mapInArrow(run, "h long, terms array<long>").dropDuplicates(["h"]).limit(2 * SAMPLE).collect()
    return fit_bisection([np.array(r["terms"], np.int64) for r in sorted(rows_, key=lambda r: r["h"])], levels)


def _scanned(docs: DataFrame, tree: Bisection, number_of: dict[bytes, int]) -> DataFrame:
    """uid, id, n (terms), leaf, and the numbers and occurrences of the queries' terms in each document that has terms."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((tree, number_of))  # bounded: see LEVELS and BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, number_of = shared.value
        at = TaskContext.get().partitionId() << 36
        for batch in slices(batches):
            sizes, leaves_of, found = [], [], []
            for text in texts_of(batch.column("text")).cast(pa.large_binary()).to_pylist():
                counts: Counter[bytes] = Counter()
                for piece in terms_of(text):
                    counts.update(piece)
                sizes.append(counts.total())
                leaves_of.append(hashed(counts) if tree.levels else np.array([], np.int64))
                found.append([(number_of[t], n) for t, n in counts.items() if t in number_of])
            ends = np.cumsum([0, *map(len, leaves_of)])
            leaf = tree.leaves(ends[1:], np.concatenate([*leaves_of, np.array([], np.int64)]))
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array([p[k] for f in found for p in f], kind)) for k, kind in ((0, pa.int32()), (1, pa.int64()))]
            rows = pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(sizes))), batch.column("id"), pa.array(sizes, pa.int64()), pa.array(leaf, pa.int32()), *lists], ["uid", "id", "n", "leaf", "terms", "times"])
            at += len(sizes)
            yield rows.filter(pa.array(np.array(sizes, np.int64) > 0))

    return docs.mapInArrow(run, "uid long, id long, n long, leaf int, terms array<int>, times array<long>")


class Queries:
    """The queries of a block: by query, its terms' numbers and weights times occurrences."""

    def __init__(self, texts: list[str | None]):
        self.counts: list[Counter[bytes]] = []
        for text in texts:
            counts: Counter[bytes] = Counter()
            for piece in terms_of((text or "").encode()):
                counts.update(piece)
            self.counts.append(counts)
        self.number_of = {t: n for n, t in enumerate(dict.fromkeys(t for c in self.counts for t in c))}

    def weigh(self, documents: int, held_by: dict[int, int]) -> None:
        weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * held_by.get(n, 0) + 1))) for t, n in self.number_of.items()}
        self.terms = [np.array([self.number_of[t] for t in c], np.int64) for c in self.counts]
        self.weights = [np.array([weight[t] * n for t, n in c.items()], np.int64) for c in self.counts]


def impacts(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * times // (1000 * times + 12 * m)


def _shard_rows(queries: Queries, documents: int, total: int):
    """The index row of a shard: ids by place, and by term (sorted) the places and impacts."""
    kinds = pa.schema([("shard", pa.string()), ("ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int32())), ("bounds", pa.list_(pa.int64()))])

    def run(docs: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        lists = docs.column("terms").chunk(0) if docs.column("terms").num_chunks else docs.column("terms").combine_chunks()
        terms = lists.flatten().to_numpy().astype(np.int64)
        times = docs.column("times").combine_chunks().flatten().to_numpy()
        place = np.repeat(np.arange(len(docs)), np.diff(lists.offsets.to_numpy()))
        m = 75 + 25 * docs.column("n").to_numpy() * documents // total
        impact = impacts(times, m[place])
        order = np.argsort(terms, kind="stable")
        own, starts = np.unique(terms[order], return_index=True)
        greatest = np.zeros(len(queries.number_of) + 1, np.int64)
        if len(own):
            greatest[own] = np.maximum.reduceat(impact[order], starts)
        bounds = [int((w * greatest[t]).sum()) for t, w in zip(queries.terms, queries.weights, strict=True)]
        columns = [docs.column("id").to_pylist(), own, np.append(starts, len(terms)), place[order], impact[order], bounds]
        return pa.Table.from_arrays([docs.column("shard").slice(0, 1), *(pa.array([c], kinds.field(k + 1).type) for k, c in enumerate(columns))], schema=kinds)

    return run


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties by id."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))


def _visited(queries: Queries, k: int):
    """Scores the documents of visited shards; of each query, a task keeps the k best only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                ids, terms, starts, places, impact, asked, least = (batch.column(c)[r].values for c in ("ids", "terms", "starts", "places", "impacts", "items", "least"))
                unnamed = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(LAST).to_numpy()
                starts, places, impact = starts.to_numpy(), places.to_numpy(), impact.to_numpy().astype(np.int64)
                at = {t: i for i, t in enumerate(terms.to_numpy().tolist())}
                for item, floor in zip(asked.to_pylist(), least.to_pylist(), strict=True):
                    scores = np.zeros(len(ids), np.int64)
                    for term, weight in zip(queries.terms[item].tolist(), queries.weights[item].tolist(), strict=True):
                        if (i := at.get(term)) is not None:
                            span = slice(starts[i], starts[i + 1])
                            scores[places[span]] += weight * impact[span]
                    some = np.flatnonzero(scores >= max(1, floor))
                    found = ids[some], scores[some], unnamed[some]
                    if item in best:
                        found = tuple(np.concatenate(both) for both in zip(best[item], found, strict=True))
                    top = _best(found[0], found[1], k)
                    best[item] = tuple(c[top] for c in found)
        items = np.repeat(np.array(list(best), np.int64), [len(v[0]) for v in best.values()])
        ids, scores, unnamed = (np.concatenate([v[c] for v in best.values()]) if best else np.array([], np.int64) for c in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(ids, pa.int64(), mask=unnamed.astype(bool)), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return run


def _of_block(docs: DataFrame, tree: Bisection, texts: list[str | None], k: int, scratch: Scratch, name: str, shard_docs: int, trace: list | None) -> DataFrame:
    """item (the place of the text), rank, doc_id, score."""
    spark, queries = docs.sparkSession, Queries(texts)
    rows = scratch.save(_scanned(docs, tree, queries.number_of), f"{name}-rows")
    seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held_by = {r["term"]: r["n"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # at most the block's terms
    queries.weigh(seen["n"], held_by)
    length = F.floor(2 * F.log2(F.col("n"))).cast("int")
    sizes = rows.groupBy("leaf", length.alias("length")).agg(F.ceil(F.count("*") / shard_docs).cast("int").alias("shards"))
    dealt = rows.withColumn("length", length).join(F.broadcast(sizes), ["leaf", "length"])  # at most 2**LEVELS leaves, each with 126 lengths
    shard = F.concat_ws("/", "leaf", "length", F.pmod(F.xxhash64("uid"), F.col("shards")))
    index = dealt.select(shard.alias("shard"), "id", "n", "terms", "times").groupBy("shard").applyInArrow(_shard_rows(queries, seen["n"], max(1, seen["terms"])), "shard string, ids array<long>, terms array<int>, starts array<int>, places array<int>, impacts array<int>, bounds array<long>")
    index = scratch.save(index, f"{name}-index")
    scratch.drop(f"{name}-rows")
    bounds = index.select("shard", F.posexplode("bounds").alias("item", "bound")).where("bound > 0")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "shard")
    visits = scratch.save(bounds.withColumn("place", F.row_number().over(order) - 1), f"{name}-visits")
    best = scratch.save(spark.createDataFrame([], "item int, doc_id long, score long"), f"{name}-best0")
    at, to, step = 0, 2, 0
    while True:
        kth = best.groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0).alias("least"))
        ahead = visits.where(F.col("place") >= at).join(kth, "item", "left").withColumn("least", F.coalesce("least", F.lit(0))).where("bound >= least")
        now = scratch.save(ahead.where(F.col("place") < to).groupBy("shard").agg(F.collect_list(F.struct("item", "least")).alias("asked")), f"{name}-now{step}")
        if trace is not None:
            trace.append((at, now.agg(F.coalesce(F.sum(F.size("asked")), F.lit(0))).first()[0]))
        asked = index.drop("bounds").join(now, "shard").select("ids", "terms", "starts", "places", "impacts", F.col("asked.item").alias("items"), F.col("asked.least").alias("least"))
        asked = asked.repartition(shuffle_partitions(spark))
        found = best.unionByName(asked.mapInArrow(_visited(queries, k), "item int, doc_id long, score long"))
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
        best = scratch.save(ranked.where(F.col("rank") <= k).select("item", "doc_id", "score", "rank"), f"{name}-best{step + 1}")
        scratch.drop(f"{name}-best{step}", f"{name}-now{step}")
        kth = best.groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0).alias("least"))
        if visits.where(F.col("place") >= to).join(kth, "item", "left").where("bound >= coalesce(least, 0)").isEmpty():
            break
        best, at, to, step = best.drop("rank"), to, to * 8, step + 1
    scratch.drop(f"{name}-index", f"{name}-visits")
    return best


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard_docs: int = SHARD, block_bytes: int = BLOCK_BYTES, trace: list | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each item. trace: gets the number of (query, shard) visits of each step."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    asked = scratch.save(items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).distinct(), "items")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, math.ceil(size["bytes"] / block_bytes), math.ceil(size["n"] / BLOCK_ITEMS))
    rows = plain.count()
    tree = _fitted(plain, rows, levels_for(rows, shard_docs))
    found = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about BLOCK_BYTES
        best = _of_block(plain, tree, [r["text"] for r in own], k, scratch, f"block{block}", shard_docs, trace)
        names = spark.createDataFrame([(n, r["item_id"]) for n, r in enumerate(own)], f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
        of_block = best.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        found = of_block if found is None else found.unionByName(of_block)
    return found
