"""Links of texts by the Jaccard similarity of their n-gram sets: a grouped prefix join.

A text is the set of its shingles of words, as 64-bit hashes. Equal sets are one node. The shingles of a set are ordered by how many documents have them (rare ones first; the counts are those of
2**``BUCKET_BITS`` buckets of hashes, so the order is one for all sets, whatever shares a bucket), and two sets that are similar enough share one of their first few: the prefix. Nodes of one size and one prefix are a group.

1. Groups that share a token of the prefix: each with the least of the token's groups, and each member of a group with the group's first node. What is verified joins nodes into components. A large set of near copies is
   mostly one component after that, at a cost of one row per (token, group).
2. Of tokens whose groups lie in more than one component, and of groups whose members do, all pairs of different components: group pairs are filtered by size and by the places of the token (at the first common
   one, what follows must suffice), then expand into their members. So no link between different components is missed.

Before sets are fetched, pairs are filtered by the parity of their shingles in 512 bits: it differs in no more bits than the sets differ in shingles, hence no similar pair is lost. What is left is decided
by the sets themselves.

Defined results: null or empty texts, and texts without words, have an empty set and are linked with nothing. Fewer words than a shingle has are one shingle. Repeated rows are returned each. A null id is no component's name unless
the component has no other: then its component_id is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .pretokens import slices, texts_of
from .shared import Scratch
from .simhash import LOWER, SEED

#: Buckets in which the documents of shingles are counted, and rows that they are sent in.
BUCKET_BITS, SLOTS = 20, 64
#: Bits of the parities of a set.
SKETCH = 512
#: Bytes of a text whose words are split at once.
PIECE = 1 << 20
_random = np.random.default_rng(SEED)
MULTIPLIER, FINISH, SHORT = (np.uint64(int(x) | 1) for x in _random.integers(1 << 62, 1 << 63, 3, np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text in UTF-8, A-Z lower-cased; words are split piece by piece."""
    text, at, out = text.translate(LOWER), 0, []
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end : end + 1].isspace():  # the white space of bytes is x20 and x09-x0D
            end += 1
        out.append(np.fromiter(map(xxhash.xxh64_intdigest, text[at:end].split()), np.uint64))
        at = end
    return np.concatenate(out) if out else np.array([], np.uint64)


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of n words."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(n, len(words))
    mixed = np.full(len(words) - width + 1, SHORT ^ np.uint64(width) if width < n else np.uint64(0))
    for k in range(width):
        mixed = mixed * MULTIPLIER + words[k : len(words) - width + 1 + k]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * FINISH
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def needed(a, b, num: int, den: int):
    """The least common shingles of similar sets of these sizes."""
    return (num * (a + b) + num + den - 1) // (num + den)


def prefix_length(size: int, num: int, den: int) -> int:
    return size - -(-num * size // den) + 1


def parities(hashes: np.ndarray) -> np.ndarray:
    """The parity of the set's shingles in each of 512 bits, as 8 signed longs."""
    return np.packbits((np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).view("<i8")


def _document_counts(docs: DataFrame, n: int) -> np.ndarray:
    """By bucket, the logarithm (in quarters of powers of two) of the number of shingles that documents have in it. At most 1 MB reaches the driver."""
    width = (1 << BUCKET_BITS) // SLOTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in slices(batches):
            found = [shingles(t, n) >> np.uint64(64 - BUCKET_BITS) for t in texts_of(batch.column("text")).cast(pa.large_binary()).to_pylist()]
            counts += np.bincount(np.concatenate(found).astype(np.int64), minlength=len(counts)) if found else 0
        parts = counts.reshape(SLOTS, width)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[s].astype("<i8").tobytes() for s in some], pa.binary())], ["slot", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, counts in zip(batch.column("slot").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[slot] = sums.get(slot, 0) + np.frombuffer(counts, "<i8")
        levels = [np.minimum(255, np.round(4 * np.log2(s + 1))).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["slot", "levels"])

    summed = docs.select("text").mapInArrow(count, "slot int, counts binary").repartition(SLOTS, "slot").mapInArrow(add, "slot int, levels binary")
    levels = np.zeros((SLOTS, width), np.uint8)
    for row in summed.collect():
        levels[row["slot"]] = np.frombuffer(row["levels"], np.uint8)
    return levels.ravel()


def _sets(docs: DataFrame, levels: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    """uid, id, tag, n, name (128 bits of the set), place (128 bits of size and prefix), prefix (its first shingles in order) and sketch of each row."""
    kinds = [pa.int64(), None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["uid", "id", "tag", "n", "name_hi", "name_lo", "place_hi", "place_lo", "prefix", "sketch"]

    def halves(data: bytes) -> np.ndarray:
        return np.frombuffer(xxhash.xxh3_128_digest(data, SEED), "<i8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for batch in slices(batches):
            sizes, marks, prefixes, sketches = [], [], [], []
            for text in texts_of(batch.column("text")).cast(pa.large_binary()).to_pylist():
                hashes = shingles(text, n)
                order = np.argsort(levels[(hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], kind="stable")
                prefix = hashes[order[: prefix_length(len(hashes), num, den)]] if len(hashes) else hashes
                sizes.append(len(hashes))
                marks.append(np.concatenate([halves(hashes.tobytes()), halves(len(hashes).to_bytes(8, "little") + prefix.tobytes())]))
                prefixes.append(prefix.view(np.int64))
                sketches.append(parities(hashes))
            marks = np.array(marks, np.int64).reshape(-1, 4)
            ends = np.cumsum([0, *map(len, prefixes)])
            columns = [np.arange(at, at + len(sizes)), batch.column("id"), batch.column("tag"), sizes, *marks.T]
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*prefixes, np.array([], np.int64)]))))
            arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * (SKETCH // 64), pa.int32()), pa.array(np.concatenate([*sketches, np.array([], np.int64)]))))
            at += len(sizes)
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"uid long, id {kind}, tag long, n long, name_hi long, name_lo long, place_hi long, place_lo long, prefix array<long>, sketch array<long>")


def _needed(a: str, b: str, num: int, den: int) -> Column:
    """``needed`` as a column."""
    return F.floor((F.lit(num) * (F.col(a) + F.col(b)) + F.lit(num + den - 1)) / F.lit(num + den))


def _may_be_similar(p: str, q: str, num: int, den: int) -> Column:
    """What similar sets fulfil, from their sizes and parities."""
    n, m = f"{p}n", f"{q}n"
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"{p}sketch")[i].bitwiseXOR(F.col(f"{q}sketch")[i])) for i in range(SKETCH // 64)])
    sizes = F.least(n, m) * den >= F.greatest(n, m) * num
    return sizes & (apart <= F.col(n) + F.col(m) - 2 * _needed(n, m, num, den))


class _Join:
    """The steps of one join."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int, scratch: Scratch):
        self.docs, self.n, self.num, self.den, self.scratch = docs, n, num, den, scratch

    def similar(self, pairs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        """a, b: those of the pairs of nodes that are similar. pairs: a, b, once each."""
        one, other = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch")) for c in ("a", "b"))
        near = pairs.join(one, "a").join(other, "b").where(_may_be_similar("a_", "b_", self.num, self.den)).select("a", "b")
        return self.decided(self.scratch.save(near, f"{name}-near"), nodes, name)

    def decided(self, near: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        """a, b: those whose sets are similar. The sets are those of the texts, taken anew."""
        width, num, den = self.n, self.num, self.den
        wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = nodes.join(wanted, "node", "left_semi").select("node", F.col("id").alias("_id"), F.col("tag").alias("_tag"))
        texts = self.docs.join(wanted, self.docs["id"].eqNullSafe(wanted["_id"]) & (self.docs["tag"] == wanted["_tag"])).select("node", "text")

        def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found = [shingles(t, width).view(np.int64) for t in texts_of(batch.column("text")).cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "hashes"])

        sets = self.scratch.save(texts.mapInArrow(of_texts, "node long, hashes array<long>").dropDuplicates(["node"]), f"{name}-sets")

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (batch.column(c) for c in ("x", "y"))
                kept = []
                for i in range(batch.num_rows):
                    p, q = (c[i].values.to_numpy() for c in (x, y))
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    kept.append(den * common >= num * (len(p) + len(q) - common))
                yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

        one, other = (sets.select(F.col("node").alias(c), F.col("hashes").alias(h)) for c, h in (("a", "x"), ("b", "y")))
        links = self.scratch.save(near.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(decide, "a long, b long"), f"{name}-links")
        self.scratch.drop(f"{name}-near", f"{name}-sets")
        return links


def ngram_components(docs: DataFrame, shingle: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links; the own one without any): one row per row of docs. Sets link at a Jaccard similarity of ``percent`` hundredths or more."""
    num, den = percent, 100
    scratch = Scratch(docs.sparkSession, "ngram-join")
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tagged = plain.withColumn("tag", F.xxhash64("text"))
    join = _Join(tagged, shingle, num, den, scratch)
    rows = scratch.save(_sets(tagged, _document_counts(plain, shingle), shingle, num, den), "rows")
    name, place = ["name_hi", "name_lo"], ["place_hi", "place_lo"]
    distinct = scratch.save(rows.where("n > 0").groupBy(*name).agg(F.min("uid").alias("node"), F.min("id").alias("first")), "distinct")
    firsts = rows.join(distinct.select(F.col("node").alias("uid")), "uid", "left_semi").withColumnRenamed("uid", "node")
    groups = scratch.save(firsts.groupBy(*place).agg(F.min("node").alias("grp"), F.count("*").alias("members")), "groups")
    nodes = scratch.save(firsts.join(groups, place).select("node", "grp", "members", "id", "tag", "n", "sketch"), "nodes")

    # Tokens of prefixes that several groups have.
    prefixes = rows.join(groups.select(F.col("grp").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("grp"), "n", "prefix")
    tokens = prefixes.select("grp", "n", F.posexplode("prefix").alias("pos", "token"))
    ends = tokens.groupBy("token").agg(F.min("grp").alias("least"), F.max("grp").alias("most")).where("least != most").drop("most")
    shared = scratch.save(tokens.join(ends, "token"), "shared")

    # Each group with the least one of a token, each member with its group's first node.
    stars = shared.where("grp != least").select(F.col("grp").alias("a"), F.col("least").alias("b")).distinct()
    inside = nodes.where("node != grp").select(F.col("node").alias("a"), F.col("grp").alias("b"))
    links = join.similar(stars.unionByName(inside), nodes, "first")
    roots = connected_components(links, scratch, "first")
    placed = scratch.save(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")

    # What these leave apart: pairs of groups, then of members.
    spans = scratch.save(placed.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high")), "spans")
    met = scratch.save(shared.join(spans, "grp").select("token", "pos", "grp", "n", "low", "high"), "met")
    scratch.drop("shared")
    apart = met.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l != h").select("token")
    left = scratch.save(met.join(apart, "token", "left_semi"), "left")
    x, y = (left.select("token", *(F.col(c).alias(f"{side}_{c}") for c in ("pos", "grp", "n", "low", "high"))) for side in ("x", "y"))
    rest = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))
    ordered = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_grp") < F.col("y_grp")))
    fits = (F.col("x_n") * den >= F.col("y_n") * num) & (rest >= _needed("x_n", "y_n", num, den))
    one_component = (F.col("x_low") == F.col("x_high")) & (F.col("y_low") == F.col("y_high")) & (F.col("x_low") == F.col("y_low"))
    t = [c for c in y.columns if c != "token"]
    pairs = x.join(y.select(F.col("token").alias("of"), *t), (F.col("token") == F.col("of")) & ordered & fits & ~one_component).select("x_grp", "y_grp").distinct()
    pairs = scratch.save(pairs, "group-pairs")
    member = lambda side: placed.select(*(F.col(c).alias(f"{side}_{c}") for c in ("node", "grp", "n", "sketch", "root")))
    p, q = member("p"), member("q")
    different = (F.col("p_root") != F.col("q_root")) & _may_be_similar("p_", "q_", num, den)
    across = pairs.join(p, F.col("x_grp") == F.col("p_grp")).join(q, (F.col("y_grp") == F.col("q_grp")) & different)
    mixed = scratch.save(placed.join(spans.where("low != high"), "grp", "left_semi"), "mixed")
    of_mixed = lambda side: mixed.select(*(F.col(c).alias(f"{side}_{c}") for c in ("node", "grp", "n", "sketch", "root")))
    within = of_mixed("p").join(of_mixed("q"), (F.col("p_grp") == F.col("q_grp")) & (F.col("p_root") < F.col("q_root")) & _may_be_similar("p_", "q_", num, den))
    near = across.select(F.col("p_node").alias("a"), F.col("q_node").alias("b")).unionByName(within.select(F.col("p_node").alias("a"), F.col("q_node").alias("b")))
    more = join.decided(scratch.save(near, "second-near"), nodes, "second")
    scratch.drop("met", "left", "spans", "mixed", "placed", "group-pairs")

    # Names of the components, and every row's.
    roots = connected_components(links.unionByName(more), scratch, "second")
    linked = scratch.save(roots.join(distinct, "node").select("node", "root", "first"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    of_node = linked.join(least, "root").select("node", "least")
    of_name = scratch.save(distinct.join(of_node, "node", "left").select(*name, F.coalesce("least", "first").alias("component_id")), "of-name")
    scratch.drop("linked", "distinct", "groups", "nodes")
    named = rows.where("n > 0").join(of_name, name).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return named.unionByName(rows.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
