"""Near copies by the Jaccard similarity of their shingle sets: SimHash by covering tables proposes, then MinHash bands between what is left apart; the exact similarity decides.

First, as in the SimHash operator, fingerprints within two bits are linked by covering tables, without a miss; of equal fingerprints, each set is compared with the least one, and these along the links. The 64 bits of a SimHash are too few for the rest: of pairs at a
similarity of 0.8, half differ in more than nine bits, and covering masks for that radius would be a thousand tables. So pairs that this leaves in different components go by longer sketches.

A text is the set of its shingles of five words (fewer words: one shingle of them all). Equal sets are one row, so a group of exact copies of any size costs one. A set has ``BANDS`` keys of
``ROWS`` minimal hashes each; sets that share a key are compared exactly. A pair at the threshold 0.8 shares none of the keys with probability (1 - 0.8^5)^40 = 1.3e-7, and a more similar pair with
less; that is the only way to miss one, but for pairs whose sketches differ in far more bits than the threshold lets expect (``SURE`` standard deviations, less than 1e-9).

Of a key's sets, all that SimHash left in another component are compared with the least one first. Those that this leaves in different components are then compared with one another in a join on the key that carries no sets: its condition are
the sizes, a sketch of one bit for each minimal hash, and the parities of the shingles in 512 bits, which differ in no more bits than the sets do in shingles. What these leave are pairs, once each, for
which the sets are joined and decide.

Defined results: as for first_of_groups in simhash. Texts without words are copies of one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .ngram_join import SKETCH, parities
from .pretokens import slices, texts_of
from .shared import Scratch
from .simhash import LOWER, SEED, fingerprints_of_hashes, first_of_components, links_within_two

#: Bands and minimal hashes in each; standard deviations beyond which a sketch counts as none of a similar set.
BANDS, ROWS, SURE = 40, 5, 6.5
_random = np.random.default_rng(SEED)
#: Odd factors and summands of the hash functions, of which the upper bits count.
FACTORS, SUMMANDS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * 2 + 1, _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text in UTF-8."""
    words = text.translate(LOWER).split()
    of = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)] if words else []
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, of, repeat(SEED)), np.uint64))


def name_of(hashes: np.ndarray) -> int:
    """A set's own 64 bits, as a signed long."""
    return int(np.array(xxhash.xxh64_intdigest(hashes.tobytes(), SEED), np.uint64).view(np.int64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The minimal hashes of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 4096):
        part = hashes[None, at : at + 4096]
        mixed = (part ^ (part >> np.uint64(32))) * FACTORS[:, None] + SUMMANDS[:, None]
        least = np.minimum(least, mixed.min(1))
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """The keys of the bands, as signed longs."""
    return [xxhash.xxh64_intdigest(row.tobytes(), band) - (1 << 63) for band, row in enumerate(least.reshape(BANDS, ROWS))]


def sketch(least: np.ndarray) -> list[int]:
    """One bit of each minimal hash, as signed longs."""
    bits = np.packbits((least >> np.uint64(20) & np.uint64(1)).astype(np.uint8))
    return np.append(bits, np.zeros(-len(bits) % 8, np.uint8)).view("<i8").tolist()


def _of_texts(docs: DataFrame, columns: list[str], work) -> DataFrame:
    """row, node and the arrays that work makes of each text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *(pa.list_(pa.int64()) for _ in columns)]
        for batch in slices(batches):
            made = [work(t) for t in texts_of(batch.column("text")).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array([m[c] for m in made], kind) for c, kind in enumerate(kinds))], ["row", "node", *columns])

    return docs.mapInArrow(run, f"row {docs.schema['row'].dataType.simpleString()}, node long" + "".join(f", {c} array<long>" for c in columns))


def _similar(one: str, other: str, threshold: float) -> Column:
    """Whether two sets have at least that Jaccard similarity."""
    common, both = F.size(F.array_intersect(one, other)), F.size(one) + F.size(other)
    return common >= threshold * (both - common) - 1e-9


def _maybe_similar(p: str, q: str, threshold: float) -> Column:
    """What similar sets fulfil, from their sizes, sketches and parities."""
    bits, share = BANDS * ROWS, (1 - threshold) / 2
    most = bits * share + SURE * (bits * share * (1 - share)) ** 0.5
    n, m = F.col(f"{p}.n"), F.col(f"{q}.n")

    def apart(column: str, words: int) -> Column:
        return reduce(Column.__add__, [F.bit_count(F.col(f"{p}.{column}")[i].bitwiseXOR(F.col(f"{q}.{column}")[i])) for i in range(words)])

    sizes = F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9
    odd = apart("parity", SKETCH // 64) <= (n + m) * ((1 - threshold) / (1 + threshold)) + 1e-6  # shingles that only one of two similar sets has
    return sizes & (apart("sketch", -(-bits // 64)) <= int(most)) & odd


def _decided(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b: those of the pairs whose sets are similar."""
    one, other = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"_{c}")) for c in ("a", "b"))
    return pairs.join(one, "a").join(other, "b").where(_similar("_a", "_b", threshold)).select("a", "b")


def _near_fingerprints(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: nodes to compare, for all fingerprints (fp) within two bits: each node with the least one of its fingerprint, and these with one another along links."""
    heads = scratch.save(distinct.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    same = distinct.join(heads, "fp").where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    one, other = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"_{c}")) for c in ("a", "b"))
    across = links_within_two(heads.select("fp")).join(one, "a").join(other, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return same.unionByName(across).distinct()


def first_of_near_copies(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stand first in their component of near copies: of smallest id, null last; of equal ids one row stays."""
    scratch = Scratch(docs.sparkSession, "near-copies")
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), tag.alias("tag")).alias("row"), F.col(text_col).alias("text"))

    def keyed(text: bytes) -> tuple[int, list[int], list[int]]:
        hashes = shingle_set(text, shingle)
        return name_of(hashes), fingerprints_of_hashes([hashes]).view(np.int64).tolist(), band_keys(minima(hashes)) if len(hashes) else []

    def whole(text: bytes) -> tuple[int, list[int], list[int], list[int]]:
        hashes = shingle_set(text, shingle)
        return name_of(hashes), hashes.view(np.int64).tolist(), sketch(minima(hashes)), parities(hashes).tolist()

    named = scratch.save(_of_texts(rows, ["fp", "keys"], keyed), "named")
    distinct = scratch.save(named.groupBy("node").agg(F.min("row").alias("first"), F.min(F.col("fp")[0]).alias("fp")), "distinct")
    proposed = scratch.save(_near_fingerprints(distinct, scratch), "proposed")
    keys = named.select("node", F.posexplode("keys").alias("band", "key"))
    ends = keys.groupBy("band", "key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least != most").drop("most")
    shared = scratch.save(keys.join(ends, ["band", "key"]).select("band", "key", "least", "node").distinct(), "shared")
    scratch.drop("named")
    close = distinct.join(shared.select("node").unionAll(proposed.select(F.explode(F.array("a", "b")))).distinct(), "node", "left_semi").select(F.col("first").alias("row"))
    of_close = rows.join(close, (rows["row"]["tag"] == close["row"]["tag"]) & rows["row"]["id"].eqNullSafe(close["row"]["id"]), "left_semi").dropDuplicates(["row"])
    sets = scratch.save(_of_texts(of_close, ["hashes", "sketch", "parity"], whole).select("node", F.size("hashes").alias("n"), "hashes", "sketch", "parity"), "sets")
    within = scratch.save(_decided(proposed, sets, threshold), "within")
    ends = scratch.save(connected_components(within, scratch, "near"), "ends")
    of_node, of_least = ends.withColumnRenamed("root", "p"), ends.select(F.col("node").alias("least"), F.col("root").alias("q"))
    stars = shared.where("node != least").select("node", "least").distinct().join(of_node, "node", "left").join(of_least, "least", "left")
    pairs = scratch.save(stars.where(F.coalesce("p", "node") != F.coalesce("q", "least")).select(F.col("node").alias("a"), F.col("least").alias("b")), "pairs")
    links = scratch.save(within.unionByName(_decided(pairs, sets, threshold)), "links")
    scratch.drop("heads", "proposed", "within", "ends")
    roots = connected_components(links, scratch, "first")
    placed = scratch.save(shared.join(roots, "node", "left").select("band", "key", "node", F.coalesce("root", "node").alias("root")), "placed")
    scratch.drop("shared", "pairs")
    apart = placed.groupBy("band", "key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("band", "key")
    members = scratch.save(placed.join(apart, ["band", "key"], "left_semi").join(sets.drop("hashes"), "node"), "members")
    scratch.drop("placed")
    p, q = members.alias("p"), members.alias("q")
    met = (F.col("p.band") == F.col("q.band")) & (F.col("p.key") == F.col("q.key")) & (F.col("p.root") < F.col("q.root"))
    near = scratch.save(p.join(q, met & _maybe_similar("p", "q", threshold)).select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct(), "near")
    more = scratch.save(_decided(near, sets, threshold), "more")
    scratch.drop("members", "near", "sets")
    return first_of_components(docs, distinct.drop("fp"), connected_components(links.unionByName(more), scratch), tag, scratch, id_col)
