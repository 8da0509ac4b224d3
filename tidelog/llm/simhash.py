"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint belongs to class m(i), one of the 7 nonzero vectors of GF(2)^3. Table v keeps the bits whose class has an odd
product with v. Two differing bits span at most a plane, and some v is orthogonal to it, so any two fingerprints within 2 bits
agree on all bits that table v keeps: no pair is missed, by construction. Fingerprints that share a bucket with another are then verified exactly
without comparing pairs: each is sent to every word within 1 bit of it, among the bits that its table left out, and two fingerprints differ
in at most 2 bits just when they meet at such a word. At most 65 distinct fingerprints meet at one word. Links join into connected
components.

Everything after the fingerprints works on distinct fingerprints, so a group of copies of any size is one row there. Only the last join, which names the component of each row, meets a fingerprint that very many rows
share; it is between two written tables, which Spark splits by skew.

Defined results: a null text is an empty one; texts without words have fingerprint zero, which links like any other. Repeated rows are
returned each. A null id is no component's name unless the component has no other: then its component_id is null. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .pretokens import slices, texts_of
from .shared import Scratch

BITS, SEED = 64, 42
#: A-Z to a-z, and the sums of a byte's bits in lanes of 8 bits.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LANES = np.array([sum(1 << (8 * k) for k in range(8) if b >> k & 1) for b in range(256)], np.uint64)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: The class of each bit, and by table the bits that it keeps and those that it leaves out.
CLASS = [i % 7 + 1 for i in range(BITS)]
KEEPS = [sum(1 << i for i in range(BITS) if (CLASS[i] & v).bit_count() % 2) for v in range(1, 8)]
LEAVES = [[1 << i for i in range(BITS) if not k >> i & 1] for k in KEEPS]


def fingerprints(texts: list[bytes], shingle: int) -> np.ndarray:
    """64-bit fingerprints of texts in UTF-8."""
    join, digest = b" ".join, xxhash.xxh64_intdigest
    hashes = []
    for text in texts:
        words = text.translate(LOWER).split()  # at the white space x20 and x09-x0D
        of = list(map(join, zip(*(words[i:] for i in range(shingle)), strict=False))) if len(words) >= shingle else [join(words)] if words else []
        hashes.append(np.fromiter(map(digest, of, repeat(SEED)), np.uint64, len(of)))
    return fingerprints_of_hashes(hashes)


def fingerprints_of_hashes(hashes: list[np.ndarray]) -> np.ndarray:
    """64-bit fingerprints of texts, from the 64-bit hashes of each one's shingles."""
    counts = np.array([len(h) for h in hashes], np.int64)
    some = np.flatnonzero(counts)
    out = np.zeros(len(hashes), np.uint64)
    if len(some):
        sizes = counts[some]
        begins = np.cumsum(sizes) - sizes
        runs = np.concatenate([np.arange(b, b + n, 255) for b, n in zip(begins, sizes, strict=True)])  # a lane holds 255
        of_text = np.cumsum(-(-sizes // 255)) - -(-sizes // 255)
        raw = np.concatenate(hashes).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.concatenate([np.add.reduceat(np.add.reduceat(LANES[raw[:, k]], runs).view(np.uint8).reshape(-1, 8), of_text, axis=0, dtype=np.int64) for k in range(8)], axis=1)
        most = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little")
        out[some] = np.ascontiguousarray(most).view("<u8")[:, 0]
    return out


def fingerprint_table(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch.column("text")).cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fingerprints(texts, shingle).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def links_within_two(fps: DataFrame) -> DataFrame:
    """a, b: links of distinct fingerprints (column fp) within 2 bits that connect all such pairs."""
    tables = [F.struct(F.lit(v).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(k))).alias("key")) for v, k in enumerate(KEEPS)]
    keyed = fps.select("fp", F.explode(F.array(*tables)).alias("t")).select("fp", "t.table", "t.key")
    shared = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1").select("table", "key")
    close = keyed.join(shared, ["table", "key"]).groupBy("fp").agg(F.collect_set("table").alias("tables"))  # at most 7
    moves = F.array(*(F.array(*(F.lit(signed(bit)) for bit in bits)) for bits in LEAVES))
    flips = F.array_distinct(F.flatten(F.transform("tables", lambda t: F.get(moves, t))))
    words = close.select("fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), flips)).alias("flip")).select("fp", F.expr("fp ^ flip").alias("word"))
    met = words.groupBy("word").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # at most 65
    return met.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a != b")


def first_of_components(docs: DataFrame, distinct: DataFrame, roots: DataFrame, tag: Column, scratch: Scratch, id_col: str) -> DataFrame:
    """The rows of docs that stand first in their component. distinct: node, first (the least struct of unnamed, id, tag); roots: node, root of linked nodes."""
    linked = scratch.save(distinct.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first"), "linked")
    first = scratch.save(linked.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("first_id"), F.col("first.tag").alias("first_tag")).distinct(), "first")
    scratch.drop("linked", "distinct")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("id"), tag.alias("tag"))
    kept = rows.join(first, rows["id"].eqNullSafe(first["first_id"]) & (rows["tag"] == first["first_tag"]), "left_semi")
    return kept.dropDuplicates(["id", "tag"]).select("row.*")


def first_of_groups(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stand first in their component: of smallest id, null last; of equal ids one row stays."""
    scratch = Scratch(docs.sparkSession, "simhash")
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    fps = scratch.save(fingerprint_table(docs.select(F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), tag.alias("tag")).alias("row"), text_col), shingle, "row", text_col), "fingerprints")
    distinct = scratch.save(fps.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    scratch.drop("fingerprints")
    roots = connected_components(links_within_two(distinct.select("fp")), scratch)
    return first_of_components(docs, distinct.withColumnRenamed("fp", "node"), roots, tag, scratch, id_col)


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest id reachable): one row per row of docs."""
    scratch = Scratch(docs.sparkSession, "simhash")
    all_fps = scratch.save(fingerprint_table(docs, shingle, id_col, text_col), "fingerprints")
    distinct = scratch.save(all_fps.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = connected_components(links_within_two(distinct.select("fp")), scratch)
    linked = scratch.save(roots.join(distinct, roots["node"] == distinct["fp"]).select("fp", "root", "first"), "linked")
    least = scratch.save(linked.groupBy("root").agg(F.min("first").alias("least")), "least")
    named = scratch.save(linked.join(least, "root").select("fp", "least"), "named")
    of_fp = scratch.save(distinct.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "of_fp")
    scratch.drop("distinct", "linked", "least", "named")
    return all_fps.join(of_fp, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
