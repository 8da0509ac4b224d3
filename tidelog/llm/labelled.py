"""Folds and bounded training samples of labelled rows, and words of whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pretokens import strings
from .shared import crc32_text

#: At most so many labelled rows of a class, and so many bytes of their texts, are used to fit a model.
SAMPLE, SAMPLE_BYTES = 4096, 48 << 20
LONG = 64


def held_out(id_column: Column, folds: int, fold: int) -> Column:
    """True for the rows whose labels must not be learnt: crc32 of the id's text modulo the folds. A null id is not held out."""
    return F.coalesce(F.pmod(crc32_text(id_column), F.lit(folds)) == fold, F.lit(False))


def usable_labels(labels: DataFrame, label: str, folds: int, fold: int, id_col: str = "doc_id") -> DataFrame:
    """id, label (0 or 1) of the ids that are not held out; an id with both labels counts as 1."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(id_col), folds, fold))
    return usable.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[pa.Table, dict[int, int]]:
    """(text, label) of the sampled rows, and the count of each class among all labelled rows that are not held out.

    The sample is one row of each of the ids with the smallest hashes, class by class, as far as the row and byte bounds go: a row that does not fit is passed over, and the next ones go on. Rows of
    more than a ``LONG``-th of a class's bytes come after all others, so a few long texts do not take the place of many; a text of more than all of a class's bytes is not fitted on. Labels other
    than 0 and 1 and rows without an id are left out; an id with both labels counts as 1, an id with several texts counts with the shortest (of equal ones, the least hash). All but the last step
    handles ids and sizes only. An error is raised when a class has texts and none of them fits.
    """
    known = usable_labels(labels, label, folds, fold, id_col)
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = known.where("label = 0").orderBy(F.xxhash64("id")).limit(sample).unionAll(known.where("label = 1").orderBy(F.xxhash64("id")).limit(sample))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sized = rows.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min(F.struct(F.octet_length("text").alias("size"), F.xxhash64("text").alias("tag"))).alias("row"))  # 2 * sample ids
    listed = sized.select("id", "label", "row.size", "row.tag", F.xxhash64("id").alias("order")).collect()
    left, within = {0: sample_bytes // 2, 1: sample_bytes // 2}, []
    for r in sorted(listed, key=lambda r: (r["size"] * LONG > sample_bytes // 2, r["order"])):
        if r["size"] <= left[r["label"]]:
            left[r["label"]] -= r["size"]
            within.append((r["id"], r["label"], r["tag"], r["order"]))
    for k in {r["label"] for r in listed} - {label for _, label, *_ in within}:
        raise ValueError(f"no text of class {k} of {label} fits in {sample_bytes // 2} bytes: nothing can be fitted on")
    kept = docs.sparkSession.createDataFrame(within, "id long, label int, tag long, order long")
    texts = rows.withColumn("tag", F.xxhash64("text")).join(F.broadcast(kept), ["id", "tag"]).groupBy("id", "label", "order").agg(F.max("text").alias("text"))
    return texts.orderBy("order", "id").select("text", "label").toArrow(), counts


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The number of the text of each word, each word's code, and by code the word; split at white space, in lower case."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    coded = lists.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy().astype(np.int64), strings(coded.dictionary)
    offsets = lists.offsets.to_numpy()
    of_text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    full = np.array([bool(w) for w in distinct], bool)  # white space at an end gives an empty word
    if not full.all():
        keep = full[codes]
        of_text, codes = of_text[keep], codes[keep]
    return of_text, codes, distinct
