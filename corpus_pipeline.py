"""The corpus pipeline: toxicity, quality, line dedup, near-dedup and packing of all documents.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; between stages, rows are written as Parquet in the shared
folder and read again, so a lost executor costs no more than the stage it was in. What a stage leaves there goes when the next one is written.

Defined results: a null text is an empty one, and is scored and packed as such; a null id is an id that is larger than all others. Repeated rows are judged alike; of equal ids with equal texts
near_dedup keeps one. Columns beside doc_id and text pass through all stages but the last, whatever their names, except that n_chars (where there is one) follows the text when lines go; an empty table gives
empty ones. Where labelled documents of both classes are not at hand, toxicity and quality keep all documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.line_dedup import dedup_lines
from tidelog.llm.near_copies import first_of_near_copies
from tidelog.llm.packing import pack
from tidelog.llm.quality import score_quality
from tidelog.llm.shared import Scratch, table, temporary
from tidelog.llm.toxicity import score_toxicity


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all but the text in one column, so that no name clashes with an operator's."""
    return docs.select("doc_id", "text", F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("row"))


def _whole(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    scored = score_toxicity(_apart(docs), table(spark, sf_dir, "labels"), unlearnt=0.0)
    return _whole(scored.where("predicted = 0"), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted good go."""
    scored = score_quality(_apart(docs), table(spark, sf_dir, "labels"), unlearnt=1.0)
    return _whole(scored.where("predicted = 1"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of smaller id holds go; n_chars follows the text."""
    kept = dedup_lines(_apart(docs))
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
        kept = kept.withColumn("row", F.col("row").withField("n_chars", chars))
    return _whole(kept, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 at least; SimHash first, bands for what its two bits cannot reach."""
    return first_of_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: SQL cannot train the classifiers or run the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, from all rows of documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        with temporary():
            docs = scratch.save(stage(spark, docs, sf_dir), f"{n}-{name}")
        if n:
            scratch.drop(f"{n - 1}-{STAGES[n - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
