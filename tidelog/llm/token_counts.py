"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to per-document frequencies.

In each batch of a partition the texts become (document, chunk, frequency) rows; each distinct chunk is resolved into pre-tokens, each
distinct pre-token is counted once by the vocabulary's library (counts stay in a bounded memo from batch to batch), and a document's
total is the sum of frequency times count. Rows keep their partition: nothing is shuffled, and a retried task needs only its input split.

Defined results: a null or empty text has 0 bytes and 0 tokens. Repeated rows are counted each. Null ids and columns of any
other name pass through. Special tokens inside a text count as one piece, as the library's default has it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import Memo, PreTokens, slices, spread, texts_of


class PieceCounts:
    """Pieces by pre-token."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.cut = PreTokens(vocabulary)
        self.model = Tokenizer.from_file(vocabulary)
        self.model.no_truncation(), self.model.no_padding()
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.chunks, self.pieces = Memo(), Memo()

    def _of_pre_tokens(self, pre_tokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch_fast(pre_tokens, add_special_tokens=False)]

    def _of_chunks(self, chunks: list[str]) -> list[int]:
        split = [self.cut.split(c) for c in chunks]
        self.pieces.add(list({p for ps in split for p in ps}), self._of_pre_tokens)
        return [sum([self.pieces[p] for p in ps]) for ps in split]

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        ends, codes, chunks = self.cut.chunks(texts)
        self.chunks.add(chunks, self._of_chunks)
        per_chunk = np.fromiter(map(self.chunks.__getitem__, chunks), np.int64, len(chunks))
        n = max(1, len(chunks))
        rows, frequency = np.unique(spread(ends) * n + codes, return_counts=True)  # (document, chunk) and its frequency
        return np.bincount(rows // n, weights=frequency * per_chunk[rows % n], minlength=len(texts)).astype(np.int64)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounts(vocabulary)
        for batch in slices(batches):
            texts = texts_of(batch.column("text"))
            tokens = counter.of_texts(texts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens), pa.array(tokens > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
