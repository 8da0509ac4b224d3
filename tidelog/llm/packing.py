"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document's ids, with the end id, are cut at multiples of the capacity; full pieces are sequences of their own. What is left is cut
into parts of at most ``part`` ids, and the parts of a group of documents are dealt to windows: every part starts as a partial
partition; the two partitions of largest imbalance are merged, the fullest windows of one onto the emptiest of the other, until one is left. The window count
starts at the least possible and rises whenever the fullest window exceeds the capacity.

A group is a run of consecutive documents of a partition, about ``group_tokens`` ids or ``group_docs`` documents, whatever comes first, so memory is bounded (differencing holds one array of window sums
and one of places for each part of a document), nothing is shuffled and a retried task packs its input split in the same way. A sequence id is the partition, then a counter.

Defined results: a null or empty text is the end id alone. Repeated rows are packed each. Null ids and other columns do no harm;
an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import Memo, slices, strings, texts_of

CAPACITY, PART, GROUP_TOKENS, GROUP_DOCS = 2048, 512, 1 << 20, 8192


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each item, and the windows' sums, for k windows of near-equal sums."""
    n = len(sizes)
    if k == 1:
        return np.zeros(n, np.int64), np.array([sizes.sum()])
    sums = [None] * n
    queue = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(queue)
    merges: list[tuple[int, int, np.ndarray]] = []

    def vector(i: int) -> np.ndarray:  # descending
        if i < n:
            v = np.zeros(k, np.int64)
            v[0] = sizes[i]
            return v
        v, sums[i] = sums[i], None
        return v

    while len(queue) > 1:
        (_, a), (_, b) = heapq.heappop(queue), heapq.heappop(queue)
        both = vector(a) + vector(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        merges.append((a, b, order))
        sums.append(both)
        heapq.heappush(queue, (int(both[-1] - both[0]), len(sums) - 1))
    window = np.empty(n, np.int64)
    slots = {queue[0][1]: np.arange(k)}
    for i in range(len(merges) - 1, -1, -1):
        a, b, order = merges[i]
        of = slots.pop(n + i)
        mine = np.empty(k, np.int64)
        mine[order] = of
        for child, w in ((a, mine), (b, mine[::-1])):
            if child < n:
                window[child] = w[0]
            else:
                slots[child] = w
    return window, np.bincount(window, weights=sizes, minlength=k).astype(np.int64)


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, none fuller than the capacity. No item may exceed it."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, sums = differencing(sizes, k)
        if sums.max() <= capacity:
            return window
        k += max(1, k // 256)


class WordIds:
    """Ids of whole texts. White space is dropped and no word reaches over a space, so distinct chunks between spaces are encoded once.

    Texts without special tokens are first brought nearer to what the tokenizer makes of them, which leaves fewer distinct chunks: A-Z in lower case, a space
    for a newline and before a comma or full stop that follows a letter (where it cuts in any case). New chunks of plain letters are encoded as one text,
    whose ids are dealt out at the ends of words.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(vocabulary)
        self.model.no_truncation(), self.model.no_padding()
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        self.plain = bool(suffix) and self.model.encode("Ab,c.\nd", add_special_tokens=False).ids == self.model.encode("ab , c . d", add_special_tokens=False).ids
        vocab = self.model.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if self.plain:
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.chunks = Memo()

    def _of_chunks(self, chunks: list[str]) -> list[bytes]:
        joined = [c for c in chunks if c.isalpha()] if self.plain else []
        found = dict(zip(joined, self._of_letters(joined), strict=True))
        others = [c for c in chunks if c not in found]
        found |= zip(others, self._each(others), strict=True)
        return [found[c] for c in chunks]

    def _each(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(chunks, add_special_tokens=False)]

    def _of_letters(self, chunks: list[str]) -> list[bytes]:
        out = []
        for s in range(0, len(chunks), 4096):
            some = chunks[s : s + 4096]
            ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.append(0, np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(some) + 1:  # a letter whose lower case is cut
                out += self._each(some)
                continue
            raw, cuts = ids.tobytes(), cuts.tolist()
            out += [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def _nearer(self, texts: pa.Array) -> pa.Array:
        if not self.plain:
            return texts
        near = pc.replace_substring_regex(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), "([a-z])([,.])", r"\1 \2")
        special = reduce(pc.or_, [pc.match_substring(texts, t) for t in self.special] + [pc.match_substring(texts, t, ignore_case=True) for t in self.special])
        return pc.if_else(special, texts, near)

    def of_texts(self, texts: pa.Array, end_id: int) -> list[np.ndarray]:
        """The ids of each text, and the end id."""
        lists = pc.split_pattern(self._nearer(texts), " ")
        coded = lists.flatten().dictionary_encode()
        codes, chunks = coded.indices.to_numpy(), strings(coded.dictionary)
        self.chunks.add(chunks, self._of_chunks)
        ids = list(map(self.chunks.__getitem__, chunks))
        offsets = np.append(0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4))
        flat = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.uint32))).take(pa.array(codes)).flatten().to_numpy()
        at = np.append(0, np.cumsum(np.diff(offsets)[codes]))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        end = np.array([end_id], np.uint32)
        return [np.concatenate((flat[a:b], end)) for a, b in zip(at[:-1], at[1:], strict=True)]


def pieces_of(lengths: list[int], capacity: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, start and length of the pieces of a group: full ones, then the rest in parts."""
    doc, start, length = [], [], []
    for d, n in enumerate(lengths):
        full = n - n % capacity
        cuts = [*range(0, full, capacity), *range(full, n, part), n]
        doc += [d] * (len(cuts) - 1)
        start += cuts[:-1]
        length += [b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return np.array(doc, np.int64), np.array(start, np.int64), np.array(length, np.int64)


def place(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    full = length == capacity
    sequence = np.empty(len(length), np.int64)
    sequence[full] = np.arange(full.sum())
    if not full.all():
        sequence[~full] = full.sum() + windows(length[~full], capacity)
    order = np.argsort(sequence, kind="stable")
    ends = np.cumsum(length[order])
    first = np.flatnonzero(np.append(True, np.diff(sequence[order]) > 0))
    before = np.repeat((ends - length[order])[first], np.diff(np.append(first, len(order))))
    offset = np.empty(len(length), np.int64)
    offset[order] = ends - length[order] - before
    return sequence, offset


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, part: int = PART, group_tokens: int = GROUP_TOKENS, group_docs: int = GROUP_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids (unsigned 32-bit little-endian), doc_tokens, sequence_id, offset: one row per piece."""
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, used = WordIds(vocabulary), TaskContext.get().partitionId() << 40
        keys, ids, held = [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal used
            doc, start, length = pieces_of([len(i) for i in ids], capacity, part)
            sequence, offset = place(length, capacity)
            raw = [ids[d][a : a + n].tobytes() for d, a, n in zip(doc, start, length, strict=True)]
            tokens = np.array([len(i) for i in ids], np.int64)[doc]
            group = pa.RecordBatch.from_arrays([pa.concat_arrays(keys).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(raw, pa.binary()), pa.array(tokens), pa.array(sequence + used), pa.array(offset)], names)
            used += int(sequence.max()) + 1
            return group

        for batch in slices(batches, most=2 << 20, rows=group_docs):
            keys.append(batch.column("id"))
            new = model.of_texts(texts_of(batch.column("text")), end_id)
            ids += new
            held += sum(map(len, new))
            if held >= group_tokens or len(ids) >= group_docs:
                yield packed()
                keys, ids, held = [], [], 0
        if ids:
            yield packed()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)
