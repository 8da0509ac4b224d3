"""Byte-level BPE encoding and decoding in numpy.

Encoding: the symbols of all new words of a batch lie in one flat array. Each round looks every adjacent pair up by binary search over the sorted
pair keys, finds the lowest rank of each word, and merges all places where a word has it (left to right where they overlap); words
without a known pair leave the array. Since a merge's result takes part in later merges only, that equals merging one place at
a time. Ids of resolved chunks stay in a bounded memo. Decoding looks up each id's bytes and reads the document's bytes as UTF-8.

Rows keep their partition: nothing is shuffled. Defined results: a null or empty text has no ids and decodes to the empty
text; repeated rows are encoded each; special tokens inside a text get their own id; bytes that are no UTF-8 decode to U+FFFD;
null ids and other columns do no harm.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import Memo, PreTokens, slices, texts_of

NONE = np.iinfo(np.int64).max
#: Bytes from which on a word goes by itself.
LONG = 1024


def byte_alphabet() -> dict[str, int]:
    """Character to byte, by the rule of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}


class Bpe:
    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.cut = PreTokens(vocabulary)
        letters, vocab = byte_alphabet(), model["vocab"]
        self.of_byte = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        special = self.cut.special_ids
        self.size = max([*vocab.values(), *special.values()]) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of: dict[int, int] = {}
        texts = [b""] * self.size
        for token, i in vocab.items():
            texts[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in special.items():
            texts[i] = token.encode()
        self.bytes_of = pa.array(texts, pa.large_binary())
        self.chunks, self.words = Memo(), Memo()

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        short = iter(self._in_rounds([w for w in words if len(w) < LONG]))
        return [next(short) if len(w) < LONG else self._by_queue(w) for w in words]

    def _ranks(self, symbols: np.ndarray) -> np.ndarray:
        """The rank of each adjacent pair."""
        keys = symbols[:-1] * self.size + symbols[1:]
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.ranks[place], NONE)

    def _by_queue(self, word: bytes) -> np.ndarray:
        """The ids of one long word: the lowest rank first, its places from left to right, as far as they are still there. Links to the neighbours stand in for the array."""
        if not self.rank_of:
            self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        start = self.of_byte[np.frombuffer(word, np.uint8)]
        ranks, end, size, rank_of = self._ranks(start), len(start), self.size, self.rank_of
        symbols, rank = array("q", start.tobytes()), array("q", np.append(ranks, NONE).tobytes())
        after, before = array("q", np.arange(1, end + 1).tobytes()), array("q", np.arange(-1, end - 1).tobytes())
        order = np.argsort(ranks, kind="stable")[: int((ranks != NONE).sum())]
        values, firsts = np.unique(ranks[order], return_index=True)
        places = {v: p.tolist() for v, p in zip(values.tolist(), np.split(order, firsts[1:]), strict=True)} if len(values) else {}
        queue = list(places)
        while queue:
            now = heappop(queue)
            waiting = sorted(places.pop(now))
            for n, p in enumerate(waiting):
                if rank[p] != now:
                    continue
                gone, lowest = after[p], now
                symbols[p] = self.merged[now]
                after[p] = after[gone]
                rank[gone] = NONE
                if after[gone] < end:
                    before[after[gone]] = p
                for q in (before[p], p):
                    if q >= 0:
                        rank[q] = r = rank_of.get(symbols[q] * size + symbols[after[q]], NONE) if after[q] < end else NONE
                        if r != NONE:
                            lowest = min(lowest, r)
                            if r not in places:
                                places[r] = []
                                heappush(queue, r)
                            places[r].append(q)
                if lowest < now:  # the rest waits for what has become possible before it
                    if now not in places:
                        places[now] = []
                        heappush(queue, now)
                    places[now] += waiting[n + 1 :]
                    break
        links, at, out = after, 0, []
        while at < end:
            out.append(symbols[at])
            at = links[at]
        return np.array(out, np.int32)

    def _in_rounds(self, words: list[bytes]) -> list[np.ndarray]:
        """By merge rounds over one flat array."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols, word = self.of_byte[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        while len(symbols):
            rank = np.append(np.where(word[:-1] == word[1:], self._ranks(symbols), NONE), NONE)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            per_word = np.diff(np.append(first, len(word)))
            lowest = np.repeat(np.minimum.reduceat(rank, first), per_word)
            ended = lowest == NONE
            done_symbols.append(symbols[ended]), done_words.append(word[ended])
            here = np.flatnonzero((rank == lowest) & ~ended)
            run = np.flatnonzero(np.append(True, np.diff(here) > 1)) if len(here) else here
            here = here[(np.arange(len(here)) - np.repeat(run, np.diff(np.append(run, len(here))))) % 2 == 0]  # a a a: the first two
            symbols[here] = self.merged[rank[here]]
            stay = ~ended
            stay[here + 1] = False
            symbols, word = symbols[stay], word[stay]
        symbols, word = np.concatenate([*done_symbols, symbols]), np.concatenate([*done_words, word])
        symbols = symbols[np.argsort(word, kind="stable")].astype(np.int32)
        return np.split(symbols, np.cumsum(np.bincount(word, minlength=len(words)))[:-1]) if words else []

    def _of_words(self, words: list[str]) -> list[bytes]:
        special = self.cut.special_ids
        found = iter(self.merge([w.encode() for w in words if w not in special]))
        return [np.int32(special[w]).tobytes() if w in special else next(found).tobytes() for w in words]

    def _of_chunks(self, chunks: list[str]) -> list[bytes]:
        split = [self.cut.split(c) for c in chunks]
        self.words.add(list({p for ps in split for p in ps}), self._of_words)
        return [b"".join([self.words[p] for p in ps]) for ps in split]

    def encode(self, texts: pa.Array) -> pa.LargeListArray:
        ends, codes, chunks = self.cut.chunks(texts)
        self.chunks.add(chunks, self._of_chunks)
        ids = [self.chunks[c] for c in chunks]
        offsets = np.append(0, np.cumsum([len(i) // 4 for i in ids]))
        of_chunk = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
        flat = of_chunk.take(pa.array(codes)).flatten()
        tokens = np.append(0, np.cumsum(np.diff(offsets)[codes]))
        return pa.LargeListArray.from_arrays(pa.array(tokens[np.append(0, ends)]), flat)

    def decode(self, ids: pa.LargeListArray) -> pa.Array:
        parts = pa.LargeListArray.from_arrays(ids.offsets, self.bytes_of.take(ids.values))
        raw = pc.binary_join(parts, pa.scalar(b"", pa.large_binary()))
        return pa.array([b.as_py().decode("utf-8", "replace") for b in raw], pa.large_string())


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), decoded: one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(vocabulary)
        for batch in slices(batches):
            ids = bpe.encode(texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids.cast(pa.list_(pa.int32())), bpe.decode(ids).cast(pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
