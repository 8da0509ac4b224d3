"""Pre-tokens of byte-level BPE vocabularies, on whole Arrow batches.

A text is cut at single spaces into chunks (in Arrow), and the distinct chunks of a batch are resolved once. That is exact, since no
pre-token reaches over a space but as its first character: what a chunk with its leading space yields on its own is what it
yields in the text. Texts where that may not be so (a space beside any other white space, as NBSP or a line's end, or at an end of the
text) are cut by the pattern as a whole.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The pre-token pattern of the byte-level vocabularies, and white space as their library sees it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space beside white space (Unicode's, and what Python adds to it), or at an end.
WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ODD_SPACE = f"^ |{WHITE} | {WHITE}| $"
#: Bytes of text that are worked on at once; a longer text makes a batch of its own.
BATCH_BYTES = 4 << 20
#: Rows of a batch at most, bytes of what is kept in a worker's memory, and characters of a key that is kept.
BATCH_ROWS, MEMO_BYTES, LONG_KEY = 16_384, 96 << 20, 256


def texts_of(column: pa.Array) -> pa.Array:
    """Null: empty. The offsets begin at zero, as ascii_lower needs them."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(texts):
        return pa.array([], pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if at[0] == 0 and texts.offset == 0:
        return texts
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), data.slice(at[0], at[-1] - at[0]))


def strings(array: pa.Array) -> list[str]:
    """Through numpy, which is several times as fast as to_pylist."""
    return array.to_numpy(zero_copy_only=False).tolist()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text size and row count."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def special_pattern(path: str) -> tuple[regex.Pattern | None, dict[str, int]]:
    """The vocabulary's added tokens, which are found in texts before anything else."""
    with open(path, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f).get("added_tokens") or []}
    return (regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None), added


class PreTokens:
    """Cuts texts into chunks and chunks into pre-tokens; special tokens stand as pre-tokens of their own."""

    def __init__(self, vocabulary: str):
        self.special, self.special_ids = special_pattern(vocabulary)
        self.pattern = regex.compile(PATTERN)

    def split(self, text: str) -> list[str]:
        word = text[1:] if text[:1] == " " else text
        if word.isalpha():  # letters only, as most chunks are
            return [text]
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return [text[:-1], word[-1]]
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text)
        return [p for i, part in enumerate(self.special.split(text)) for p in ([part] if i % 2 else self.pattern.findall(part))]

    def chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ends of the texts in the codes, the codes, and by code the chunk."""
        odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts), " ")
        starts = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        ends, firsts = starts[1:] - starts[0], starts[:-1] - starts[0]
        # A text's first chunk has no leading space: codes of its own, above those of the other chunks. What stands first only is resolved as that only.
        heads, own = np.unique(codes[firsts], return_inverse=True)
        codes[firsts] = own + len(distinct)
        inside = np.bincount(codes, minlength=len(distinct))[: len(distinct)] > 0
        chunks = [" " + c if u else "" for c, u in zip(strings(distinct), inside.tolist(), strict=True)] + strings(distinct.take(pa.array(heads)))
        if odd.any():
            more = {i: self.split(texts[int(i)].as_py()) for i in np.flatnonzero(odd)}
            new = {p: len(chunks) + n for n, p in enumerate(dict.fromkeys(p for found in more.values() for p in found))}
            chunks += new
            spans = [np.array([new[p] for p in more[i]], np.int64) if i in more else s for i, s in enumerate(np.split(codes, ends[:-1]))]
            codes, ends = np.concatenate(spans), np.cumsum([len(s) for s in spans])
        return ends, codes, chunks


class Memo(dict):
    """What was found for a key, as far as ``MEMO_BYTES`` go. Keys of over ``LONG_KEY`` characters stay for the batch in work only. When full, only the keys in use stay."""

    def __init__(self):
        super().__init__()
        self.bytes, self.passing = 0, []

    def add(self, keys: list[str], resolve) -> None:
        """resolve: the values of a list of distinct new keys. All keys are here until the next call."""
        for k in self.passing:
            del self[k]
        self.passing = []
        if self.bytes > MEMO_BYTES:
            kept = {k: self[k] for k in keys if k in self}
            self.clear()
            self.update(kept)
            self.bytes = sum(map(self._size, kept.items()))
        if new := [k for k in dict.fromkeys(keys) if k not in self]:
            found = dict(zip(new, resolve(new), strict=True))
            self.update(found)
            self.passing = [k for k in new if len(k) > LONG_KEY]
            self.bytes += sum(map(self._size, found.items())) - sum(self._size((k, found[k])) for k in self.passing)

    @staticmethod
    def _size(item: tuple) -> int:
        return sys.getsizeof(item[0]) + sys.getsizeof(item[1]) + 100


def spread(ends: np.ndarray) -> np.ndarray:
    """The number of the text that each code belongs to."""
    return np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
