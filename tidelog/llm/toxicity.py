"""Toxicity by subword bags: a word's vector is the mean of its subwords' vectors, a document's the mean of its words', and a linear
softmax gives the class. Subword vectors and softmax are trained jointly, in numpy, by mini-batches.

Subwords are the word between boundary marks and its n-grams of 3 to 6 characters, hashed into buckets, so an unseen misspelling
shares most of its subwords with the word it stands for. The model is fitted on a bounded sample of labelled rows (``SAMPLE`` a class) and the class shares of all labelled rows are put back
into the bias. As all is linear up to the softmax, a trained model gives each distinct word one number; a document is scored by a
weighted sum over its distinct words, in whole Arrow batches, so rows keep their partition and nothing is shuffled.

Defined results: a null or empty text has the zero vector and gets the score of the bias. Repeated rows are scored each. Null ids are
scored and not held out. Without labelled texts of both classes every score is ``unlearnt``, or else the smoothed share of label 1, (n1 + 1/2) / (n + 2). Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .labelled import held_out, training_sample, words
from .pretokens import Memo, slices, texts_of

BUCKETS, DIM, NGRAMS = 1 << 17, 8, range(3, 7)
#: Passes over the sample, the least number of mini-batches in all, their size, the step, its share for the softmax, and the decay of vectors.
EPOCHS, LEAST_STEPS, BATCH, RATE, WEIGHT_RATE, DECAY = 20, 200, 64, 0.1, 0.1, 1e-3
#: Documents that must share a subword for it to count, documents that its spread is shrunk by, and standard errors.
LEAST_DOCS, PRIOR_DOCS, LEAST_CONTRAST = 3, 5, 3.0
#: Documents that are taken apart at once while fitting.
PASS_DOCS = 128
#: Characters of words that are taken apart at once when scoring (a longer word goes piece by piece), and of the longest word that anything is learnt from.
PIECE, LONGEST_LEARNT = 1 << 18, 10_000
FOLDS, HELD_OUT_FOLD, THRESHOLD = 5, 0, 0.5
MIX = np.uint64(0x9E3779B97F4A7C15)


def subwords(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The word number and bucket of every subword; words lose what is no letter or digit at their ends."""
    return _grams(["<" + _bare(w) + ">" for w in distinct])


def _grams(marked: list[str], starts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of words with their boundary marks; starts: only those that begin among so many first characters."""
    size = np.array([len(w) for w in marked], np.int64)
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(marked)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(chars))  # characters from here to the word's end
    left[len(chars) if starts is None else starts :] = 0
    with np.errstate(over="ignore"):
        numbers, hashes, running = [], [], chars * MIX
        for n in range(2, NGRAMS[-1] + 1):
            running = np.append((running[:-1] ^ (running[:-1] >> np.uint64(29))) * MIX + chars[n - 1 :], np.uint64(0))[: max(0, len(chars) - n + 1)]
            if n in NGRAMS:
                whole = left[: len(running)] >= n
                numbers.append(word[: len(running)][whole]), hashes.append(running[whole])
        number, found = np.concatenate(numbers), np.concatenate(hashes)
        found = (found ^ (found >> np.uint64(32))) * MIX
    return number, (found >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _bare(word: str) -> str:
    if word.isalnum():
        return word
    at, to = 0, len(word)
    while at < to and not word[at].isalnum():
        at += 1
    while to > at and not word[to - 1].isalnum():
        to -= 1
    return word[at:to]


def document_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, bucket and weight: the mean over a document's words of the means over their subwords."""
    of_text, codes, distinct = words(texts)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    key, counts = np.unique(of_text * len(distinct) + codes, return_counts=True)
    doc, word = key // len(distinct), key % len(distinct)
    share = counts / np.bincount(of_text, minlength=len(texts))[doc]
    number, bucket = subwords([w if len(w) <= LONGEST_LEARNT else "" for w in distinct])
    bucket = bucket[np.argsort(number, kind="stable")]
    per_word = np.bincount(number, minlength=len(distinct))
    first = np.cumsum(per_word) - per_word
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ends = np.searchsorted(doc, np.arange(64, len(texts) + 64, 64))  # 64 documents at a time bound the memory
    for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
        w, n = word[a:b], per_word[word[a:b]]
        if not n.sum():
            continue
        at = np.repeat(first[w] - np.cumsum(n) + n, n) + np.arange(n.sum())
        keys, inverse = np.unique(np.repeat(doc[a:b], n) * BUCKETS + bucket[at], return_inverse=True)
        out.append((keys // BUCKETS, keys % BUCKETS, np.bincount(inverse, weights=np.repeat(share[a:b] / np.maximum(n, 1), n)).astype(np.float32)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else document_rows(texts[:0])


class SubwordSoftmax:
    """Subword vectors (buckets x dim), softmax weights (dim x 2) and bias."""

    def __init__(self, seed: int = 42):
        self.rng = np.random.default_rng(seed)
        self.vectors = np.zeros((BUCKETS, DIM), np.float32)
        side = self.rng.uniform(-1, 1, DIM) / np.sqrt(DIM)
        self.weights = np.column_stack([-side, side]).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.words = Memo()

    def fit(self, texts: pa.Array, labels: np.ndarray, counts: dict[int, int]) -> SubwordSoftmax:
        """In two passes over the texts, some at a time: one for the buckets' units, one for the rows of the buckets that are used."""
        self.unit = self._units(texts, labels)
        docs, buckets, weights = [], [], []
        for s in range(0, len(texts), PASS_DOCS):
            doc, bucket, weight = document_rows(texts_of(texts[s : s + PASS_DOCS]))
            kept = self.unit[bucket] > 0
            docs.append((doc[kept] + s).astype(np.int32)), buckets.append(bucket[kept].astype(np.int32)), weights.append((weight * self.unit[bucket])[kept].astype(np.float32))
        doc, bucket, weight = np.concatenate(docs), np.concatenate(buckets), np.concatenate(weights)
        ends = np.searchsorted(doc, np.arange(len(labels) + 1))
        share = np.bincount(labels, minlength=2) / len(labels)
        self.bias = np.log(share).astype(np.float32)
        epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(labels)))
        for epoch in range(epochs):
            order = self.rng.permutation(len(labels))
            for s in range(0, len(order), BATCH):
                self._step(order[s : s + BATCH], labels, ends, bucket, weight, RATE * (1 - epoch / epochs))
        true = np.array([counts[0], counts[1]], float)
        self.bias = (self.bias + np.log(true / true.sum()) - np.log(share)).astype(np.float32)
        return self

    def _units(self, texts: pa.Array, labels: np.ndarray) -> np.ndarray:
        """Vectors are learnt in units of their bucket's spread, so that rare and common subwords move alike, times how far the classes' means
        lie apart beyond ``LEAST_CONTRAST`` standard errors: what does not tell the classes apart would only be learnt by heart."""
        n = len(labels)
        seen_in, square, sums = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS), [np.zeros(BUCKETS), np.zeros(BUCKETS)]
        for s in range(0, n, PASS_DOCS):
            doc, bucket, weight = document_rows(texts_of(texts[s : s + PASS_DOCS]))
            weight = weight.astype(np.float64)
            seen_in += np.bincount(bucket, minlength=BUCKETS)
            square += np.bincount(bucket, weights=weight**2, minlength=BUCKETS)
            for k in (0, 1):
                sums[k] += np.bincount(bucket, weights=weight * (labels[doc + s] == k), minlength=BUCKETS)
        of_class = [(labels == k).sum() for k in (0, 1)]
        spread = np.sqrt(np.maximum(square / n - ((sums[0] + sums[1]) / n) ** 2, 1e-30) * (1 / of_class[0] + 1 / of_class[1]))
        contrast = np.abs(sums[1] / of_class[1] - sums[0] / of_class[0]) / spread
        unit = 1 / np.sqrt(np.maximum(square * (1 + PRIOR_DOCS / np.maximum(1, seen_in)) / n, 1e-30))
        # What one or two documents have says nothing of others.
        return np.where(seen_in >= LEAST_DOCS, unit * np.maximum(0, contrast - LEAST_CONTRAST) / 10, 0)

    def _step(self, rows, labels, ends, bucket, weight, rate) -> None:
        size = ends[rows + 1] - ends[rows]
        at = np.repeat(ends[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        used, inverse = np.unique(bucket[at], return_inverse=True)
        table = self.vectors[used]
        mix = np.zeros((len(rows), len(used)), np.float32)  # a mini-batch is dense in its own subwords
        mix[np.repeat(np.arange(len(rows)), size), inverse] = weight[at]
        mean = mix @ table
        out = mean @ self.weights + self.bias
        out = np.exp(out - out.max(1, keepdims=True))
        wrong = out / out.sum(1, keepdims=True)
        wrong[np.arange(len(rows)), labels[rows]] -= 1
        wrong /= len(rows)
        self.vectors[used] = table * (1 - rate * DECAY) - rate * (mix.T @ (wrong @ self.weights.T))
        self.weights -= WEIGHT_RATE * rate * (mean.T @ wrong)
        self.bias -= rate * wrong.sum(0)

    def ready(self) -> SubwordSoftmax:
        """As each bucket's share in the log-odds of label 1: all that scoring needs."""
        self.odds = self.unit * (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)
        self.start = float(self.bias[1] - self.bias[0])
        del self.vectors, self.unit
        return self

    def _of_words(self, distinct: list[str]) -> list[float]:
        """The mean of each word's subwords, words of about ``PIECE`` characters at a time."""
        out: list[float] = []
        ends = np.cumsum([len(w) for w in distinct])
        at = 0
        while at < len(distinct):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")))
            if len(distinct[at]) > PIECE:
                out.append(self._of_long_word(distinct[at]))
            else:
                number, bucket = subwords(distinct[at:to])
                total = np.bincount(number, weights=self.odds[bucket], minlength=to - at)
                out += (total / np.maximum(1, np.bincount(number, minlength=to - at))).tolist()
            at = to
        return out

    def _of_long_word(self, word: str) -> float:
        marked, total, n = "<" + _bare(word) + ">", 0.0, 0
        for at in range(0, len(marked), PIECE):
            _, bucket = _grams([marked[at : at + PIECE + NGRAMS[-1] - 1]], PIECE)
            total, n = total + float(self.odds[bucket].sum()), n + len(bucket)
        return total / max(1, n)

    def scores(self, texts: pa.Array) -> np.ndarray:
        of_text, codes, distinct = words(texts)
        self.words.add(distinct, self._of_words)
        each = np.fromiter(map(self.words.__getitem__, distinct), np.float64, len(distinct))
        total = np.bincount(of_text, weights=each[codes], minlength=len(texts)) if len(codes) else np.zeros(len(texts))
        n = np.bincount(of_text, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(self.start + total / np.maximum(1, n), -500, 500)))


class Constant:
    """For want of two classes."""

    def __init__(self, counts: dict[int, int], score: float | None = None):
        self.score = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 2) if score is None else score

    def scores(self, texts: pa.Array) -> np.ndarray:
        return np.full(len(texts), self.score)


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD, folds: int = FOLDS, fold: int = HELD_OUT_FOLD, id_col: str = "doc_id", text_col: str = "text", unlearnt: float | None = None) -> DataFrame:
    """All columns of docs, with held_out, score and predicted (which replace columns of those names): one row per row of docs. unlearnt: every row's score where there is nothing to learn from."""
    sample, counts = training_sample(docs, labels, label, folds, fold, id_col=id_col, text_col=text_col)
    if len(set(sample["label"].to_pylist())) == 2:
        model = SubwordSoftmax().fit(texts_of(sample["text"].combine_chunks()), sample["label"].to_numpy(), counts).ready()
    else:
        model = Constant(counts, unlearnt)
    return score_rows(docs, model, threshold, folds, fold, id_col, text_col)


def score_rows(docs: DataFrame, model, threshold: float, folds: int, fold: int, id_col: str, text_col: str) -> DataFrame:
    """The rows with a model's scores. The model is sent to each executor once; its size is bounded by its parameters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=text_col):
            score = shared.value.scores(texts_of(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    rows = docs.select(*(docs[c] for c in kept))
    scored = rows.mapInArrow(run, StructType([*rows.schema, StructField("score", DoubleType())]))
    return scored.select(*kept, held_out(F.col(id_col), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
