"""Quality by Bradley-Terry pairwise ranking: a document's strength is a linear score of its features; pairs of one document of label 1 and
one of label 0 are preferences, and the weights are learnt by logistic loss on the pairs' feature differences. The
threshold is a quantile of the scores: the share of label 0 among all labelled documents is cut off.

Features are shares and means over the whole text (symbols, capitals, digits, table bars, repeats, distinct words, word and line lengths), taken in whole Arrow batches;
rows keep their partition and no text is shuffled. Nothing comes from a sample: means, pairs, slopes and the quantile are of all labelled documents that are not held out, summed up in tasks;
the driver gets sums of a task and counts of bins.

Defined results: a null or empty text has zero features and gets their score. Repeated rows are scored each. Null ids are scored and not
held out. Without labelled texts of both classes every score is ``unlearnt``, or else the smoothed share of label 1. Other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, usable_labels, words
from .pretokens import slices, texts_of
from .shared import Scratch
from .toxicity import Constant, score_rows

FOLDS, HELD_OUT_FOLD, THRESHOLD = 4, 2, 0.7
PAIRS, STEPS, DECAY = 32_768, 400, 1e-3
#: Rows of the larger class that are paired in one group, and the least of the smaller one (on average, where there are so many); bins of a round of the quantile.
GROUP, FEW, BINS = 4096, 64, 1024
SOME_BYTES = 1 << 20
#: Classes of bytes, of which the share in a text's bytes is a feature. Bytes of other scripts are in none.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n", b".,;:'\"-()", b"!?", b"|", b"#$%&*+/<=>@[\\]^_`{}~"]
CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _n, _members in enumerate(CLASSES):
    CLASS_OF[list(_members)] = _n


def class_counts(texts: pa.Array, size: np.ndarray) -> np.ndarray:
    """Bytes of each class by text; taken apart ``SOME_BYTES`` at a time, so that a very long text costs no more memory than others."""
    n, k = len(texts), len(CLASSES) + 1
    flat = np.frombuffer(b"".join(texts.cast(pa.large_binary()).to_pylist()), np.uint8)
    ends, counts = np.cumsum(size), np.zeros(n * k, np.int64)
    for s in range(0, len(flat), SOME_BYTES):
        part = flat[s : s + SOME_BYTES]
        first, last = np.searchsorted(ends, [s, s + len(part) - 1], side="right")
        inside = np.diff(np.clip(ends[first : last + 1], s, s + len(part)), prepend=s)
        found = np.bincount(np.repeat(np.arange(last - first + 1) * k, inside) + CLASS_OF[part], minlength=(last - first + 1) * k)
        counts[first * k : (last + 1) * k] += found
    return counts.reshape(n, k)


def features(texts: pa.Array) -> np.ndarray:
    """One row per text; roots spread shares that lie close to zero."""
    n = len(texts)
    size = pc.binary_length(texts).to_numpy().astype(np.int64)
    counts = class_counts(texts, size)
    shares = counts / np.maximum(1, size)[:, None]
    of_text, codes, distinct = words(texts)
    per_text = np.bincount(of_text, minlength=n)
    some = np.maximum(1, per_text)
    again = (codes[1:] == codes[:-1]) & (of_text[1:] == of_text[:-1])
    repeats = np.bincount(of_text[1:][again], minlength=n) / some
    kinds = np.bincount(np.unique(of_text * max(1, len(distinct)) + codes) // max(1, len(distinct)), minlength=n) if len(codes) else np.zeros(n)
    length = np.array([len(w) for w in distinct], float)
    marked = np.array([sum(not c.isalnum() for c in w) > 1 for w in distinct], float)
    of_words = lambda x: np.bincount(of_text, weights=x[codes], minlength=n) / some if len(codes) else np.zeros(n)
    letters = counts[:, 0] + counts[:, 1]
    more = [repeats, kinds / some ** 0.75, of_words(length) / 10, of_words(marked), counts[:, 0] / np.maximum(1, letters), np.log1p(per_text) / 5, (counts[:, 4] + (size > 0)) / some]
    return np.sqrt(np.column_stack([shares, *more]))


class BradleyTerry:
    """Weights of standardised features, and the score that is cut at."""

    @classmethod
    def of(cls, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, cut: float, threshold: float) -> BradleyTerry:
        model = cls()
        model.mean, model.spread, model.weights, model.cut, model.at_cut = mean, spread, weights, cut, float(np.log(threshold / (1 - threshold)))
        return model

    def fit(self, texts: pa.Array, labels: np.ndarray, counts: dict[int, int], threshold: float, seed: int = 42) -> BradleyTerry:
        """Of texts in memory, with ``PAIRS`` random pairs; rows weigh as their class does in counts. ``score_quality`` fits on tables, by ``fitted``."""
        rows = np.concatenate([features(texts_of(texts[s : s + 128])) for s in range(0, len(texts), 128)])
        mean, spread = rows.mean(0), np.maximum(rows.std(0), 1e-6)
        rng = np.random.default_rng(seed)
        better, worse = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
        rows_ = (rows - mean) / spread
        difference = rows_[rng.choice(better, PAIRS)] - rows_[rng.choice(worse, PAIRS)]
        weights = newton(lambda w: partial_sums(difference, w), rows.shape[1])
        weight = np.where(labels == 1, counts[1] / (labels == 1).sum(), counts[0] / (labels == 0).sum())
        strength = strengths(rows, mean, spread, weights)
        order = np.argsort(strength, kind="stable")
        at = int(np.clip(np.searchsorted(np.cumsum(weight[order]), counts[0] * (1 - 1e-9)), 0, len(order) - 2))
        self.__dict__ |= vars(self.of(mean, spread, weights, float(strength[order][at : at + 2].mean()), threshold))
        return self

    def scores(self, texts: pa.Array) -> np.ndarray:
        strength = strengths(features(texts), self.mean, self.spread, self.weights)
        return 1 / (1 + np.exp(-np.clip(strength - self.cut + self.at_cut, -500, 500)))


def strengths(rows: np.ndarray, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (rows - mean) / spread @ weights


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, id_col: str, text_col: str) -> DataFrame:
    """label, x and order (a hash that sorts them) of all labelled rows that are not held out.

    Labels other than 0 and 1 and rows without an id are left out; an id with both labels counts as 1, an id with several texts counts with the shortest (of equal ones, the least hash).
    """
    known = usable_labels(labels, label, folds, fold, id_col)
    may = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col), folds, fold))
    rows = may.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = features(texts_of(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "size", "tag")), lists], ["id", "size", "tag", "x"])

    made = rows.select("id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("tag"), "text").mapInArrow(run, "id long, size int, tag long, x array<double>")
    once = made.join(known, "id").groupBy("id", "label").agg(F.min_by("x", F.struct("size", "tag")).alias("x"))  # features are joined, not texts
    return once.select("label", "x", F.xxhash64("id").alias("order"))


def preferences(rows: DataFrame, counts: dict[int, int], mean: np.ndarray, spread: np.ndarray) -> DataFrame:
    """x: differences of standardised features, label 1 less label 0. Each row of the larger class meets one of the other class, in groups of about ``GROUP`` rows; the smaller class's rows take part in turn, ``FEW`` in a group at least or all of them."""
    small = min(counts, key=lambda k: (counts[k], k))
    groups = max(1, -(-max(counts.values()) // GROUP))
    own = min(groups, max(1, counts[small] // FEW))  # groups that share their rows of the smaller class have one number modulo this
    at = lambda n: F.pmod(F.xxhash64("order"), F.lit(n))
    copies = F.when(F.col("label") == small, F.sequence(at(own), F.lit(groups - 1).cast("long"), F.lit(own).cast("long"))).otherwise(F.array(at(groups)))

    def pair(table: pa.Table) -> pa.Table:
        table = table.sort_by("order")
        x = (np.array(table.column("x").combine_chunks().flatten()).reshape(len(table), -1) - mean) / spread
        label = table.column("label").to_numpy()
        few, many = x[label == small], x[label != small]
        difference = (many - few[np.arange(len(many)) % len(few)]) * (1 if small == 0 else -1) if len(few) else many[:0]
        return pa.table({"x": pa.array(list(difference), pa.list_(pa.float64()))})

    return rows.withColumn("group", F.explode(copies)).groupBy("group").applyInArrow(pair, "x array<double>")


def partial_sums(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Number of the differences x, and sums over them of the slope and the curvature of -log sigmoid(x . weights), in one array."""
    p = 1 / (1 + np.exp(np.clip(x @ weights, -500, 500)))
    return np.concatenate([[len(x)], -(p @ x), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])


def sums_of(pairs: DataFrame, weights: np.ndarray) -> np.ndarray:
    """``partial_sums`` of all pairs: a row a task."""
    k = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k + k * k)
        for batch in batches:
            total += partial_sums(np.array(batch.column("x").flatten()).reshape(-1, k), weights)
        yield pa.RecordBatch.from_pydict({"s": pa.array([total.tolist()], pa.list_(pa.float64()))})

    return np.sum(sorted(pairs.mapInArrow(run, "s array<double>").toArrow().column("s").to_pylist()), axis=0)


def newton(sums: Callable[[np.ndarray], np.ndarray], k: int) -> np.ndarray:
    """The weights at which the mean of -log sigmoid(difference . weights), with decay, is least."""
    weights = np.zeros(k)
    for _ in range(STEPS):
        total = sums(weights)
        n, slope, curve = total[0], total[1 : k + 1], total[k + 1 :].reshape(k, k)
        step = np.linalg.solve(curve / n + DECAY * np.eye(k), slope / n + DECAY * weights)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fitted(rows: DataFrame, counts: dict[int, int], threshold: float) -> BradleyTerry:
    """The model of all the rows (label, x, order), of which there are so many of each class."""
    width = rows.select(F.size("x").alias("k")).first()["k"]
    sums = rows.agg(*(f(F.col("x")[i]).alias(f"{n}{i}") for i in range(width) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean, spread = np.array([sums[f"m{i}"] for i in range(width)]), np.maximum([sums[f"s{i}"] for i in range(width)], 1e-6)
    scratch = Scratch(rows.sparkSession, "quality")
    pairs = scratch.save(preferences(rows, counts, mean, spread), "pairs")
    weights = newton(lambda w: sums_of(pairs, w), width)
    scratch.drop("pairs")
    return BradleyTerry.of(mean, spread, weights, quantile(rows, counts, mean, spread, weights), threshold)


def quantile(rows: DataFrame, counts: dict[int, int], mean: np.ndarray, spread: np.ndarray, weights: np.ndarray) -> float:
    """The mean of the strengths on either side of the place below which as many of all labelled rows lie as have label 0. Exact: the place is narrowed down by counts in equal bins, until what is left is few rows or one value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").flatten()).reshape(len(batch), -1)
            yield pa.RecordBatch.from_pydict({"s": strengths(x, mean, spread, weights)})

    scratch = Scratch(rows.sparkSession, "strengths")
    all_rows = scratch.save(rows.mapInArrow(run, "s double"), "strengths")
    found = [_nth(all_rows, at) for at in (counts[0], counts[0] + 1)]
    scratch.drop("strengths")
    return float(np.mean(found))


def _nth(rows: DataFrame, n: int) -> float:
    """The n-th smallest s, from 1."""
    low, high = rows.agg(F.min("s"), F.max("s")).first()
    while low < high:
        inside = rows.where(F.col("s").between(low, high))
        width = (high - low) / BINS
        place = F.least(F.floor((F.col("s") - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        bins = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("bin").collect()
        for b in bins:
            if n <= b["n"]:
                break
            n -= b["n"]
        if (b["low"], b["high"]) == (low, high):  # as close as doubles go: these are few values
            values = inside.groupBy("s").agg(F.count("*").alias("n")).orderBy("s").collect()
            ends = np.cumsum([v["n"] for v in values])
            return values[int(np.searchsorted(ends, n))]["s"]
        low, high = b["low"], b["high"]
    return low


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, folds: int = FOLDS, fold: int = HELD_OUT_FOLD, id_col: str = "doc_id", text_col: str = "text", unlearnt: float | None = None) -> DataFrame:
    """All columns of docs, with held_out, score and predicted (which replace columns of those names): one row per row of docs. unlearnt: every row's score where there is nothing to learn from."""
    scratch = Scratch(docs.sparkSession, "labelled")
    rows = scratch.save(labelled_features(docs, labels, label, folds, fold, id_col, text_col), "rows")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) == 2:
        model = fitted(rows, counts, threshold)
    else:
        known = usable_labels(labels, label, folds, fold, id_col).groupBy("label").agg(F.count("*").alias("n"))
        model = Constant({r["label"]: r["n"] for r in known.collect()}, unlearnt)
    scratch.drop("rows")
    return score_rows(docs, model, threshold, folds, fold, id_col, text_col)
