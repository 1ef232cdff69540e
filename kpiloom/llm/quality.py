"""Quality rules: gradient-boosted trees over statistics of whole documents.

Trees are fitted to labelled rows with histograms and monotonic constraints on chosen features, then flattened into numpy node
arrays, so that scoring walks all rows of a batch down one tree level at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import sized_slices

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5
#: Bound of the labelled rows that the classifier is fitted to, taken in the order of a hash of their ids.
SAMPLE = 8_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "symbol_share", "repeat_share", "dup_line_share", "upper_share", "digit_share", "punctuation_share", "distinct_share",
    "mean_word", "longest_word", "words_per_line", "bar_share", "log_words", "bang_share",
)
#: -1: a larger value never raises the score.
MONOTONE = {"symbol_share": -1, "repeat_share": -1, "dup_line_share": -1}


def document_statistics(text: str) -> tuple[list[int], list[float]]:
    """Counts named in ``BASE`` and the features of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at ASCII white space only
    n = len(words)
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    word_chars = len(text) - blanks
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    dup_lines = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    chars = max(word_chars, 1)
    upper = sum(map(str.isupper, text)) if not raw.isascii() else sum(raw.count(c) for c in range(65, 91))
    digits = sum(raw.count(c) for c in range(48, 58))
    punctuation = sum(map(raw.count, (b".", b",", b";", b":", b"!", b"?")))
    features = [
        symbols / chars, repeated / max(n, 1), dup_lines / max(len(lines), 1), upper / chars, digits / chars, punctuation / chars,
        len(set(words)) / max(n, 1), word_chars / max(n, 1), max(map(len, words), default=0), n / max(len(lines), 1),
        raw.count(b"|") / max(n, 1), float(np.log1p(n)), raw.count(b"!") / max(n, 1),
    ]
    return [n, word_chars, symbols, dup_lines, repeated], features


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words which the text has twice or more, the first one included."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    again = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    edges = np.zeros(len(words) + 1, np.int32)
    starts = np.flatnonzero(again)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1] > 0))


@dataclass
class Trees:
    """All nodes of all trees, one array per field; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality; a value equal to the threshold goes left."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


@dataclass
class BoostedTrees:
    """Logistic gradient boosting on histograms of at most ``bins`` values a feature."""

    monotone: list[int]
    trees: int = 40
    depth: int = 4
    rate: float = 0.2
    bins: int = 32
    least: int = 5
    ridge: float = 1.0
    nodes: list[list] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        bias = float(np.log(share / (1 - share)))
        margin, roots = np.full(len(y), bias), []
        if 0 < y.sum() < len(y):
            for _ in range(self.trees):
                p = 1 / (1 + np.exp(-margin))
                roots.append(self._grow(binned, cuts, y - p, p * (1 - p), np.arange(len(y)), 0, (-np.inf, np.inf), margin))
        columns = list(zip(*self.nodes, strict=True)) or [(), (), (), (), ()]
        kinds = (np.int64, float, np.int64, np.int64, float)
        arrays = [np.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return Trees(np.array(roots, np.int64), *arrays, bias=bias, depth=self.depth)

    def _grow(self, binned, cuts, gradient, hessian, rows, depth, bounds, margin) -> int:
        node = len(self.nodes)
        self.nodes.append([0, 0.0, node, node, 0.0])
        best = None
        if depth < self.depth and len(rows) >= 2 * self.least:
            best = self._best_split(binned, cuts, gradient, hessian, rows, bounds)
        if best is None:
            value = float(np.clip(gradient[rows].sum() / (hessian[rows].sum() + self.ridge), *bounds)) * self.rate
            self.nodes[node][4] = value
            margin[rows] += value
            return node
        _, j, k, low, high = best
        goes_left = binned[rows, j] <= k
        middle = (low + high) / 2
        # with a constraint, what lies below one side of the split stays on that side of the middle
        left_bounds, right_bounds = bounds, bounds
        if self.monotone[j] < 0:
            left_bounds, right_bounds = (max(middle, bounds[0]), bounds[1]), (bounds[0], min(middle, bounds[1]))
        elif self.monotone[j] > 0:
            left_bounds, right_bounds = (bounds[0], min(middle, bounds[1])), (max(middle, bounds[0]), bounds[1])
        self.nodes[node][0], self.nodes[node][1] = j, float(cuts[j][k])
        self.nodes[node][2] = self._grow(binned, cuts, gradient, hessian, rows[goes_left], depth + 1, left_bounds, margin)
        self.nodes[node][3] = self._grow(binned, cuts, gradient, hessian, rows[~goes_left], depth + 1, right_bounds, margin)
        return node

    def _best_split(self, binned, cuts, gradient, hessian, rows, bounds):
        g, h = gradient[rows], hessian[rows]
        total_g, total_h = g.sum(), h.sum()
        gain_of = lambda a, b: a * a / (b + self.ridge)
        best = None
        for j, cut in enumerate(cuts):
            size = len(cut) + 1
            b = binned[rows, j]
            left_g = np.cumsum(np.bincount(b, g, size))[:-1]
            left_h = np.cumsum(np.bincount(b, h, size))[:-1]
            left_n = np.cumsum(np.bincount(b, minlength=size))[:-1]
            if not len(left_g):
                continue
            low = np.clip(left_g / (left_h + self.ridge), *bounds)
            high = np.clip((total_g - left_g) / (total_h - left_h + self.ridge), *bounds)
            gain = gain_of(left_g, left_h) + gain_of(total_g - left_g, total_h - left_h) - gain_of(total_g, total_h)
            allowed = (left_n >= self.least) & (len(rows) - left_n >= self.least) & (self.monotone[j] * (high - low) >= 0)
            gain = np.where(allowed, gain, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = (gain[k], j, k, float(low[k]), float(high[k]))
        return best


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Trees:
    """Fit to at most ``sample`` labelled documents, chosen by a hash of their ids.

    Repeated labels of a document count by their mean, and rows that repeat an id count once, by the smallest of their features, so
    ``sample`` bounds the rows as well. Labels or ids that are null are left out. Without labels or documents, or with one class
    only, every document gets the same score.
    """
    labelled = labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.avg("quality").alias("_y"))
    chosen = labelled.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = documents.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "_id").select("_id", "text", "_y")
    kind = rows.schema["_id"].dataType.simpleString()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, "text"):
            found = [document_statistics(t or "")[1] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found, pa.list_(pa.float64())), batch.column("_y")], names=["_id", "x", "_y"])

    each = rows.mapInArrow(features, f"_id {kind}, x array<double>, _y double")
    got = each.groupBy("_id").agg(F.min("x").alias("x"), F.min("_y").alias("_y")).collect()  # a row for each chosen label at most
    if not got:
        return BoostedTrees([0] * len(FEATURES)).fit(np.zeros((1, len(FEATURES))), np.ones(1))
    x, y = np.array([r.x for r in got]), np.array([float(r._y >= 0.5) for r in got])
    order = np.lexsort((*x.T, y))  # the same trees whatever order the rows come in
    return BoostedTrees([MONOTONE.get(f, 0) for f in FEATURES]).fit(x[order], y[order])


def score(documents: DataFrame, trees: Trees, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, base counts, ``base_failed``, ``score`` and ``kept`` of each document; a null text has no words and fails.

    ``kept`` is false where the base rule fails, else it tells whether the score reaches ``threshold``. Repeated rows are
    scored as often as they come.
    """
    shared = documents.sparkSession.sparkContext.broadcast(trees)
    rows = documents.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, "text"):
            both = [document_statistics(t or "") for t in batch.column("text").to_pylist()]
            counts = np.array([b for b, _ in both], np.int64)
            scores = shared.value.score(np.array([f for _, f in both]))
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED_PERCENT * counts[:, 0])
            columns = [batch.column("_id"), *(pa.array(counts[:, i]) for i in range(len(BASE))), pa.array(failed), pa.array(scores), pa.array(~failed & (scores >= threshold))]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", *BASE, "base_failed", "score", "kept"])

    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, " + ", ".join(f"{b} bigint" for b in BASE) + ", base_failed boolean, score double, kept boolean"
    return rows.mapInArrow(judge, schema).withColumnRenamed("_id", key)


def keep_good(documents: DataFrame, trees: Trees, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The documents that pass, with all their columns; scoring adds no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(trees)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, text):
            both = [document_statistics(t or "") for t in batch.column(text).to_pylist()]
            counts = np.array([b for b, _ in both], np.int64)
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED_PERCENT * counts[:, 0])
            yield batch.filter(pa.array(~failed & (shared.value.score(np.array([f for _, f in both])) >= threshold)))

    return documents.mapInArrow(keep, documents.schema)
