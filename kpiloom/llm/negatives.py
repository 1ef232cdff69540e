"""Hard negatives by a secondary-sort shuffle.

The anchors are a stated query set, taken in blocks of bounded bytes. Tasks score their rows against a block by matrix products
of whole numbers and keep, of every slice of rows, what can matter: first the best partners of the anchor's own label, then,
once an anchor's positives are known, the best rows of other labels inside each positive's window. Their scores are packed into
(anchor, descending score, id) keys; ``repartitionAndSortWithinPartitions`` brings each anchor's pairs to one task in that
order, and an iterator opens a window at each positive and emits the negatives that follow. No task holds the pairs of an anchor.

Defined results: a row takes part if id, label and vector are there and every component is finite; of vectors of different
lengths the shorter counts as filled up with zeros; scores beyond 2^62 are cut to it. Rows that repeat are partners each by itself,
but no row is a partner of an anchor with its own id, and of anchors that share an id the smallest (label, vector) counts. An
empty table has no pairs; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import shared_path, slices

POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
SCALE = 256
#: Bytes of the anchors' components in one block, and how many anchors and rows are scored at once.
BLOCK_BYTES = 16_000_000
ANCHORS_AT_ONCE, ROWS_AT_ONCE = 256, 4096
_LIMIT = 1 << 62
_NONE = -_LIMIT - 1
PAIRS = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


@dataclass(frozen=True)
class Anchors:
    """One block: ids, labels, whole components and, once known, the bounds of each positive's window."""

    ids: np.ndarray
    labels: np.ndarray
    parts: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def whole_parts(vectors: pa.Array, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` of every component as doubles, one row a vector, short ones filled with zeros."""
    lengths = np.asarray(pa.compute.list_value_length(vectors)).astype(np.int64)
    flat = np.floor(np.asarray(pa.compute.list_flatten(vectors).cast(pa.float64())) * scale)
    if len(lengths) and (lengths == lengths[0]).all():
        return flat.reshape(len(lengths), -1)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of both; doubles hold them up to 2^53, Python integers beyond."""
    width = max(left.shape[1], right.shape[1])
    left, right = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (left, right))
    if np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(1, width) < 2**53:
        return (left @ right.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (left, right)]
    return np.clip(whole[0] @ whole[1].T, -_LIMIT, _LIMIT).astype(np.int64)


def window(positive_score: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest whole score between ``low`` and ``high`` hundredths of the positive's."""
    return -(-low * positive_score // 100), high * positive_score // 100


def _first(scores: np.ndarray, n: int) -> np.ndarray:
    """Where the ``n`` largest of each row are, earlier ones first among equals; ``_NONE`` is no score."""
    best = np.argsort(-scores, axis=1, kind="stable")[:, :n]
    out = np.zeros(scores.shape, bool)
    np.put_along_axis(out, best, True, axis=1)
    return out & (scores != _NONE)


def _inside(scores: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Where the ``n`` largest of each row within any of its windows are, earlier ones first among equals."""
    order = np.argsort(-scores, axis=1, kind="stable")
    falling = np.take_along_axis(scores, order, axis=1)
    out = np.zeros(scores.shape, bool)
    for k in range(low.shape[1]):
        at = (falling > high[:, k, None]).sum(axis=1)[:, None] + np.arange(n)
        there = at < scores.shape[1]
        at = np.minimum(at, scores.shape[1] - 1)
        there &= np.take_along_axis(falling, at, axis=1) >= low[:, k, None]
        row, col = np.nonzero(there)
        out[row, order[row, at[row, col]]] = True
    return out & (scores != _NONE)


def _keys(anchors: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Keys of 24 bytes whose byte order is anchor, falling score, id."""
    flip = np.uint64(1 << 63)
    parts = np.stack([anchors.view(np.uint64) ^ flip, (-scores).view(np.uint64) ^ flip, ids.view(np.uint64) ^ flip], axis=1)
    packed = pa.py_buffer(parts.astype(">u8").tobytes())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(24), len(ids), [None, packed]).cast(pa.binary())


def _unpacked(key: bytes) -> tuple[int, int, int]:
    anchor, score, row = (int.from_bytes(key[i : i + 8], "big") - (1 << 63) for i in (0, 8, 16))
    return anchor, -score, row


def pairs(rows: DataFrame, block, positives: int, negatives: int, scale: int = SCALE) -> DataFrame:
    """Packed keys of the pairs of a broadcast block that can matter, with whether the labels are equal."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = block.value
        for batch in slices(batches, ROWS_AT_ONCE):
            ids, labels = np.asarray(batch.column("id")), np.asarray(batch.column("label"))
            by_id = np.argsort(ids, kind="stable")
            ids, labels, parts = ids[by_id], labels[by_id], whole_parts(batch.column("vector"), scale)[by_id]
            for at in range(0, len(anchors.ids), ANCHORS_AT_ONCE):
                some = slice(at, at + ANCHORS_AT_ONCE)
                scores = inner_products(anchors.parts[some], parts)
                other = anchors.ids[some, None] != ids
                same = anchors.labels[some, None] == labels
                kept = _first(np.where(same & other, scores, _NONE), positives)
                if anchors.low is not None:
                    kept |= _inside(np.where(~same & other, scores, _NONE), anchors.low[some], anchors.high[some], negatives)
                a, r = np.nonzero(kept)
                if len(a):
                    yield pa.RecordBatch.from_arrays([_keys(anchors.ids[some][a], scores[a, r], ids[r]), pa.array(same[a, r])], names=["key", "same"])

    return rows.mapInArrow(score, "key binary, same boolean")


def _sorted_pairs(scored: DataFrame):
    """The pairs as an RDD in key order, all pairs of an anchor in one partition."""
    tasks = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = scored.rdd.map(lambda r: (bytes(r[0]), r[1]))
    return keyed.repartitionAndSortWithinPartitions(tasks, lambda key: zlib.crc32(key[:8]))


def leading(sorted_pairs: Iterator[tuple[bytes, bool]], positives: int) -> Iterator[tuple[int, int, int]]:
    """The first pairs of equal labels of each anchor."""
    now, n = None, 0
    for key, same in sorted_pairs:
        anchor, score, row = _unpacked(key)
        if anchor != now:
            now, n = anchor, 0
        if same and n < positives:
            n += 1
            yield anchor, score, row


def mined(
    sorted_pairs: Iterator[tuple[bytes, bool]], positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Open a window at each positive of an anchor and emit the negatives that fall into it.

    Scores fall, so a negative of a window comes after its positive. Only a window at zero also takes negatives of score zero
    with smaller ids; the first of those are remembered. Windows below zero are empty.
    """
    now, windows, zeros = None, [], []
    for key, same in sorted_pairs:
        anchor, score, row = _unpacked(key)
        if anchor != now:
            now, windows, zeros = anchor, [], []
        if same:
            if len(windows) < positives:
                windows.append([row, score, *window(score, low, high), 0])
                for zero in zeros if score == 0 else []:
                    windows[-1][4] += 1
                    yield anchor, row, windows[-1][4], zero, 0, 0
            continue
        if score == 0 and len(zeros) < negatives:
            zeros.append(row)
        for w in windows:
            if w[2] <= score <= w[3] and w[4] < negatives:
                w[4] += 1
                yield anchor, w[0], w[4], row, w[1], score


def taking_part(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label") -> DataFrame:
    """Id, label and vector of the rows that have all of them with finite components."""
    picked = rows.select(
        F.col(key).cast("bigint").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return picked.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").filter(finite)


def _blocks(anchors: DataFrame, scale: int, block_bytes: int) -> Iterator[Anchors]:
    """The anchors in blocks of bounded size: each is one written file with a largest number of rows."""
    single = anchors.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("first")).select("id", "first.*")
    width = single.agg(F.max(F.size("vector"))).first()[0] or 1
    most = max(1, block_bytes // (8 * width))
    path = shared_path(anchors, "anchors")
    single.coalesce(max(1, min(single.count() // most, 64))).write.option("maxRecordsPerFile", most).parquet(path)
    stored = anchors.sparkSession.read.schema(single.schema).parquet(path)
    for file in sorted(stored.inputFiles()):
        rows = anchors.sparkSession.read.schema(single.schema).parquet(file).toArrow()  # at most ``most`` rows
        if rows.num_rows:
            yield Anchors(np.asarray(rows["id"]), np.asarray(rows["label"]), whole_parts(rows["vector"].combine_chunks(), scale))


def _with_windows(block: Anchors, found: list[tuple[int, int, int]], positives: int, low: int, high: int) -> Anchors:
    place = {int(a): i for i, a in enumerate(block.ids)}
    lows, highs = np.ones((len(block.ids), positives), np.int64), np.zeros((len(block.ids), positives), np.int64)
    taken = np.zeros(len(block.ids), np.int64)
    for anchor, score, _ in found:
        i = place[anchor]
        lows[i, taken[i]], highs[i, taken[i]] = window(score, low, high)
        taken[i] += 1
    return Anchors(block.ids, block.labels, block.parts, lows, highs)


def mine(
    rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    scale: int = SCALE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Hard negatives of each anchor and positive, ranked from 1.

    Both frames come from ``taking_part``. All rows are scored against every block of anchors, twice: for the positives, and for
    the negatives in their windows. ``0 <= low < high < 100``, so that a window lies below its positive.
    """
    if not 0 <= low < high < 100:
        raise ValueError("0 <= low < high < 100 must hold")
    spark = rows.sparkSession
    path = shared_path(rows, "hard-negatives")
    spark.createDataFrame([], PAIRS).write.parquet(path)
    for block in _blocks(anchors, scale, block_bytes):
        shared = spark.sparkContext.broadcast(block)
        found = _sorted_pairs(pairs(rows, shared, positives, negatives, scale)).mapPartitions(lambda p: leading(p, positives)).collect()  # a few of each anchor
        windows = spark.sparkContext.broadcast(_with_windows(block, found, positives, low, high))
        result = _sorted_pairs(pairs(rows, windows, positives, negatives, scale)).mapPartitions(lambda p: mined(p, positives, negatives, low, high))
        spark.createDataFrame(result, PAIRS).write.mode("append").parquet(path)
        shared.unpersist()
        windows.unpersist()
    return spark.read.schema(PAIRS).parquet(path)
