"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared as bytes in lower case, with ASCII punctuation and white space reduced to single spaces. If an item of n bytes lies in a
document with at most k edits, the two share at least n - q + 1 - k q of the item's q-grams, on diagonals that differ by at most
k. So shared q-grams are counted in diagonal bands of width 2 (k + 1), each overlapping the next by half; bands that reach the
bound are verified by banded alignment of the item against the region. Where many items share a q-gram, an item may leave out up to
half its bound of such q-grams, with the bound lowered by as many; bands found so are counted with all q-grams before the alignment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import sized_slices

Q = 12
#: Edits allowed per byte of an item.
EDIT_RATE = 0.06
#: Bytes of benchmark text whose index a task holds at once; more items are compared block after block.
BLOCK_BYTES = 16_000_000
#: Bytes of documents gathered before the next of several blocks is searched.
GATHERED_BYTES = 32_000_000
#: Items that share a q-gram beyond which it counts as common.
COMMON = 16
#: Bytes of a text in which an item's q-grams are counted; bytes, counters and q-grams of items that are held at once.
PART, WINDOW, CELLS, POSTINGS = 32_768, 1_000_000, 4_000_000, 2_000_000
_BITS = 22
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TO_BLANK = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


def normal(text: str) -> bytes:
    """Lower case, ASCII punctuation as white space, and one space between words."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TO_BLANK).split())


def budget(n: int, q: int = Q, rate: float = EDIT_RATE) -> int:
    """Edits allowed for an item of n bytes: the rate, or less if the bound on shared q-grams would fall below one."""
    return max(0, min(int(rate * n), (n - q) // q))


def qgrams(data: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each window of 12 bytes, read as one 8-byte and one 4-byte integer."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.ndarray((n,), "<u8", data, 0, (1,))
    four = np.ndarray((n,), "<u4", data, 8, (1,))
    mixed = eight * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= four * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed


@dataclass
class Index:
    """Distinct items of one block: their keys, bytes, a bitmap of q-grams, and the sorted q-grams with items and positions.

    Each item leaves out some of its q-grams that many items share, half of the bound at most; ``least`` is what is then needed.
    """

    keys: list[list[int | None]]
    items: list[bytes]
    short: list[tuple[list[int | None], bytes]]
    bits: int
    bitmap: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    position: np.ndarray
    need: np.ndarray
    least: np.ndarray
    width: np.ndarray
    longest: int


@dataclass
class Block:
    """The rows of one block; a task builds the index when it first searches, so neither the driver nor a broadcast holds it."""

    rows: list[tuple[list[int | None], str]]

    @cached_property
    def index(self) -> Index:
        return build(self.rows)


def build(rows: list[tuple[list[int | None], str]]) -> Index:
    """Items shorter than q bytes are found as they are; empty and null ones never match; items equal to each other all count."""
    by_text: dict[bytes, list[int | None]] = {}
    for keys, text in rows:
        if data := normal(text or ""):
            by_text.setdefault(data, []).extend(keys)
    short = [(keys, data) for data, keys in by_text.items() if len(data) < Q]
    items = [data for data in by_text if len(data) >= Q]
    sizes = np.array([len(x) - Q + 1 for x in items], np.int64)
    ends = np.cumsum(sizes)
    total = int(sizes.sum())
    found = np.empty(total, np.uint64)
    for at in range(0, len(items), 4096):
        grams = qgrams(np.frombuffer(b"".join(items[at : at + 4096]), np.uint8))
        n, end = sizes[at : at + 4096], ends[at : at + 4096]
        skipped = np.repeat((Q - 1) * np.arange(len(n)), n)  # windows that begin in one item and end in the next
        found[int(end[0] - n[0]) : int(end[-1])] = grams[np.arange(int(n.sum())) + skipped]
    need = np.array([len(x) - Q + 1 - budget(len(x)) * Q for x in items], np.int64)
    order = np.argsort(found)
    found = found[order]
    starts = np.concatenate((np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if total else np.zeros(0, np.int64), [total]))
    order = order.astype(np.int32)
    item = np.repeat(np.arange(len(items), dtype=np.int32), sizes)[order]
    position = order - (ends - sizes).astype(np.int32)[item]
    del order
    times = np.diff(starts)
    common = np.flatnonzero(np.repeat(times > COMMON, times))
    dropped = np.zeros(len(items), np.int64)
    if len(common):
        often = np.repeat(times.astype(np.int32), times)[common]
        by = np.lexsort((-often, item[common]))  # the commonest of each item first
        own = item[common][by]
        begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        place = np.arange(len(own)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(own)]))))
        out = common[by[place < need[own] // 2]]
        dropped = np.bincount(item[out], minlength=len(items))
        kept = np.ones(total, bool)
        kept[out] = False
        found, item, position = found[kept], item[kept], position[kept]
        starts = np.concatenate((np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))), [len(found)]))
    grams = found[starts[:-1]]
    bits = max(_BITS, (16 * len(grams)).bit_length())
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    slot = grams >> np.uint64(64 - bits)
    byte = (slot >> np.uint64(3)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1]))) if len(byte) else byte
    bitmap[byte[begin]] = np.bitwise_or.reduceat(np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8), begin) if len(byte) else byte
    width = np.array([budget(len(x)) + 1 for x in items], np.int64)
    longest = max(map(len, items), default=0)
    return Index([by_text[x] for x in items], items, short, bits, bitmap, grams, starts, item, position, need, need - dropped, width, longest)


def edits_within(item: bytes, region: bytes, most: int) -> int | None:
    """Edits of the best alignment of the whole item to some part of the region, or None if there are more than ``most``."""
    if item in region:
        return 0
    a, b = np.frombuffer(item, np.uint8), np.frombuffer(region, np.uint8)
    places = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)  # the item may begin anywhere in the region
    for i, c in enumerate(a, 1):
        step = np.empty_like(row)
        step[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (b != c), out=step[1:])
        row = np.minimum.accumulate(step - places) + places
        if row.min() > most:
            return None
    best = int(row.min())
    return best if best <= most else None


def search(index: Index, texts: list[bytes]) -> list[tuple[int, int | None, int]]:
    """(text, item key, edits) for every item found in each normalised text."""
    joined = b"\x00".join(texts) + b"\x00" * Q
    found = {(t, key): 0 for keys, data in index.short if data in joined for t, text in enumerate(texts) if data in text for key in keys}
    data = np.frombuffer(joined, np.uint8)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    best: dict[tuple[int, int], int] = {}
    for t, i, low in _bands(index, data, _segments(index, bounds)) if len(index.grams) else ():
        if best.get((t, i)) == 0:
            continue
        item, w = index.items[i], int(index.width[i])
        n, k = len(item), w - 1
        begin, least = max(0, low * w - index.longest - k - int(bounds[t])), int(index.need[i])
        region = texts[t][begin : max(0, (low + 2) * w - index.longest + n + k - int(bounds[t]))]
        if int(index.least[i]) < least and _shared(item, region, begin + int(bounds[t]) + index.longest - low * w, 2 * w) < least:
            continue
        edits = edits_within(item, region, k)
        if edits is not None:
            best[t, i] = min(edits, best.get((t, i), edits))
    for (t, i), edits in best.items():
        for key in index.keys[i]:
            found[t, key] = min(edits, found.get((t, key), edits))
    return [(t, key, edits) for (t, key), edits in found.items()]


def _segments(index: Index, bounds: np.ndarray) -> np.ndarray:
    """Rows of (text, start, stop): texts whole, or in parts that overlap by more than an item with its edits."""
    overlap = index.longest + int(index.width.max()) + Q
    part = max(PART, 2 * overlap)
    out = []
    for t, (start, stop) in enumerate(zip(bounds[:-1].tolist(), (bounds[1:] - 1).tolist(), strict=True)):
        while stop - start > part:
            out.append((t, start, start + part))
            start += part - overlap
        out.append((t, start, stop))
    return np.array(out, np.int64).reshape(-1, 3)


def _bands(index: Index, data: np.ndarray, segments: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Text, item and lower half of each band with enough of the item's q-grams.

    Segments are taken in groups of bounded bytes. Items are counted by segment first, in slices of bounded size, so a q-gram that many
    items share costs time but no memory, and only items with enough q-grams in a segment come to the bands.
    """
    many = len(index.items)
    taken = 0
    while taken < len(segments):
        last = max(taken + 1, min(int(np.searchsorted(segments[:, 2], segments[taken, 1] + WINDOW, side="right")), taken + max(1, CELLS // many)))
        group, taken = segments[taken:last], last
        base = int(group[0, 1])
        grams = qgrams(data[base : int(group[-1, 2]) + Q - 1])
        slot = grams >> np.uint64(64 - index.bits)
        at = np.flatnonzero((index.bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
        order, gram = np.argsort(grams[at]), np.empty(len(at), np.int64)
        gram[order] = np.searchsorted(index.grams, grams[at][order])  # near ones together, so that memory is met in order
        gram[gram == len(index.grams)] = 0
        hit = index.grams[gram] == grams[at]
        at, gram = at[hit] + base, gram[hit]
        first = np.searchsorted(at, group[:, 1])
        sizes = np.maximum(np.searchsorted(at, group[:, 2] - Q, side="right") - first, 0)
        segment = np.repeat(np.arange(len(group)), sizes)  # a q-gram in an overlap counts in both segments
        own = np.repeat(first, sizes) + np.arange(len(segment)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at, gram = at[own], gram[own]
        times = index.starts[gram + 1] - index.starts[gram]
        until = np.concatenate(([0], np.cumsum(times)))

        def postings() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            done = 0
            while done < len(at):
                end = max(done + 1, int(np.searchsorted(until, until[done] + POSTINGS, side="right")) - 1)
                t = times[done:end]
                which = np.repeat(np.arange(done, end), t)
                posting = np.arange(int(until[done]), int(until[end])) - until[which] + index.starts[gram[which]]
                yield segment[which] * many + index.item[posting], which, posting
                done = end

        counts = np.zeros(len(group) * many, np.int32)
        for cell, _, _ in postings():
            if len(cell) > len(counts) // 64:
                counts += np.bincount(cell, minlength=len(counts)).astype(np.int32)
            else:
                np.add.at(counts, cell, 1)
        enough = (counts.reshape(-1, many) >= index.least).ravel()
        if not enough.any():
            continue
        parts = []
        for cell, which, posting in postings():
            keep = np.flatnonzero(enough[cell])
            item = index.item[posting[keep]]
            diagonal = at[which[keep]] - index.position[posting[keep]] + index.longest  # never negative
            parts.append((segment[which[keep]], item, diagonal // index.width[item]))
        # a band covers two halves, so every stretch of one width lies whole in some band
        for s, i, low in _dense_bands(*(np.concatenate(x) for x in zip(*parts, strict=True)), index.least):
            yield int(group[s, 0]), i, low


def _shared(item: bytes, region: bytes, shift: int, width: int) -> int:
    """q-grams that the item and the region share on the ``width`` diagonals from minus ``shift``."""
    grams = qgrams(np.frombuffer(item, np.uint8))
    order = np.argsort(grams)
    theirs = qgrams(np.frombuffer(region, np.uint8))
    first = np.searchsorted(grams[order], theirs, side="left")
    times = np.searchsorted(grams[order], theirs, side="right") - first
    at = np.repeat(np.arange(len(theirs)), times)
    within = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    diagonal = at - order[np.repeat(first, times) + within] + shift
    return int(((diagonal >= 0) & (diagonal < width)).sum())


def _dense_bands(text: np.ndarray, item: np.ndarray, half: np.ndarray, need: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Text, item and lower half of each band of two neighbouring halves that holds as many q-grams as the item needs."""
    order = np.lexsort((half, item, text))
    t, i, h = text[order], item[order], half[order]
    new = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (h[1:] != h[:-1]))))
    counts = np.diff(np.concatenate((new, [len(t)])))
    t, i, h = t[new], i[new], h[new]
    follows = np.concatenate(((t[1:] == t[:-1]) & (i[1:] == i[:-1]) & (h[1:] == h[:-1] + 1), [False]))
    both = counts + np.where(follows, np.concatenate((counts[1:], [0])), 0)
    dense = np.flatnonzero(both >= need[i])
    yield from zip(t[dense].tolist(), i[dense].tolist(), h[dense].tolist(), strict=True)


def blocks(benchmark: DataFrame, item_key: str, item_text: str, block_bytes: int) -> Iterator[Block]:
    """The items in blocks of bounded size, dealt by a hash of their text; a text comes once, with all its keys."""
    rows = benchmark.select(F.col(item_key).alias("k"), F.col(item_text).cast("string").alias("t")).filter("t IS NOT NULL")
    rows = rows.groupBy("t").agg(F.collect_set(F.struct("k")).alias("k"))
    size = rows.agg(F.sum(F.octet_length("t") + 8 * F.size("k"))).first()[0] or 0
    n = int(-(-2 * size // block_bytes)) if size > block_bytes else 1
    for b in range(n):
        own = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == b)
        yield Block([([x.k for x in r.k], r.t) for r in own.collect()])


def _judged(
    shared: list[Broadcast[Block]], batches: Iterator[pa.RecordBatch], text: str,
) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int | None, int]]]]:
    """Slices of the batches with (row, item key, edits) of all items found.

    With several blocks, slices are gathered to a bounded size before a block is searched, and its index goes before the next is built.
    """

    def judged(group: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int | None, int]]]]:
        found: list[list[tuple[int, int | None, int]]] = [[] for _ in group]
        for block in shared:
            for rows, own in zip(group, found, strict=True):
                own += search(block.value.index, [normal(x or "") for x in rows.column(text).to_pylist()])
            if len(shared) > 1:
                del block.value.index
        return zip(group, found, strict=True)

    group, size = [], 0
    for rows in sized_slices(batches, text, 1_000_000):
        group.append(rows)
        size += rows.column(text).nbytes
        if len(shared) == 1 or size > GATHERED_BYTES:
            yield from judged(group)
            group, size = [], 0
    if group:
        yield from judged(group)


def _broadcast(documents: DataFrame, benchmark: DataFrame, item_key: str, item_text: str, block_bytes: int) -> list[Broadcast[Block]]:
    return [documents.sparkSession.sparkContext.broadcast(b) for b in blocks(benchmark, item_key, item_text, block_bytes)]


def contamination(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document ``contaminated``, ``n_items``, ``items`` (ids found, ascending) and ``fewest_edits``.

    Null or empty texts are clean, as is everything if the benchmark is empty. Repeated rows are judged each. Items go to the
    tasks in blocks of bounded size; one pass over the documents searches one block after the other.
    """
    rows = documents.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("text"))
    shared = _broadcast(documents, benchmark, item_key, item_text, block_bytes)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hits in _judged(shared, batches, "text"):
            items: list[set[int | None]] = [set() for _ in range(batch.num_rows)]
            fewest: list[int | None] = [None] * batch.num_rows
            for t, key, edits in hits:
                items[t].add(key)
                fewest[t] = edits if fewest[t] is None else min(edits, fewest[t])
            columns = [batch.column("_id"), pa.array(map(list, items), pa.list_(pa.int64())), pa.array(fewest, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "items", "fewest_edits"])

    found = rows.select("_id", F.array().cast("array<bigint>").alias("items"), F.lit(None).cast("int").alias("fewest_edits"))
    found = rows.mapInArrow(compare, found.schema)
    return found.select(
        F.col("_id").alias(key), (F.size("items") > 0).alias("contaminated"), F.size("items").cast("bigint").alias("n_items"),
        F.array_sort("items").alias("items"), "fewest_edits",
    )


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any benchmark item, with all their columns; one pass over them, no shuffle of theirs."""
    shared = _broadcast(documents, benchmark, "item_id", "text", block_bytes)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hits in _judged(shared, batches, text):
            bad = {t for t, _, _ in hits}
            yield batch.filter(pa.array([t not in bad for t in range(batch.num_rows)], pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
