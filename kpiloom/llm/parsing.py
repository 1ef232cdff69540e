"""Document fingerprints by locally consistent parsing.

A text is parsed in levels. On each, runs of one symbol are folded, deterministic coin tossing reduces neighbouring names to a
few colours, and a phrase begins at each local maximum of colour, so every phrase spans two to four symbols. A phrase's name is
a hash of the names in it. A boundary depends on a few neighbours only, so equal substrings get the same interior names at any
offset. A fingerprint holds the smallest distinct names of two levels, about 15 and 95 bytes a phrase.

Everything is numpy over whole Arrow buffers; boundaries are found in stretches with a margin as wide as their reach.

Defined results: a null text is the empty text, whose fingerprint is empty; two empty fingerprints have likeness 1, an empty and
another 0. Texts shorter than a phrase are one phrase of themselves. Rows follow each other by falling key, nulls last, then
hash and text, so ties have an order and repeated rows follow each other; the row after the last is the first, and the only row
of a table follows itself. Empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import sized_slices, written

#: Levels whose phrase names make the fingerprint, and how many names of each.
LEVELS = (3, 5)
NAMES = 32
#: Symbols coloured at once, and the reach of a boundary: four tosses to the left, three recolourings and a maximum to both sides.
STRETCH, MARGIN = 1 << 20, 8
_TOSSES = 4
#: Bytes of texts parsed at once, so that the arrays stay in the processor's cache; a longer text comes alone.
BYTES_AT_ONCE = 300_000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _tossed(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Twice the lowest bit place where a name differs from its left neighbour, plus that bit; neighbours keep differing.

    The first name of a text, at ``starts``, is compared with its own complement.
    """
    differs = np.empty_like(names)
    np.bitwise_xor(names[1:], names[:-1], out=differs[1:])
    differs[starts] = ~names.dtype.type(0)
    lowest = differs & -differs
    place = np.bitwise_count(lowest - names.dtype.type(1))
    return (place << np.uint8(1)) | ((names & lowest) != 0)


def _recoloured(colours: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Six colours to three: each of the upper three takes the smallest that no neighbour of the same text has."""
    last = np.roll(first, -1)
    for colour in (5, 4, 3):
        at = np.flatnonzero(colours == colour)
        left = np.where(first[at], 9, colours[at - 1])
        right = np.where(last[at], 9, colours[(at + 1) % len(colours)])
        free = np.where((left != 0) & (right != 0), 0, np.where((left != 1) & (right != 1), 1, 2))
        colours[at] = free
    return colours


def _boundaries(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin: at the start of a text and at local maxima of colour. Neighbours of a text must differ."""
    out = first.copy()
    for at in range(0, len(names), STRETCH):
        a, b = max(0, at - MARGIN), min(len(names), at + STRETCH + MARGIN)
        begin = first[a:b].copy()
        begin[0] = True
        starts = np.flatnonzero(begin)
        colours = names[a:b]
        for _ in range(_TOSSES):
            colours = _tossed(colours, starts)
        colours = _recoloured(colours, begin)
        peaks = np.zeros(b - a, bool)
        peaks[1:] = colours[1:] > colours[:-1]
        peaks[:-1] &= (colours[:-1] > colours[1:]) | begin[1:]
        peaks[starts] = False
        # A peak right after a text's first symbol would leave that symbol alone.
        peaks[starts[starts + 1 < len(peaks)] + 1] = False
        end = min(at + STRETCH, len(names))
        out[at:end] |= peaks[at - a : end - a]
    return out


def _folded(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one name within a text as one symbol, named by the name and, beyond one, the length."""
    begin = first.copy()
    begin[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(begin)
    length = np.diff(np.concatenate((at, [len(names)]))).astype(np.uint64)
    kept = names[at].astype(np.uint64)
    long = np.flatnonzero(length > 1)
    kept[long] = _mixed(kept[long] * _STEP + length[long])
    return kept, first[at]


def _phrases(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level: a name for each phrase, and which is the first of its text."""
    names, first = _folded(names, first)
    at = np.flatnonzero(_boundaries(names, first))
    length = np.diff(np.concatenate((at, [len(names)])))
    out = _mixed(length.astype(np.uint64) * _STEP + names[at])
    for k in range(1, int(length.max(initial=0))):
        has = np.flatnonzero(length > k)
        out[has] = _mixed(out[has] * _STEP + names[at[has] + k])
    return out, first[at]


def parsed(data: np.ndarray, offsets: np.ndarray, levels: tuple[int, ...] = LEVELS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of ``levels``, the phrase names of all texts and the number of the text each belongs to."""
    there = np.flatnonzero(np.diff(offsets) > 0)
    names, first = data, np.zeros(len(data), bool)
    first[offsets[there]] = True
    for level in range(1, max(levels) + 1):
        names, first = _phrases(names, first)
        if level in levels:
            yield names, there[np.cumsum(first) - 1] if len(first) else there


def fingerprints_of(texts: list[str], levels: tuple[int, ...] = LEVELS, count: int = NAMES) -> list[tuple[np.ndarray, ...]]:
    """For each text and level, the smallest distinct names of 32 bits, in order."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in encoded], dtype=np.int64)))
    data = np.frombuffer(b"".join(encoded), np.uint8)
    of_level = []
    for names, text in parsed(data, offsets, levels):
        both = np.unique((text.astype(np.uint64) << np.uint64(32)) | (names >> np.uint64(32)))
        text = (both >> np.uint64(32)).astype(np.int64)
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        low = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        of_level.append([low[a : min(b, a + count)] for a, b in zip(ends[:-1], ends[1:], strict=True)])
    return list(zip(*of_level, strict=True))


def as_string(names: tuple[np.ndarray, ...]) -> str:
    """A fingerprint as hexadecimal names, levels parted by a colon; that of an empty text is the empty string."""
    return ":".join(n.astype(">u4").tobytes().hex() for n in names) if any(len(n) for n in names) else ""


def as_names(fingerprint: str) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(bytes.fromhex(p), ">u4").astype(np.uint32) for p in fingerprint.split(":")) if fingerprint else ()


def likeness(one: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...], count: int = NAMES) -> float:
    """Mean over the levels of the share of common names among the smallest of both, an estimate of their sets' likeness."""
    empty = [not any(len(n) for n in f) for f in (one, other)]
    if any(empty):
        return float(all(empty))
    shares = []
    for a, b in zip(one, other, strict=True):
        smallest = np.union1d(a, b)[:count]
        common = np.intersect1d(a, b, assume_unique=True)
        shares.append(np.count_nonzero(common <= smallest[-1]) / len(smallest))
    return sum(shares) / len(shares)


def fingerprint(documents: DataFrame, key: str = "doc_id", text: str = "text", levels: tuple[int, ...] = LEVELS, count: int = NAMES) -> DataFrame:
    """Key and fingerprint of every text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, "text", BYTES_AT_ONCE):
            found = fingerprints_of([t or "" for t in batch.column("text").to_pylist()], levels, count)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(as_string, found), pa.string())], names=["doc_id", "fingerprint"])

    rows = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(make, "doc_id bigint, fingerprint string")


def with_tail(text: str, following: str) -> str:
    """The text with its last third replaced by as many first characters of the following one, or all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


#: Compared rows are ``whole``; the first and last row of a task also leave their text and name, to be compared across tasks.
_OUT = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
_SQL = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(keys: list, texts: list[str], following: list[str], own: list, of_following: list) -> pa.RecordBatch:
    edited = [with_tail(a, b) for a, b in zip(texts, following, strict=True)]
    of_edited = fingerprints_of(edited)
    values = [
        keys, [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        [as_string(f) for f in own], [as_string(f) for f in of_edited],
        [likeness(f, e) for f, e in zip(own, of_edited, strict=True)], [likeness(f, n) for f, n in zip(own, of_following, strict=True)],
    ]
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, (_, kind) in zip(values, _OUT, strict=True)], names=[n for n, _ in _OUT])


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows compared with their follower in the task, and the first and last row with their texts."""
    task, held = TaskContext.get().partitionId(), None

    def edge(kind: str, row) -> pa.RecordBatch:
        empty = [pa.array([row[0]], pa.int64()), *(pa.nulls(1, kind) for _, kind in _OUT[1:])]
        return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([task], pa.int32()), pa.array([row[1]]), *empty], names=names)

    names = ["part", "task", "text", *(n for n, _ in _OUT)]
    for batch in sized_slices(batches, "text", BYTES_AT_ONCE):
        keys, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
        if not keys:
            continue
        own = fingerprints_of(texts)
        if held is None:
            yield edge("first", (keys[0], texts[0]))
        else:
            keys, texts, own = [held[0], *keys], [held[1], *texts], [held[2], *own]
        held = (keys[-1], texts[-1], own[-1])
        if len(keys) > 1:
            out = _compared(keys[:-1], texts[:-1], texts[1:], own[:-1], own[1:])
            n = out.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(["whole"] * n), pa.array([task] * n, pa.int32()), pa.nulls(n, pa.string()), *out.columns], names=names)
    if held is not None:
        yield edge("last", held)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sized_slices(batches, "text", BYTES_AT_ONCE):
        texts, following = batch.column("text").to_pylist(), batch.column("following").to_pylist()
        yield _compared(batch.column("doc_id").to_pylist(), texts, following, fingerprints_of(texts), fingerprints_of(following))


def compared_with_edits(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like the former is to the latter and to the next text's.

    Texts are shuffled once, into ranges of falling keys. A task compares the rows it holds; only the last of each range
    meets the first of the next by a join of one row a range.
    """
    rows = documents.select(
        F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("hash"),
    )
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc_nulls_last("doc_id"), F.asc("hash")]
    ordered = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    parts = written(ordered.mapInArrow(_within, f"part string, task int, text string, {_SQL}"), "fingerprints")
    first, last = parts.filter("part = 'first'"), parts.filter("part = 'last'")
    used = sorted(r.task for r in first.select("task").collect())  # one number for each range
    follower = {t: used[(i + 1) % len(used)] for i, t in enumerate(used)}
    pairs = documents.sparkSession.createDataFrame(sorted(follower.items()), "task int, next int")
    seams = last.select("task", "doc_id", "text").join(pairs, "task").join(first.select(F.col("task").alias("next"), F.col("text").alias("following")), "next")
    return parts.filter("part = 'whole'").drop("part", "task", "text").unionByName(seams.select("doc_id", "text", "following").mapInArrow(_across, _SQL))
