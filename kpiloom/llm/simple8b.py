"""Token ids in Simple-8b files: a Spark data source to write and read them.

File layout, little-endian: the magic, blocks, a footer, a trailer. A block is a head (ids, words, escapes, CRC-32 of the rest
as unsigned 32-bit integers), its 64-bit words and its escapes. A word holds a selector in its four high bits and up to 60 bits
of ids, the first in the lowest bits. Selector 0 is an escape: its 60 bits are the place of a 64-bit value in the block's
escapes, for values that need more than 60 bits. The footer has the offset and first id of every block and the key and length
of every document; the trailer says where it begins. ``_index.json`` lists the files in order with the ids before each.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from kpiloom.llm.common import sized_slices
from kpiloom.llm.encoders import encoder

MAGIC = b"S8BIDS1\n"
BLOCK_IDS = 16_384
INDEX = "_index.json"
#: Values and bits of each by selector, fixed by the format; selector 0 is the escape.
COUNTS = (1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
_LIMITS = np.array([1 << b for b in BITS[1:]], np.uint64)
_PAD = max(COUNTS)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escapes of one block; each word takes as many of the next values as fit."""
    n = len(values)
    padded = np.concatenate((values.astype(np.uint64), np.zeros(_PAD, np.uint64)))
    need = np.searchsorted(_LIMITS, padded, side="right").astype(np.uint8) + 1  # smallest selector that can hold the value
    best = np.zeros(n, np.uint8)
    best[need[:n] <= 15] = 15
    for selector in range(14, 0, -1):
        count = COUNTS[selector]
        small = need <= selector
        if n == 0 or np.count_nonzero(small[:n]) < min(count, n):
            break
        run = np.concatenate(([0], np.cumsum(~small, dtype=np.int32)))
        best[run[count : count + n] == run[:n]] = selector
    steps, starts, at = np.array(COUNTS)[best].tolist(), [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    first = np.array(starts, np.int64)
    chosen = best[first] if n else best
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        which = np.flatnonzero(chosen == selector)
        if selector == 0:
            words[which] |= np.arange(len(which), dtype=np.uint64)
            continue
        lanes = np.arange(COUNTS[selector])
        shifted = padded[first[which][:, None] + lanes] << (lanes * BITS[selector]).astype(np.uint64)
        words[which] |= np.bitwise_or.reduce(shifted, axis=1)
    return words, padded[first[chosen == 0]] if n else np.zeros(0, np.uint64)


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of a block."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[selectors]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for selector in np.unique(selectors):
        which = np.flatnonzero(selectors == selector)
        starts, body = (ends - counts)[which], words[which] & np.uint64((1 << 60) - 1)
        if selector == 0:
            out[starts] = escapes[body.astype(np.int64)]
        elif BITS[selector]:
            lanes = np.arange(COUNTS[selector])
            values = (body[:, None] >> (lanes * BITS[selector]).astype(np.uint64)) & np.uint64((1 << BITS[selector]) - 1)
            out[starts[:, None] + lanes] = values
    return out[:n]


def block_bytes(values: np.ndarray) -> bytes:
    words, escapes = pack(values)
    body = words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()
    return struct.pack("<4I", len(values), len(words), len(escapes), zlib.crc32(body)) + body


def block_values(stream) -> np.ndarray:
    """The ids of the block at the stream's position."""
    n, n_words, n_escapes, crc = struct.unpack("<4I", stream.read(16))
    body = stream.read(8 * (n_words + n_escapes))
    if zlib.crc32(body) != crc:
        raise ValueError("a block of token ids is damaged")
    both = np.frombuffer(body, "<u8")
    return unpack(both[:n_words], both[n_words:], n)


@dataclass
class FileWritten(WriterCommitMessage):
    partition: int
    name: str
    documents: int
    ids: int


class IdsWriter(DataSourceArrowWriter):
    """Each task writes one file under a name of its own attempt; only files in the index, written on commit, count.

    Rows have ``ids``, or ``text`` if a tokenizer is given; a null of either is empty.
    """

    def __init__(self, path: str, tokenizer: str | None = None, spaced: bool = False, end_id: int | None = None):
        self.path, self.tokenizer, self.spaced = path, tokenizer, spaced
        self.end = b"" if end_id is None else struct.pack("<I", end_id)

    def ids_of(self, batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
        if self.tokenizer is None:
            for key, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                yield key, ids or b""
            return
        for part in sized_slices([batch], "text", 4_000_000):
            encoded = encoder(self.tokenizer, self.spaced).encode([t or "" for t in part.column("text").to_pylist()])
            for key, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                yield key, ids + self.end

    def write(self, iterator: Iterator[pa.RecordBatch]) -> FileWritten:
        context = TaskContext.get()
        partition = context.partitionId()
        name = f"part-{partition:06d}-{context.taskAttemptId()}.s8b"
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        keys, lengths, offsets, firsts, total, at = [], [], [], [], 0, len(MAGIC)
        waiting, held = [], 0
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(MAGIC)

            def flush(least: int) -> None:
                nonlocal waiting, held, at, total
                ids = np.concatenate(waiting) if waiting else np.zeros(0, "<u4")
                done = 0
                while len(ids) - done >= least and done < len(ids):
                    block = block_bytes(ids[done : done + BLOCK_IDS])
                    offsets.append(at)
                    firsts.append(total)
                    out.write(block)
                    at += len(block)
                    size = min(BLOCK_IDS, len(ids) - done)
                    total, done = total + size, done + size
                waiting, held = [ids[done:].copy()], len(ids) - done

            for batch in iterator:
                for key, ids in self.ids_of(batch):
                    values = np.frombuffer(ids, "<u4")
                    keys.append(key)
                    lengths.append(len(values))
                    waiting.append(values)
                    held += len(values)
                    if held >= 8 * BLOCK_IDS:
                        flush(BLOCK_IDS)
            flush(1)
            known = np.array([k is not None for k in keys], np.uint8)
            footer = (
                np.array(offsets, "<u8").tobytes() + np.array(firsts, "<u8").tobytes()
                + np.array([k or 0 for k in keys], "<i8").tobytes() + known.tobytes() + np.array(lengths, "<u8").tobytes()
            )
            out.write(footer + struct.pack("<4Q", at, len(offsets), len(keys), total) + MAGIC)
        return FileWritten(partition, name, len(keys), total)

    def commit(self, messages: list[FileWritten | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        files, before = [], 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            files.append({"name": m.name, "documents": m.documents, "ids": m.ids, "start": before})
            before += m.ids
        with system.open_output_stream(f"{root}/{INDEX}", compression=None) as out:
            out.write(json.dumps({"files": files, "ids": before}).encode())

    def abort(self, messages: list[FileWritten | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{root}/{m.name}")


class _IdsFile(InputPartition):
    def __init__(self, name: str, start: int):
        self.name, self.start = name, start


class IdsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        system, root = fs.FileSystem.from_uri(self.path)
        with system.open_input_stream(f"{root}/{INDEX}", compression=None) as stream:
            index = json.loads(stream.read())
        return [_IdsFile(f["name"], f["start"]) for f in index["files"] if f["documents"]] or [_IdsFile("", 0)]

    def read(self, partition: _IdsFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, root = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(f"{root}/{partition.name}") as file:
            for keys, starts, lengths, ids in documents_of(file):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([partition.start + s for s in starts], pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )


def documents_of(file, batch_ids: int = 500_000) -> Iterator[tuple[list, list, list, list]]:
    """Keys, starts, lengths and ids of the documents of one file, in order, some blocks at a time."""
    tail = 32 + len(MAGIC)
    file.seek(file.size() - tail)
    trailer = file.read(tail)
    if trailer[32:] != MAGIC:
        raise ValueError("not a file of token ids")
    at, n_blocks, n_docs, _ = struct.unpack("<4Q", trailer[:32])
    file.seek(at)
    footer = file.read(file.size() - tail - at)
    offsets = np.frombuffer(footer, "<u8", n_blocks)
    keys = np.frombuffer(footer, "<i8", n_docs, 16 * n_blocks)
    known = np.frombuffer(footer, np.uint8, n_docs, 16 * n_blocks + 8 * n_docs)
    lengths = np.frombuffer(footer, "<u8", n_docs, 16 * n_blocks + 9 * n_docs).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    block, have, have_from = 0, np.zeros(0, "<u4"), 0
    doc = 0
    while doc < n_docs:
        last = max(doc + 1, int(np.searchsorted(starts + lengths, starts[doc] + batch_ids, side="right")))
        until = int(starts[last - 1] + lengths[last - 1])
        parts = [have]
        got = have_from + len(have)
        while got < until:
            file.seek(int(offsets[block]))
            parts.append(block_values(file).astype("<u4"))
            got += len(parts[-1])
            block += 1
        have = np.concatenate(parts)
        cut = [have[int(s) - have_from : int(s + n) - have_from].tobytes() for s, n in zip(starts[doc:last], lengths[doc:last], strict=True)]
        names = [k if ok else None for k, ok in zip(keys[doc:last].tolist(), known[doc:last].tolist(), strict=True)]
        yield names, starts[doc:last].tolist(), lengths[doc:last].tolist(), cut
        have, have_from, doc = have[until - have_from :], until, last


class TokenIdsSource(DataSource):
    """``df.write.format("simple8b").mode("append").save(new_folder)`` and ``spark.read.format("simple8b").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "simple8b"

    def schema(self) -> str:
        return "doc_id bigint, start bigint, n_tokens bigint, ids binary"

    def reader(self, schema) -> IdsReader:
        return IdsReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> IdsWriter:
        end = self.options.get("endId")
        spaced = self.options.get("spaced", "false").lower() == "true"
        return IdsWriter(self.options["path"], self.options.get("tokenizer"), spaced, None if end is None else int(end))


def in_key_order(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ranges of ascending keys, null first; rows with equal keys go by a hash of their text, so that they can be split too."""
    tie = F.xxhash64(F.col(text).cast("string"))
    return documents.repartitionByRange(F.col(key), tie).sortWithinPartitions(F.col(key), tie)


def write_ids(rows: DataFrame, path: str, tokenizer: str | None = None, spaced: bool = False, end_id: int | None = None) -> str:
    """Write rows of ``doc_id`` and ``ids``, in their order, to a new folder.

    With a tokenizer the rows have ``text`` instead, which the writing task encodes, with the end id behind each document.
    """
    rows.sparkSession.dataSource.register(TokenIdsSource)
    path = path if ":" in path.split("/")[0] else f"file://{path}"
    options = {} if tokenizer is None else {"tokenizer": tokenizer, "spaced": str(spaced).lower(), **({} if end_id is None else {"endId": str(end_id)})}
    value = F.col("ids") if tokenizer is None else F.col("text").cast("string").alias("text")
    rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), value).write.format("simple8b").options(**options).mode("append").save(path)
    return path


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids`` of every document written."""
    spark.dataSource.register(TokenIdsSource)
    path = path if ":" in path.split("/")[0] else f"file://{path}"
    return spark.read.format("simple8b").load(path)
