"""Concatenate and cut: documents become one run of token ids that is cut into windows of fixed length.

The first pass encodes each text and counts ids per partition. The prefix sums of the partition totals give every document
its place in the whole run, and the second pass cuts documents where a window ends. Only the totals, one number for each
partition, leave their task; no id does.

Defined results: a null or empty text is its end id alone; rows that repeat, and null keys, are packed each by itself; an empty
table has no pieces; other columns play no part.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import sized_slices, written
from kpiloom.llm.encoders import rank_encoder

WINDOW = 1024
#: Offsets of at most so many partitions are broadcast.
SENT_PARTITIONS = 1_000_000
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def encoded_partitions(documents: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """First pass: ids of each document with the end id, its partition and the ids before it in that partition."""
    end = struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, before = TaskContext.get().partitionId(), 0
        for batch in sized_slices(batches, "text", 1_000_000):
            ids = [i + end for i in rank_encoder(tokenizer).encode([t or "" for t in batch.column("text").to_pylist()])]
            starts, sizes = [], [len(i) // 4 for i in ids]
            for n in sizes:
                starts.append(before)
                before += n
            n = batch.num_rows
            columns = [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array([partition] * n, pa.int32()), pa.array(starts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "doc_tokens", "part", "in_part"])

    rows = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id bigint, ids binary, doc_tokens bigint, part int, in_part bigint")


def pack(documents: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of ``window`` ids; only the last sequence can be shorter.

    Each piece is a boundary record: its document, its start there, its length, its sequence and offset there, with the ids.
    Documents follow each other in the order of the table's partitions; null texts are empty and consist of the end id. The
    encoded table is written once, so both passes see the same partitions even if executors are lost. ``tokenizer`` is a byte-level
    vocabulary whose ids are its merge ranks.
    """
    encoded = written(encoded_partitions(documents, tokenizer, end_id, key, text), "packed-ids")
    totals = encoded.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect()  # one row for each partition
    before = list(accumulate((r.n for r in totals), initial=0))[:-1]
    offsets = documents.sparkSession.createDataFrame([(r.part, b) for r, b in zip(totals, before, strict=True)], "part int, before bigint")
    # two numbers for each partition of the table, sent to all tasks unless there are more than a million
    offsets = F.broadcast(offsets) if len(totals) <= SENT_PARTITIONS else offsets
    placed = encoded.join(offsets, "part").withColumn("_at", F.col("before") + F.col("in_part"))
    last = F.col("_at") + F.col("doc_tokens") - 1
    windows = F.sequence(F.floor(F.col("_at") / window), F.floor(last / window))
    cut = placed.select("doc_id", "ids", "doc_tokens", "_at", F.explode(windows).alias("sequence_id"))
    begin = F.greatest(F.col("_at"), F.col("sequence_id") * window)
    stop = F.least(F.col("_at") + F.col("doc_tokens"), (F.col("sequence_id") + 1) * window)
    cut = cut.withColumns({"start": begin - F.col("_at"), "length": stop - begin, "offset": begin - F.col("sequence_id") * window})
    cut = cut.withColumn("ids", F.expr("substring(ids, int(start * 4 + 1), int(length * 4))"))
    return cut.withColumn("ids_crc32", F.crc32("ids")).select(*[c.split()[0] for c in PIECES.split(", ")])


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: at most a window of ids each, joined from their pieces by offset."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), ""))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_ids"))
