"""Target-distribution importance resampling: array-scored weights, exact ranks by parallel sorting by regular sampling.

A text's features are its runs of one to three consecutive words, hashed into buckets. Bucket counts of the corpus and of the
target give each bucket an integer gain; a document's weight is the sum over its features, and seeded Gumbel noise turns the
highest scores into a draw without replacement. Words, hashes and weights are computed on whole Arrow buffers with numpy.

Ranking: every task sorts its rows into a run; rows at regular places of all runs give regular splitters; the segments between
them are exchanged, merged by a local sort, and prefix sums over the segment sizes make local places exact ranks.

Defined results: a null text has no words; a null key is hashed as the empty string and comes last among equal scores; rows
that repeat are scored and ranked each by itself; an empty corpus or target counts as zeros; other columns play no part. A
text of any length is read in pieces that end between words, so memory follows the piece, not the text.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import sized_slices, written

BUCKETS = 10_000
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
#: Sorted runs, and ranges they are dealt to. Regular samples are at most their square and their number again.
RUNS = 256
#: Bytes of text whose words are held at once.
PIECE = 2_000_000

_LETTERS = np.array([c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 128 for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Word lengths with a direct shift table; longer ones are shifted by powers of two.
_SHORT = 64


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 step by byte; shifts by 0 to 64 zero bytes and by powers of two, each as four tables by byte of the state."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    none = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    direct = [none]
    for _ in range(_SHORT):
        direct.append(step[direct[-1] & 255] ^ (direct[-1] >> np.uint32(8)))
    powers = [direct[1]]
    for _ in range(40):
        powers.append(_apply(powers[-1], powers[-1]))
    return step, np.array(direct), np.array(powers)


def _apply(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    return table[0][state & 255] ^ table[1][(state >> 8) & 255] ^ table[2][(state >> 16) & 255] ^ table[3][state >> 24]


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds to that of the text followed by ``length`` more bytes."""
    _, direct, powers = _tables()
    near = np.minimum(length, _SHORT)
    out = direct[near, 0, crc & 255] ^ direct[near, 1, (crc >> 8) & 255] ^ direct[near, 2, (crc >> 16) & 255] ^ direct[near, 3, crc >> 24]
    far = np.flatnonzero(length > _SHORT)
    if len(far):
        rest, state = length[far], crc[far]
        for bit in range(int(rest.max()).bit_length()):
            which = (rest >> bit) & 1 == 1
            state[which] = _apply(powers[bit], state[which])
        out[far] = state
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32, length in bytes and text number of every word of texts that lie end to end, ``A-Z`` taken as lower case."""
    data = _LOWER[data]
    inside = _LETTERS[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    length = end - start
    text = np.searchsorted(offsets, start, side="right") - 1
    step, _, _ = _tables()
    longest_first = np.argsort(-length, kind="stable")
    at, size = start[longest_first], length[longest_first]
    state = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for k in range(min(int(size[0]) if len(size) else 0, _SHORT)):
        n = np.searchsorted(-size, -k, side="left")  # words longer than k
        now = state[:n]
        state[:n] = step[(now ^ data[at[:n] + k]) & 255] ^ (now >> np.uint32(8))
    crc = np.empty(len(at), np.uint32)
    crc[longest_first] = ~state
    for i in np.flatnonzero(length > _SHORT):
        crc[i] = zlib.crc32(data[start[i] : end[i]])
    return crc, length, text


def run_buckets(crc: np.ndarray, length: np.ndarray, text: np.ndarray, seen: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and text numbers of all runs of one to three words that end after the first ``seen`` words."""
    spaced = shifted(np.full(len(crc), zlib.crc32(b" "), np.uint32), length) ^ crc
    buckets, texts, run = [crc[seen:] % BUCKETS], [text[seen:]], crc
    for n in (1, 2):
        run = shifted(run[:-1], length[n:] + 1) ^ spaced[n:]
        whole = text[n:] == text[: len(text) - n] if len(text) > n else np.zeros(0, bool)
        whole[: max(0, seen - n)] = False
        buckets.append(run[whole] % BUCKETS)
        texts.append(text[n:][whole])
    return np.concatenate(buckets), np.concatenate(texts)


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces that end between words; a longer word stays whole."""
    start = 0
    while start < len(data):
        end = start + PIECE
        while end < len(data):
            blank = np.flatnonzero(~_LETTERS[_LOWER[data[end : end + PIECE]]])
            end += int(blank[0]) if len(blank) else PIECE
            if len(blank):
                break
        yield data[start : min(end, len(data))]
        start = end


def text_buckets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Buckets, text numbers and number of words of one text, or of all texts at once if they are short."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if len(data) <= 2 * PIECE:
        crc, length, text = words_of(data, offsets)
        yield *run_buckets(crc, length, text), text
        return
    for i in range(len(texts)):
        crc, length = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for piece in _pieces(data[offsets[i] : offsets[i + 1]]):
            new, size, _ = words_of(piece, np.array([0, len(piece)]))
            seen = min(2, len(crc))
            crc, length = np.concatenate((crc[-2:], new)), np.concatenate((length[-2:], size))
            yield *run_buckets(crc, length, np.full(len(crc), i), seen), np.full(len(new), i)


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """Features of all texts by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in sized_slices(batches, "text", PIECE):
            for buckets, _, _ in text_buckets(batch.column(0)):
                total += np.bincount(buckets, minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    counted = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket int, n bigint")
    out = np.zeros(BUCKETS, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row for each bucket
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of each bucket's smoothed shares in the target and in the corpus."""
    of_corpus, of_target = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([
        math.floor(1000 * math.log((float(t) + 1) * of_corpus / ((float(s) + 1) * of_target))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
    ], np.int64)


def noise(key: int | None, seed: int = SEED) -> int:
    """Seeded Gumbel noise of a key in whole thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"


def scored(documents: DataFrame, gain: np.ndarray, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words, features, weight and score of every text."""
    exact = gain.astype(np.float64)  # sums of whole numbers below 2^53

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, "text", PIECE):
            n = batch.num_rows
            words, features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            for buckets, texts, word_texts in text_buckets(batch.column("text")):
                words += np.bincount(word_texts, minlength=n)
                features += np.bincount(texts, minlength=n)
                weight += np.bincount(texts, weights=exact[buckets], minlength=n)
            weight = weight.astype(np.int64)
            total = weight + np.array([noise(k, seed) for k in batch.column("doc_id").to_pylist()], np.int64)
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (words, features, weight, total))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight", "score"])

    rows = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(score, SCORED)


_PLACE = ("score", "doc_id", "n_features", "weight", "run", "place")


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("weight")]


def _sort_keys(columns: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Keys for ``lexsort`` of a total order: score descending, key with nulls last, then contents, run and place."""
    return [columns["place"], columns["run"], columns["weight"], columns["n_features"], columns["doc_id"], columns["null"], -columns["score"]]


def _columns(batch: pa.RecordBatch | pa.Table) -> dict[str, np.ndarray]:
    key = batch.column("doc_id")
    out = {n: np.asarray(batch.column(n)) for n in _PLACE if n != "doc_id"}
    return out | {"doc_id": np.asarray(key.fill_null(0)), "null": np.asarray(key.is_null()).astype(np.int8)}


def _numbered(rows: DataFrame, name: str, group: str | None = None) -> DataFrame:
    """Add the place of each row among its task's rows, or among those of its ``group`` that follow each other there."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, now, done = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            groups = np.asarray(batch.column(group)) if group else np.full(batch.num_rows, task)
            begin = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
            at = np.arange(batch.num_rows) - np.repeat(begin, np.diff(np.concatenate((begin, [batch.num_rows]))))
            if now == groups[0]:
                at[: begin[1] if len(begin) > 1 else None] += done
            now, done = groups[-1], int(at[-1]) + 1
            extra = [pa.array(at, pa.int64())] if group else [pa.array(groups, pa.int32()), pa.array(at, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *([name] if group else ["run", name])])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields]
    return rows.mapInArrow(number, ", ".join([*kinds, f"{name} bigint" if group else f"run int, {name} bigint"]))


def exact_ranks(rows: DataFrame, runs: int = RUNS) -> DataFrame:
    """The rows with ``rank`` 1, 2, 3 by score descending, then key; all tasks sort and merge their own share.

    ``rows`` is a written table, so its partitions do not change. No key is hot: run and place make every sort key unique, and
    a range holds at most about twice its even share.
    """
    runs = max(1, min(runs, rows.rdd.getNumPartitions()))
    placed = written(_numbered(rows.coalesce(runs).sortWithinPartitions(*_order()), "place"), "sorted-runs")
    n = placed.count()
    step = max(1, n // (runs * runs))
    samples = placed.filter(F.col("place") % step == 0).select(*_PLACE).toArrow()  # at most runs * (runs + 1) rows
    keys = _columns(samples)
    order = np.lexsort(_sort_keys(keys))
    chosen = order[[len(order) * i // runs for i in range(1, runs)]] if len(order) else order
    splitters = {k: v[chosen] for k, v in keys.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, many = _columns(batch), len(chosen)
            both = {k: np.concatenate((splitters[k], own[k])) for k in own}
            by = np.lexsort(_sort_keys(both))
            segment = np.empty(len(by), np.int32)
            segment[by] = np.cumsum(by < many)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment[many:], pa.int32())], names=[*batch.schema.names, "segment"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields]
    exchanged = placed.mapInArrow(deal, ", ".join([*kinds, "segment int"])).repartitionById(runs, "segment")
    merged = written(_numbered(exchanged.sortWithinPartitions("segment", *_order(), "run", "place"), "at", "segment"), "merged-segments")
    sizes = {r.segment: r["count"] for r in merged.groupBy("segment").count().collect()}  # at most one row for each range
    before = np.cumsum([0, *(sizes.get(i, 0) for i in range(runs - 1))]).tolist()
    place = F.get(F.array(*(F.lit(b).cast("bigint") for b in before)), F.col("segment"))
    return merged.withColumn("rank", place + F.col("at") + 1).select(*rows.columns, "rank")


def resample(
    documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, key: str = "doc_id",
    text: str = "text", target_text: str = "text",
) -> DataFrame:
    """Features, weight, score and rank of every document; rank is null for those not drawn.

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred (rounded down) are drawn.
    """
    gain = gains(bucket_counts(documents, text), bucket_counts(target, target_text))
    rows = written(scored(documents, gain, seed, key, text), "resample-scores")
    able = F.col("n_words") >= least_words
    quota = percent * rows.filter(able).count() // 100
    ranked = exact_ranks(rows.filter(able)).withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    return ranked.unionByName(rows.filter(~able).withColumn("rank", F.lit(None).cast("bigint")))


def drawn(documents: DataFrame, ranks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The drawn documents with all their columns; of rows that share a drawn key, all."""
    keys = ranks.filter("rank IS NOT NULL").select(F.col("doc_id").alias("key")).distinct()
    return documents.join(keys, documents[key].cast("bigint").eqNullSafe(keys["key"]), "left_semi")
