"""Importance resampling, hard negatives and fingerprints against plain Python on odd rows and small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kpiloom.llm import negatives, parsing, queries, resample

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", "  .,", "One", "İé x—y 字字 A_b9", "w" * 300 + " z", "tie tie " * 30, "tie tie " * 30, ("long" * 40 + " and short ") * 60, "x y z " * 4000]
#: Columns whose names the operators use themselves.
CLASHING = "doc_id bigint, text string, rank string, score string, run string, segment string, n_words string, part string, task string, hash string, id string, key string"


def odd_documents(spark, texts=ODD):
    rows = [(i if i != 2 else None, t, *["c"] * 10) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[-1:]], CLASHING)


def features(text):
    words = WORDS.findall((text or "").translate(LOWER))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampled(documents, targets, percent=5, least=20):
    counts = [Counter(b for t in texts for b in features(t)[1]) for texts in ([t for _, t in documents], targets)]
    own, wanted = (sum(c.values()) + 10_000 for c in counts)
    out = []
    for key, text in documents:
        words, buckets = features(text)
        weight = sum(math.floor(1000 * math.log((counts[1][b] + 1) * own / ((counts[0][b] + 1) * wanted))) for b in buckets)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ é9_.字", max_size=90), max_size=6), st.integers(5, 60))
def test_buckets_equal_crc_of_joined_words(texts, piece):
    wanted = Counter((i, b) for i, t in enumerate(texts) for b in features(t)[1])
    before = resample.PIECE
    try:
        for resample.PIECE in (before, piece):  # whole batches, and each text cut into pieces
            got = Counter()
            for buckets, of, _ in resample.text_buckets(pa.array(texts, pa.string())):
                got.update(zip(of.tolist(), buckets.tolist(), strict=True))
            assert got == wanted
    finally:
        resample.PIECE = before


def test_resample_equals_brute_force(spark):
    documents = odd_documents(spark)
    target = spark.createDataFrame([("tie Tie x y",), (None,)], "text string")
    got = resample.resample(documents, target, percent=50, least_words=2)
    wanted = resampled([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()], ["tie Tie x y"], 50, 2)
    rows = got.select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, rows), key=repr) == wanted
    chosen = {r.doc_id for r in rows if r.rank is not None}
    assert {r.doc_id for r in resample.drawn(documents, got).collect()} == chosen
    assert resample.drawn(documents, got).columns == documents.columns


def test_resample_of_empty_tables(spark):
    documents, target = odd_documents(spark).limit(0), spark.createDataFrame([], "text string")
    assert resample.resample(documents, target).count() == 0
    assert resample.resample(odd_documents(spark), target).filter("rank IS NOT NULL").count() == 0  # five in a hundred of few


def test_ranks_are_exact_for_ties_in_any_partitioning(spark):
    rows = spark.range(3000).select(
        (F.col("id") % 1000).alias("doc_id"), F.lit(30).cast("bigint").alias("n_words"), F.col("id").alias("n_features"), F.lit(0).cast("bigint").alias("weight"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("bigint").alias("score"),
    )
    wanted = sorted(((r.score, r.doc_id, r.n_features) for r in rows.collect()), key=lambda r: (-r[0], r[1], r[2]))
    for parts, runs in ((1, 8), (7, 3), (16, 16)):
        stored = resample.written(rows.repartition(parts), "rank-test")
        got = sorted((r.rank, (r.score, r.doc_id, r.n_features)) for r in resample.exact_ranks(stored, runs).collect())
        assert got == list(enumerate(wanted, 1))


def mined(rows, anchor_every=100, positives=5, count=10):
    """All windows of all anchors by sorting all rows."""
    out = []
    for anchor, label, vector in rows:
        if anchor % anchor_every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(vector, v)), i, k) for i, k, v in rows if i != anchor), key=lambda r: r[:2])
        for p, pid, _ in [r for r in scored if r[2] == label][:positives]:
            inside = [r for r in scored if r[2] != label and 30 * -p <= 100 * -r[0] <= 90 * -p]
            out += [(anchor, pid, rank, nid, -p, -n) for rank, (n, nid, _) in enumerate(inside[:count], 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [1, 3, 2**29])
def test_negatives_equal_brute_force(spark, spread):
    random.seed(spread)
    rows = [(i * 10, random.randrange(3), [random.randint(-spread, spread) / 256 for _ in range(random.choice([3, 3, 4]))]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").repartition(5)
    part = negatives.taking_part(df)
    got = negatives.mine(part, part.filter("id % 100 = 0"), block_bytes=8 * 4 * 5)  # several blocks of anchors
    whole = [(i, k, [math.floor(256 * x) for x in v]) for i, k, v in rows]
    wanted = mined(whole)
    assert sorted(map(tuple, got.collect())) == wanted and (spread != 1 or any(r[4] == 0 for r in wanted))


def test_negatives_of_odd_rows(spark):
    rows = [
        (0, 1, [1.0, 1.0], "c"), (1, 1, [1.0, 0.5], "c"), (1, 1, [1.0, 0.5], "c"), (2, 2, [0.5, 0.5], "c"), (3, 2, None, "c"), (4, None, [1.0, 1.0], "c"),
        (None, 2, [0.5, 0.5], "c"), (5, 2, [float("nan"), 1.0], "c"), (6, 2, [None, 1.0], "c"), (7, 2, [float("inf"), 1.0], "c"), (8, 2, [], "c"), (9, 2, [0.9], "c"), (0, 2, [0.5, 0.5], "c"),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>, id string").select("*", F.lit(1).alias("vector"), F.lit(2).alias("same"))
    part = negatives.taking_part(df)
    got = sorted(map(tuple, negatives.mine(part, part.filter("id = 0")).collect()))
    positive = 256 * 256 + 256 * 128
    assert got == [(0, 1, 1, 2, positive, 2 * 256 * 128)] * 2 + [(0, 1, 2, 9, positive, 256 * 230)] * 2  # both rows of id 1 are positives
    assert negatives.mine(part.limit(0), part.limit(0)).count() == 0
    with pytest.raises(ValueError):
        negatives.mine(part, part, low=50, high=100)


def slow_level(names):
    """One level of locally consistent parsing of one text, symbol by symbol."""
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def join(parts, start):
        for p in parts:
            start = mix((start * 0x9E3779B97F4A7C15 + p) & mask)
        return start

    folded, i = [], 0
    while i < len(names):
        j = i
        while j < len(names) and names[j] == names[i]:
            j += 1
        folded.append(names[i] if j == i + 1 else join([j - i], names[i]))
        i = j
    colours = folded
    for _ in range(4):
        out = []
        for k, c in enumerate(colours):
            differs = c ^ colours[k - 1] if k else 1
            place = (differs & -differs).bit_length() - 1
            out.append(2 * place + (c >> place & 1))
        colours = out
    for colour in (5, 4, 3):
        colours = [
            min({0, 1, 2} - {*colours[max(0, k - 1) : k], *colours[k + 1 : k + 2]}) if c == colour else c for k, c in enumerate(colours)
        ]
    starts = [0] + [k for k in range(2, len(colours)) if colours[k] > colours[k - 1] and (k + 1 == len(colours) or colours[k] > colours[k + 1])]
    return [join(folded[a:b], b - a) for a, b in zip(starts, [*starts[1:], len(folded)])] if folded else []


def slow_fingerprint(text):
    names, out = list(text.encode()), []
    for level in range(1, 6):
        names = slow_level(names)
        if level in parsing.LEVELS:
            out.append(sorted({n >> 32 for n in names})[: parsing.NAMES])
    return ":".join("".join(f"{n:08x}" for n in level) for level in out) if any(out) else ""


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="ab", max_size=80), st.text(max_size=60)), max_size=5))
def test_fingerprints_equal_symbol_by_symbol_parsing(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [parsing.as_string(f) for f in parsing.fingerprints_of(texts)] == [slow_fingerprint(t) for t in texts]


def test_fingerprints_do_not_depend_on_stretches(monkeypatch):
    random.seed(3)
    text = "".join(random.choice("abcd efg") for _ in range(20_000)) + "z" * 5000
    whole = parsing.fingerprints_of([text])
    monkeypatch.setattr(parsing, "STRETCH", 97)
    assert parsing.as_string(parsing.fingerprints_of([text])[0]) == parsing.as_string(whole[0])


def test_equal_substrings_share_interior_names():
    random.seed(4)
    text = "".join(random.choice("abcdefgh ") for _ in range(30_000))
    for cut in (1, 7, 1000):
        sets = []
        for t in (text, "xy" + text[cut:]):
            data = np.frombuffer(t.encode(), np.uint8)
            sets.append(set(next(parsing.parsed(data, np.array([0, len(data)]), (3,)))[0].tolist()))
        assert len(sets[1] - sets[0]) <= 8  # only around the cut


def test_compared_documents_equal_brute_force(spark):
    documents = odd_documents(spark)
    got = parsing.compared_with_edits(documents).collect()
    order = sorted(
        (tuple(r) for r in documents.select("doc_id", "text", F.xxhash64("text")).collect()),
        key=lambda r: (r[0] is None, -(r[0] or 0), r[2], r[1] or ""),
    )
    wanted = []
    for (key, text, _), (_, following, _) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        edited = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        prints = [slow_fingerprint(t) for t in (text, edited, following)]
        names = [parsing.as_names(p) for p in prints]
        wanted.append((
            key, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1],
            parsing.likeness(names[0], names[1]), parsing.likeness(names[0], names[2]),
        ))
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)
    assert parsing.compared_with_edits(documents.limit(0)).count() == 0
    alone = parsing.compared_with_edits(documents.filter("doc_id = 3")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert {r.fingerprint for r in parsing.fingerprint(documents).collect()} == {slow_fingerprint(t or "") for t in ODD}


def test_likeness_tells_edits_from_other_texts(spark):
    rows = [r for r in queries.op13_fingerprints(spark, FOLDER).collect() if r.n_chars >= 200]
    assert np.mean([r.near_edited for r in rows]) > 0.35 and np.mean([r.near_next for r in rows]) < 0.1
