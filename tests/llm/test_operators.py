"""The training-data operators against brute force and round trips, on hand-made edge cases and the smallest tables."""

import hashlib
import math
import os
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kpiloom.llm import chat, counts, decontam, minwise, mixing, packing, pii, quality, queries, simple8b, warc
from kpiloom.llm.common import SHUFFLES_REMOVED, shared_path, written
from kpiloom.llm.encoders import CachedEncoder, RankEncoder
from workload import Query
from workload.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    None, "", " ", "one", "a  b\tc\n\nd ", "don't <|endoftext|> x<|ENDOFTEXT|>! \x00 a\x00b", "é́ x ́y İSTANBUL ΣΑΣ ²! x́!", "字かな①" * 40,
    "word " * 3000, "x" * 3000, "a b c d e f g h", "a b c d e f g h", "<|im_end|><|im_start|>assistant <\\| \\n", " lead trail \x1c y",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Edge cases with null and repeated keys and columns whose names operators use themselves."""
    rows = [(i if i != 3 else None, t, "s", i, "row") for i, t in enumerate(ODD)] + [(1, "", "s", 0, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n bigint, ids string")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


def test_sql_queries_match(spark):
    con = connect(FOLDER)
    for name, sql in queries.SQL.items():
        outcome, detail = compare(spark, con, FOLDER, Query(queries.QUERIES[name], sql))
        assert outcome == "exact", (name, detail)


@pytest.mark.parametrize(("path", "spaced"), [(WORD, False), (BYTE, True)])
def test_cached_encoder_equals_library(path, spaced):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(path), CachedEncoder(path, spaced, pieces=20, stems=20)
    texts = [t or "" for t in ODD] + pq.read_table(f"{FOLDER}/documents.parquet")["text"].to_pylist()[:40]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab, .\n'<|>é1", max_size=60))
def test_cached_encoder_equals_library_on_any_text(text):
    from tokenizers import Tokenizer

    global _TOKENIZERS
    try:
        pairs = _TOKENIZERS
    except NameError:
        pairs = _TOKENIZERS = [(Tokenizer.from_file(p), CachedEncoder(p, s)) for p, s in ((WORD, False), (BYTE, True))]
    for library, own in pairs:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_chat_parts_become_placeholders_and_texts_come_back(spark):
    parts = [
        ("text", "see <|im_end|> and <\\|", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None),
        ("audio", None, "b.wav", None, None, 1.0, None), ("document", None, "c.pdf", None, None, None, 2), ("odd|kind", None, "d", None, None, None, None), None,
    ]
    df = spark.createDataFrame([(1, 0, "user\nx", parts), (1, 1, None, None)], f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    first, second = chat.format_messages(df, F.col("parts")).orderBy("turn").collect()
    assert [(a.ordinal, a.type, a.ref, a.tokens) for a in first.attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 13), (2, "document", "c.pdf", 1024), (3, "odd|kind", "d", 0)]
    assert first.expanded_tokens == 1041 and second.expanded_tokens == 0
    assert chat.parse_message(first.formatted) == ("user\nx", "see <|im_end|> and <\\|<|image:0|><|audio:1|><|document:2|><|odd_kind:3|>")
    assert first.loss_length == 0 and chat.parse_message(second.formatted) == ("", "")


def test_chat_edge_rows(odd, nothing):
    turns = odd.select(F.lit(5).alias("conv_id"), F.col("n").alias("turn"), F.lit("assistant").alias("role"), "text")
    row = chat.conversation_digests(chat.format_messages(turns, chat.text_part(F.col("text")))).first()
    assert row.n_turns == len(ODD) + 1 and row.loss_chars == sum(len(t or "") for t in ODD)
    empty = nothing.select(F.lit(5).alias("conv_id"), F.col("n").alias("turn"), F.lit("user").alias("role"), "text")
    assert chat.conversation_digests(chat.format_messages(empty, chat.text_part(F.col("text")))).count() == 0


def test_warc_round_trip_and_pushdown(spark):
    long = "é" * 60
    pages = spark.createDataFrame([(3, "u v\r\n", long), (1, "u", long), (2, None, "short"), (4, "u", "short"), (None, "u", long), (5, "u", None)], "page_id bigint, url string, html string")
    path = shared_path(pages, "warc-test")
    warc.write_archives(pages, path, records_per_file=2)
    rows = {(warc_id(r.record_id), r.record_type, r.payload_length, warc_id(r.refers_to)) for r in warc.read_archives(spark, path).collect()}
    assert rows == {("3", "revisit", 120, "1"), ("1", "response", 120, None), ("2", "response", 5, None), ("4", "response", 5, None), ("", "revisit", 120, "1"), ("5", "response", 0, None)}
    revisits = warc.read_archives(spark, path, payload=False).filter("record_type = 'revisit' AND target_uri LIKE 'u%'")
    assert revisits.count() == 2 and not re.search(r"\bFilter\b", revisits._jdf.queryExecution().executedPlan().toString())  # all of it is pushed down


def warc_id(urn):
    return urn and re.fullmatch("<urn:page:(.*)>", urn)[1]


def test_token_counts_splice_exactly():
    counter = counts.ResyncCounter(PIECE, chunk=120, overlap=8)
    texts = [t or "" for t in ODD] + ["a" * 700, " " * 500, "a b  c   " * 80, "▁" * 300] + pq.read_table(f"{FOLDER}/documents.parquet")["text"].to_pylist()[:30]
    assert counter.counts(texts) == [len(counter.model.encode(t)) for t in texts]
    assert counter.widened > 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(values):
    array = np.array(values, np.uint64)
    words, escapes = simple8b.pack(array)
    assert simple8b.unpack(words, escapes, len(array)).tolist() == values


def test_token_ids_come_back_in_order(spark, odd, nothing):
    from tokenizers import Tokenizer

    path = simple8b.write_ids(simple8b.in_key_order(odd), shared_path(odd, "ids-test"), WORD, end_id=2)
    rows = simple8b.read_ids(spark, path).orderBy("start").collect()
    library = Tokenizer.from_file(WORD)
    wanted = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids) + (2,)) for r in odd.collect())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == wanted
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows[:-1]]).tolist()
    keys = [r.doc_id for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert simple8b.read_ids(spark, simple8b.write_ids(simple8b.in_key_order(nothing), shared_path(odd, "ids-test"), WORD, end_id=2)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab 1'\n\té字<|>"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_rank_encoder_equals_library(text):
    from tokenizers import Tokenizer

    global _BYTES
    try:
        library, own = _BYTES
    except NameError:
        library, own = _BYTES = Tokenizer.from_file(BYTE), RankEncoder(BYTE)
    for t in (text, text + "<|endoftext|>" + text, "we'll " + text * 3):
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_rank_encoder_takes_odd_texts_and_merge_ranks_only():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(BYTE), RankEncoder(BYTE)
    texts = [t or "" for t in ODD] + [" " * 50_000, "x" * 100_000, "\n" * 20_000 + "a"] + pq.read_table(f"{FOLDER}/documents.parquet")["text"].to_pylist()
    for text, ids in zip([t or "" for t in texts], own.encode([t or "" for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    with pytest.raises((ValueError, KeyError)):
        RankEncoder(WORD)


@pytest.mark.parametrize("window", [64, 1024])
def test_packing_equals_brute_force(odd, nothing, window):
    """Every column of every piece follows from the pieces' order in the whole run and the library's ids."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    ids = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids) + (0,)) for r in odd.collect())
    pieces = sorted(packing.pack(odd, BYTE, end_id=0, window=window).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert [(p.sequence_id * window + p.offset) for p in pieces] == np.cumsum([0, *(p.length for p in pieces[:-1])]).tolist()
    assert all(p.length > 0 and p.offset + p.length <= window for p in pieces)
    found, now = Counter(), []
    for p in pieces:
        own = np.frombuffer(p.ids, "<u4").tolist()
        assert p.start == len(now) and p.length == len(own) and p.ids_crc32 == zlib.crc32(bytes(p.ids))
        now += own
        if len(now) == p.doc_tokens:
            found[p.doc_id, tuple(now)] += 1
            now = []
    assert found == ids and not now
    assert packing.pack(nothing, BYTE, end_id=0).count() == 0


def test_near_duplicates_equal_brute_force(spark, odd, nothing):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for family in range(6):
        source = list(rng.choice(words, 60))
        for copy in range(9):
            own = list(source)
            for at in rng.integers(0, 60, copy % 4):
                own[at] = "edit" + str(rng.integers(0, 50))
            texts[len(texts)] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in minwise.near_duplicates(df).collect()}
    sets = {i: {tuple(w) for w in zip(*(t.split()[k:] for k in range(4)), strict=False)} for i, t in texts.items()}
    parent = {i: i for i in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    parent[a] = parent[b] = min(parent[a], parent[b])
    assert {i: r.component_id for i, r in got.items()} == parent
    assert all(got[i].n_shingles == len(s) for i, s in sets.items())
    rows = minwise.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) + 1 and {r.doc_id for r in rows if not r.kept} == {11}
    assert minwise.near_duplicates(nothing).count() == 0


def test_near_duplicates_in_a_group_that_shares_a_passage(spark):
    passage, rows = [f"p{i}" for i in range(180)], []
    for pair in range(200):
        for side in (0, 1):
            rows.append((2 * pair + side, passage + [f"o{pair}_{i}" if i < 8 else f"o{pair}_{side}_{i}" for i in range(30)]))
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for _, w in rows]
    linked = [(a, b) for b in range(400) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert linked == [(2 * p, 2 * p + 1) for p in range(200)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    found = minwise.near_duplicates(df).filter("NOT kept").select("component_id", "doc_id").collect()
    assert {tuple(r) for r in found} <= set(linked) and len(found) >= 199


def test_written_tables_leave_no_shuffle_files(spark):
    def shuffles():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f for f in files if "/shuffle_" in f}

    before, own = shuffles(), spark.conf.get(SHUFFLES_REMOVED, None)
    rows = written(spark.range(5000).repartition(7, "id"), "shuffled")
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert spark.conf.get(SHUFFLES_REMOVED, None) == own
    assert rows.count() == rows.distinct().count() == 5000


def test_near_duplicates_judge_a_pair_once(spark, monkeypatch):
    passage, seen, confirmed = [f"p{i}" for i in range(120)], [], minwise._confirmed
    rows = [(i, " ".join([*passage, *(f"o{i // 2}_{i if k > 3 else 0}_{k}" for k in range(24))])) for i in range(160)]

    def recording(pairs, *rest):
        seen.extend(tuple(r) for r in pairs.select("a", "b").collect())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(minwise, "_confirmed", recording)
    minwise.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), trees=3).count()
    assert seen and len(seen) == len(set(seen))


def test_pipeline_takes_five_words_a_shingle(spark):
    import corpus_pipeline

    first = [f"w{i}" for i in range(200)]
    second = [f"x{i}" if i in (20, 60, 100, 140, 180) else w for i, w in enumerate(first)]

    def similarity(k):
        a, b = ({tuple(t[i : i + k]) for i in range(len(t) - k + 1)} for t in (first, second))
        return len(a & b) / len(a | b)

    assert similarity(4) > 0.8 > similarity(5)
    df = spark.createDataFrame([(1, " ".join(first)), (2, " ".join(second)), (3, " ".join(second).upper())], "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, FOLDER).collect()} == {1, 2}
    assert {r.doc_id for r in minwise.near_duplicates(df, shingle=4).filter("kept").collect()} == {1}


def test_quality_counts_and_monotone_trees(spark, odd, nothing):
    words = "a b c d e f a b c d e x".encode().split()
    assert quality.repeated_words(words) == 10
    (n, chars, symbols, dup, repeated), _ = quality.document_statistics("x #1\n\nx #1\n é")
    assert (n, chars, symbols, dup, repeated) == (5, 7, 2, 1, 0)
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(600) < 0.1)).astype(float)
    trees = quality.BoostedTrees([-1, 0, 0]).fit(x, y)
    line = np.column_stack((np.linspace(0, 1, 50), np.full(50, 0.4), np.full(50, 0.6)))
    assert (np.diff(trees.score(line)) <= 1e-12).all() and ((trees.score(x) > 0.5) == (y > 0)).mean() > 0.85
    labels = spark.createDataFrame([(10, 1, 0), (8, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score(odd, quality.fit(odd, labels))
    assert got.count() == len(ODD) + 1 and got.filter("n_words < 10 AND kept").count() == 0
    assert quality.score(nothing, quality.fit(nothing, labels.limit(0))).count() == 0


def brute_quality(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    lines = [line for line in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", line)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = sum(any(windows[tuple(words[j : j + 5])] > 1 for j in range(max(0, i - 4), min(i, len(words) - 5) + 1)) for i in range(len(words)))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeated, n < 10 or 100 * repeated > 20 * n


def test_quality_counts_equal_brute_force(spark, odd):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    trees = quality.fit(documents, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    got = quality.score(documents, trees).collect()
    wanted = Counter((r.doc_id, *brute_quality(r.text)) for r in documents.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == wanted
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)


def test_quality_sample_bounds_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.BoostedTrees, "fit", lambda self, x, y: seen.append(len(x)) or self)
    documents = spark.range(500).select((F.col("id") % 5).alias("doc_id"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"))
    quality.fit(documents, spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id bigint, quality int"), sample=3)
    assert seen == [3]


def test_quality_held_out_accuracy(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.fit(documents, labels.filter("doc_id % 2 = 0"))
    both = quality.score(documents, trees).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("NOT base_failed").toPandas()
    assert (both.kept == (both.quality == 1)).mean() > 0.95


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits[::-1])) % 10 == 0
            ok = {"email": True, "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}
            if ok[kind]:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(found)


def test_pii_discovers_by_labels_and_in_two_hops(spark):
    texts = {
        1: 'login token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ok', 2: 'token = "aaaabbbbccccddddeeeeffff0000111122223333" then',
        3: 'x = "55556666777788889999" y',  # behind the pattern that labels induce: digits only
        4: "zorg 55556666777788889999 a", 5: "zorg aaaabbbbccccddddeeeeffff0000111122223333 b", 6: "zorg DE89370400440532013000 c",  # second hop
        7: "the year 123456789 and part ab1234567 of it", 8: "at a@b.co", 9: "at c@d.co", 10: "at 482910384" + " w" * 100, 11: None, 12: "",
        13: "iban:" + " " * 90 + "'XX12345678'", 14: "at" + " " * 200 + "123-45-6789",
    }
    rows = [(i, t, "s", "d", "h") for i, t in texts.items()] + [(7, texts[7], "s", "d", "h"), (None, texts[1], "s", "d", "h")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _spans string, _discovered string, _hash string")
    found = pii.find(df)
    assert found.columns[:-2] == df.columns and found.count() == len(rows)
    values = {r["doc_id"]: {s["value"] for s in r[len(df.columns) + 1]} for r in found.collect()}
    assert {k: v for k, v in values.items() if v} == {
        None: {"04dbebab91ab85687d33eeaaf9ac699e1188f962"}, 1: {"04dbebab91ab85687d33eeaaf9ac699e1188f962"}, 2: {"aaaabbbbccccddddeeeeffff0000111122223333"},
        3: {"55556666777788889999"}, 4: {"55556666777788889999"}, 5: {"aaaabbbbccccddddeeeeffff0000111122223333"}, 6: {"DE89370400440532013000"},
        10: {"482910384"}, 14: {"123-45-6789"},
    }
    clean = {r.doc_id: r for r in pii.redact(found).collect()}
    assert clean[6].text == "zorg [ID] c" and clean[7].text == texts[7] and clean[6]["_spans"] == "s" and clean[11].text is None


def test_pii_finds_planted_tokens_only(spark):
    found = pii.find(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("text", "_discovered").collect()
    planted = re.compile(r'(?i)token = "([0-9a-f]{40})"')
    wanted = [set(planted.findall(r.text or "")) for r in found]
    got = [{s["value"] for s in r["_discovered"]} for r in found]
    assert sum(map(len, wanted)) > 5 and got == wanted


def test_pii_equals_brute_force_and_discovers(spark, nothing):
    texts = [
        "a@b.c@d.e %x@f.g.h a@b-c.d%e@f.g", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111 4111111111111112", "+1 (234) 555-1234 +49 30 1234567. ++1 2",
        "é@b.c éé x@y.zz 🙂 a@b.co", "", None, "a@b.c " * 600, "1" * 20000, "ref: k@l.mn x", "ref: o@p.qr y", "ref: user77812x z", "the user77812x",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = pii.find(df)
    rows = {r.doc_id: r for r in pii.report(found).collect()}
    for i, text in enumerate(texts):
        assert rows[i].base_sha256 == hashlib.sha256(brute_spans(text or "").encode()).hexdigest(), text
    assert rows[11].spans == "id:5:15" and rows[12].spans == ""
    clean = {r.doc_id: r.text for r in pii.redact(found).collect()}
    assert clean[9] == "ref: [EMAIL] x" and clean[11] == "ref: [ID] z" and clean[12] == texts[12] and clean[6] is None
    assert pii.report(pii.find(nothing)).count() == 0


def test_decontamination_within_and_beyond_the_budget(spark, odd, nothing):
    item = "the quick brown fox jumps over the lazy dog while twelve grey geese watch quietly from the old stone bridge"
    near, far = item.replace("quick", "quack").replace("geese", "gese"), " ".join(reversed(item.split()))
    docs = spark.createDataFrame([(0, "intro " * 40 + item.upper() + "! tail"), (1, near), (2, far), (3, None), (4, "tiny item, here"), (4, "")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item), (8, "Tiny item"), (9, None), (10, ""), (11, item)], "item_id bigint, text string")
    for block in (16_000_000, 60):
        got = Counter((r.doc_id, tuple(r["items"]), r.fewest_edits) for r in decontam.contamination(docs, bench, block_bytes=block).collect())
        assert got == Counter({(0, (7, 11), 0): 1, (1, (7, 11), 2): 1, (2, (), None): 1, (3, (), None): 1, (4, (8,), 0): 1, (4, (), None): 1})
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {2, 3, 4}
    assert decontam.contamination(nothing, bench).count() == 0 and decontam.clean(odd, bench.limit(0)).count() == len(ODD) + 1


def test_decontamination_searches_many_blocks_in_one_pass(spark):
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel"]
    items = [" ".join(words[(i * s + s * s) % 8] for i in range(20)) for s in range(1, 8)]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(items)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, items[3]), (50, items[3]), (50, items[3])], "item_id bigint, text string")
    got = decontam.contamination(docs, bench, block_bytes=200)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # a Python worker and an index for each block before
    wanted = decontam.contamination(docs, bench)
    rows = {r.doc_id: r for r in got.collect()}
    assert rows == {r.doc_id: r for r in wanted.collect()}
    assert rows[3]["items"][-2:] == [50, None] and all(r.fewest_edits == 0 and r.doc_id in r["items"] for r in rows.values())


def test_pipeline_stage_cleans_by_a_benchmark_of_many_blocks(spark):
    items = [" ".join(f"{w}{i}" for w in ("stone", "river", "cloud", "meadow", "harbour", "lantern")) for i in range(8)]
    docs = spark.createDataFrame([(i, f"see {t}.", "s") for i, t in enumerate([*items[::2], "nothing of it", None])], "doc_id bigint, text string, source string")
    bench = spark.createDataFrame([(None if i % 4 else i, t) for i, t in enumerate(items)] * 3, "item_id bigint, text string")
    kept = decontam.clean(docs, bench, block_bytes=150)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # a Python worker and an index for each block before
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {4, 5}


@pytest.mark.parametrize("small", [False, True])
def test_decontamination_counts_common_qgrams_in_bounded_memory(monkeypatch, small):
    if small:
        for name, value in (("COMMON", 1), ("PART", 400), ("WINDOW", 900), ("CELLS", 300), ("POSTINGS", 50)):
            monkeypatch.setattr(decontam, name, value)
    rng = np.random.default_rng(4)
    words = ["of", "the", "sea", "and", "old", "stone", "bridge", "in", "a", "long", "night"]
    items = [" ".join(words[j] for j in rng.integers(0, len(words), 24)) for _ in range(60)]

    def edited(text, n):
        for at in rng.integers(0, len(text), n).tolist():
            text = text[:at] + "qz"[at % 2] + text[at + at % 3 :]
        return text

    texts = [decontam.normal(" ".join(edited(items[j], n) for j in rng.integers(0, 60, 12))) for n in (0, 2, 5, 9)] + [b"", b"of the " * 300]
    index = decontam.build([([i], t) for i, t in enumerate(items)])
    assert (index.least < index.need).any()
    wanted = set()
    for t, text in enumerate(texts):
        for i, item in enumerate(index.items):
            edits = decontam.edits_within(item, text, decontam.budget(len(item)))
            if edits is not None:
                wanted.add((t, i, edits))
    assert set(decontam.search(index, texts)) == wanted and len(wanted) > 20


def test_language_model_base_and_probabilities(spark, odd, nothing):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").union(odd.select(F.col("doc_id") + 10_000, "text"))
    got = mixing.score(docs, mixing.train(docs)).collect()
    rows = [(r.doc_id, mixing.words_of(r.text or "") + [None]) for r in docs.collect()]
    held = lambda k: zlib.crc32(str(k).encode() if k is not None else b"") % 7 == 2
    seen = Counter(w for k, words in rows if not held(k) for w in words)
    n, v = sum(seen.values()), len(seen)
    wanted = Counter((k, len(w), sum(seen[x] > 0 for x in w), n, held(k), round(sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w), 6)) for k, w in rows)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.held_out, round(r.base_score, 6)) for r in got) == wanted
    assert all(r.score < 0 for r in got)
    outside = [r.bits_per_byte for r in got if r.held_out and r.n_tokens > 50]
    assert np.median(outside) < 3.5  # uniform bytes have 8
    assert mixing.score(nothing, mixing.train(nothing)).count() == 0


def test_language_model_learns_words_from_the_two_before(spark):
    texts = [("red big cat", 60), ("blue big cow", 60), ("red big cow", 30), ("blue big cat", 30)]
    keys = [k for k in range(2000) if zlib.crc32(str(k).encode()) % 7 != 2]
    held = [k for k in range(2000) if zlib.crc32(str(k).encode()) % 7 == 2]
    train = [(keys.pop(), t) for t, n in texts[:2] for _ in range(n)]
    asked = [(held[i], t) for i, (t, _) in enumerate(texts)]
    docs = spark.createDataFrame(train + asked, "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in mixing.score(docs, mixing.train(docs)).collect()}
    by_text = {t: got[k] for k, t in asked}
    tokens, types = 120 * 4, 6  # the end of a text is a token

    def refined(n, total, kinds, lower):
        return (n + kinds * lower) / (total + kinds)

    alone = refined(60, tokens, types, 0)  # spelled probabilities add less than the tolerance
    after_one = refined(60, 120, 2, alone)
    ratio = refined(60, 60, 1, after_one) / refined(0, 60, 1, after_one)
    assert math.isclose(by_text["red big cat"] - by_text["red big cow"], math.log10(ratio), abs_tol=0.01)
    assert math.isclose(by_text["blue big cow"] - by_text["blue big cat"], math.log10(ratio), abs_tol=0.01)


def test_pipeline_keeps_columns_and_packs(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, FOLDER)
        docs.write.parquet(path := f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(path)
        assert docs.columns == columns and 0 < docs.count() <= before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_registered():
    import __spark_entry__

    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries())


def test_language_model_scores_do_not_depend_on_tasks(spark, odd, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    more = docs.union(odd.select(F.col("doc_id") + 10_000, "text")).union(docs.limit(5))

    def scores():
        return sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in mixing.score(more, mixing.train(docs)).collect())

    wanted = scores()
    for name, value in (("TASK_TOKENS", 3_000), ("HOT_TOKENS", 40), ("MOST_SPLITS", 5), ("ROUNDS", 3)):
        monkeypatch.setattr(mixing, name, value)
    assert scores() == wanted and len(wanted) == docs.count() + len(ODD) + 6


def test_language_model_leaves_less_on_disk_than_twice_the_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    folder = os.path.dirname(shared_path(docs, "x").removeprefix("file:"))
    before = set(os.listdir(folder))
    mixing.score(docs, mixing.train(docs)).count()
    new = [f"{folder}/{d}" for d in set(os.listdir(folder)) - before if not d.startswith("context-counts")]  # of a fixed size at most
    size = sum(os.path.getsize(f"{d}/{f}") for d in new for f in os.listdir(d))
    assert size < 2 * docs.agg(F.sum(F.octet_length("text"))).first()[0]  # hashes of all grams took 4 times as much and more
