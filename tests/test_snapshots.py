"""Stored tables: snapshots, pruning, conflicts, logs that batches and streams share."""

import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kpiloom.sources import datasets
from kpiloom.sources.snapshots import CommitConflict, StoredTable
from kpiloom.streaming import event_log

SCHEMA = "k bigint, part string, v string, at timestamp"
T0 = datetime(2024, 1, 1)


def rows_of(spark, keys, v, at=0):
    return spark.createDataFrame([(k, f"p{k % 3}", v, T0 + timedelta(hours=at)) for k in keys], SCHEMA)


def paths(table):
    return {r.path for r in table.manifest().select("path").collect()}


def test_upsert_rewrites_touched_files_only(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), ["k"], file_rows=25)
    table.create(rows_of(spark, range(0, 400, 2), "old"))
    before = paths(table)
    assert len(before) >= 8
    table.upsert(rows_of(spark, [11, 12, 14], "new", 1), "at")  # one gap, two known keys, all in one range or two
    after = paths(table)
    assert len(before - after) <= 2 and before & after
    got = {r.k: r.v for r in table.read().collect()}
    assert len(got) == 201 and {k for k, v in got.items() if v == "new"} == {11, 12, 14}
    assert {r.v for r in table.read(version=0).collect()} == {"old"} and table.read(version=0).count() == 200


def test_newest_wins_and_ties_go_to_incoming(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), ["part", "k"])
    table.create(rows_of(spark, [1, 2, 3], "old", 5))
    table.upsert(rows_of(spark, [1], "late", 4).unionByName(rows_of(spark, [2], "tie", 5)).unionByName(rows_of(spark, [9], "first", 0)), "at")
    assert {(r.k, r.v) for r in table.read().collect()} == {(1, "old"), (2, "tie"), (3, "old"), (9, "first")}


def test_null_and_composite_keys(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), ["part", "k"], file_rows=4)
    keyed = rows_of(spark, range(30), "old").withColumn("part", F.when(F.col("k") % 5 != 0, F.col("part")))
    table.create(keyed)
    table.upsert(keyed.withColumn("v", F.lit("new")).filter("k % 2 = 0"), "at")
    got = table.read()
    assert got.count() == 30 and got.filter("v = 'new'").count() == 15 and got.filter("v = 'new' AND k % 2 = 0").count() == 15


def test_failed_commit_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    table = StoredTable(spark, str(tmp_path / "t"), ["k"])
    table.create(rows_of(spark, range(5), "old"))
    base = table.snapshot()
    with pytest.raises(CommitConflict):
        StoredTable(spark, str(tmp_path / "t"), ["k"]).create(rows_of(spark, range(2), "other"))
    monkeypatch.setattr(table, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        table.upsert(rows_of(spark, [1], "new", 1), "at")
    monkeypatch.undo()
    assert table.snapshot() == base and {r.v for r in table.read().collect()} == {"old"}


def test_second_writer_starts_over_on_the_newer_snapshot(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), ["k"])
    table.create(rows_of(spark, range(5), "old"))
    stale, commit, late = StoredTable(spark, str(tmp_path / "t"), ["k"]), table._commit, []

    def first_lose(*arguments):
        if not late:
            late.append(stale.upsert(rows_of(spark, [1], "theirs", 1), "at"))
        return commit(*arguments)

    table._commit = first_lose
    table.upsert(rows_of(spark, [2], "ours", 1), "at")
    assert {r.k: r.v for r in table.read().collect()} == {0: "old", 1: "theirs", 2: "ours", 3: "old", 4: "old"}
    assert table.versions() == [0, 1, 2]


def test_delete_by_another_column(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), ["k"], file_rows=10)
    table.create(rows_of(spark, range(100), "x").withColumn("part", F.when(F.col("k") < 20, "low").otherwise("high")))
    before = paths(table)
    table.delete(spark.createDataFrame([("low",), ("none",)], "part string"), "part")
    assert table.read().count() == 80 and table.read(version=0).count() == 100
    assert len(before & paths(table)) >= len(before) // 2
    assert table.delete(spark.createDataFrame([("low",)], "part string"), "part").version == 1  # nothing left to delete


def test_batches_and_streams_share_a_log(spark, tmp_path):
    log, inbox, check = str(tmp_path / "log"), str(tmp_path / "in"), str(tmp_path / "check")
    rows = rows_of(spark, range(10), "batch")
    datasets.append_rows(rows, log, "loader", 0)
    rows_of(spark, range(10, 13), "stream").write.parquet(inbox)
    stream = spark.readStream.schema(SCHEMA).parquet(inbox)
    event_log.append_stream(stream, log, check).awaitTermination()
    datasets.append_rows(rows, log, "loader", 0)  # sent again
    datasets.append_rows(rows_of(spark, range(13, 15), "batch"), log, "loader", 1)
    rows_of(spark, range(15, 17), "stream").write.mode("append").parquet(inbox)
    event_log.append_stream(stream, log, check).awaitTermination()
    datasets.append_rows(rows_of(spark, [17], "stream"), log, f"stream {check}", 0)  # a micro-batch that a restart repeats
    datasets.append_rows(rows_of(spark, [17], "unnumbered"), log)
    assert sorted(r.k for r in datasets.read_rows(spark, log).collect()) == list(range(18))


def test_appends_at_once_all_land(spark, tmp_path):
    log, errors = str(tmp_path / "log"), []

    def write(n):
        try:
            datasets.append_rows(rows_of(spark, [n], "w"), log, f"writer {n}", 0)
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(r.k for r in datasets.read_rows(spark, log).collect()) == [0, 1, 2, 3, 4]


def test_many_appends_merge_manifests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("kpiloom.sources.snapshots.MANIFESTS", 3)
    table = StoredTable(spark, str(tmp_path / "log"))
    for n in range(6):
        table.append(rows_of(spark, [n], "w"))
    assert len(table.snapshot().manifests) <= 3 and table.read().count() == 6


def test_pages_read_only_their_files(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), ["part", "k"], file_rows=7)
    table.create(rows_of(spark, range(200), "x"))
    wanted = [r.k for r in table.read().orderBy("part", "k").collect()]
    for page in (1, 3, 10, 11):
        found = table.page(page, 20)
        assert [r.k for r in found.collect()] == wanted[20 * (page - 1) : 20 * page]
        assert len(found.inputFiles()) <= 6
    assert [r.k for r in table.read_keys("p1", "p1").orderBy("k").collect()] == list(range(1, 200, 3))


def test_cascade_over_stored_tables(spark, tmp_path):
    def stored(name, rows, schema, keys):
        table = StoredTable(spark, str(tmp_path / name), keys)
        table.create(spark.createDataFrame(rows, schema))
        return table

    tables = {
        "sources": stored("sources", [(1,), (2,)], "source_id int", ["source_id"]),
        "canonical_datasets": stored("sets", [(10, [1]), (11, [1, 2]), (12, [2])], "dataset_id int, source_ids array<int>", ["dataset_id"]),
        "kpis": stored("kpis", [(100, 10), (101, 11), (102, 12)], "kpi_id int, dataset_id int", ["kpi_id"]),
        "anomalies": stored("anomalies", [(100, "a"), (102, "b")], "kpi_id int, text string", ["kpi_id"]),
    }
    gone = spark.createDataFrame([(1,)], "source_id int")
    for _ in range(2):  # doing it again changes nothing
        datasets.delete_sources(tables, gone)
    assert {n: [r[0] for r in t.read().collect()] for n, t in tables.items()} == {"sources": [2], "canonical_datasets": [12], "kpis": [102], "anomalies": [102]}
    assert tables["kpis"].read(version=0).count() == 3
