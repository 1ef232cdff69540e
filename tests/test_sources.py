import json

import pytest
from pyspark.sql import functions as F

from kpiloom.sources import datasets, readers
from kpiloom.streaming import event_log


def test_csv_types_survive_missing_texts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Order ID, Unit Price ,Flag,Region,Note\n1,2.5,true,NA,007x\n2,n/a,False,north,\n3,1e2,TRUE,,x\n")
    df = readers.load_source(spark, str(tmp_path / "a.csv"), ".CSV")
    assert df.dtypes == [("order_id", "bigint"), ("unit_price", "double"), ("flag", "boolean"), ("region", "string"), ("note", "string")]
    assert [tuple(r) for r in df.orderBy("order_id").collect()] == [
        (1, 2.5, True, None, "007x"), (2, None, False, "north", None), (3, 100.0, True, None, "x"),
    ]


def test_csv_with_given_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,null\n2,3.5\n")
    schema = spark.createDataFrame([], "a bigint, b double").schema
    assert [tuple(r) for r in readers.load_csv(spark, str(tmp_path / "a.csv"), schema).orderBy("a").collect()] == [(1, None), (2, 3.5)]


def test_json_array_and_single_record(spark, tmp_path):
    (tmp_path / "many.json").write_text(json.dumps([{"A b": 1}, {"A b": 2}]))
    (tmp_path / "one.json").write_text(json.dumps({"A b": 3}))
    assert sorted(r.a_b for r in readers.load_source(spark, str(tmp_path / "many.json"), "json").collect()) == [1, 2]
    assert readers.load_json(spark, str(tmp_path / "one.json")).collect()[0].a_b == 3


def test_unknown_file_type_and_clashing_names(spark):
    with pytest.raises(ValueError, match="unsupported file type"):
        readers.load_source(spark, "x.bin", "bin")
    with pytest.raises(ValueError, match="share a name"):
        readers.standardize_columns(spark.createDataFrame([(1, 2)], "`A b` int, `a_b` int"))


def test_dataset_round_trip_by_reference(spark, tmp_path):
    df = spark.range(50).select(F.col("id"), (F.col("id") * 1.5).alias("v"))
    parquet = datasets.write_dataset(df, str(tmp_path / "d"))
    csv = datasets.write_dataset(df, str(tmp_path / "c"), "csv")
    rows = [("u", "d1", parquet, "parquet"), ("u", "d2", csv, "csv"), ("v", "d3", csv, "csv")]
    catalog = spark.createDataFrame(rows, "user_id string, dataset_id string, path string, filetype string")
    for name in ("d1", "d2"):
        back = datasets.read_dataset(spark, catalog, "u", name)
        assert back.dtypes == [("id", "bigint"), ("v", "double")] and back.agg(F.sum("v")).first()[0] == 1837.5
    with pytest.raises(LookupError):
        datasets.read_dataset(spark, catalog, "u", "d3")


def test_upsert_newest_wins_and_ties_go_to_incoming(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "c", 10), (2, "d", 9), (3, "e", 1)], "k int, v string, at int")
    got = sorted(tuple(r) for r in datasets.upsert(old, new, ["k"], "at").collect())
    assert got == [(1, "c", 10), (2, "b", 10), (3, "e", 1)]


def test_preview_pages(spark):
    df = spark.range(45).repartition(7)
    assert [r.id for r in datasets.preview(df, ["id"], 3).collect()] == list(range(40, 45))
    assert tuple(datasets.page_counts(df).first()) == (45, 3)
    assert tuple(datasets.page_counts(df.limit(0)).first()) == (0, 1)


def test_append_and_streaming_append(spark, tmp_path):
    rows = spark.createDataFrame([(1, "confirm"), (2, "reject")], "id int, verdict string")
    inbox, log = str(tmp_path / "in"), str(tmp_path / "log")
    rows.write.parquet(inbox)
    for _ in range(2):  # a restart finds nothing new
        stream = spark.readStream.schema(rows.schema).parquet(inbox)
        event_log.append_stream(stream, log, str(tmp_path / "ck")).awaitTermination()
    assert datasets.read_rows(spark, log).count() == 2


def test_streaming_versions_resolve_to_latest(spark, tmp_path):
    schema = "k int, v string, at int"
    inbox, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    for batch in ([(1, "a", 1), (2, "b", 5)], [(1, "c", 2), (2, "d", 4)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(inbox)
        event_log.version_stream(spark.readStream.schema(schema).parquet(inbox), out, check).awaitTermination()
    assert sorted(tuple(r) for r in event_log.current_rows(spark, out, ["k"], "at").collect()) == [(1, "c", 2), (2, "b", 5)]


def test_csv_keeps_doubled_quotes_and_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,said\n1,"he said ""hi"", ok"\n2,"two\nlines"\n')
    rows = readers.load_csv(spark, str(tmp_path / "q.csv"), multi_line=True).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'he said "hi", ok'), (2, "two\nlines")]
