from conftest import records
from pyspark.sql import functions as F

from kpiloom.operators import contract, profile


def small(spark):
    rows = [
        ("2024-01-01", 100.0, "retail", "T001"), ("2024-01-02", 200.5, "corporate", "T002"), ("2024-01-03", 100.0, "retail", "T003"),
        (None, 300.0, "public", "T004"), ("2024-01-05", None, "retail", "T005"), ("2024-01-06", 50.0, "other", "T006"),
    ]
    return spark.createDataFrame(rows, "transaction_date string, revenue double, customer_segment string, transaction_id string")


def by_name(rows):
    return {r["name"]: r for r in records(rows)}


def test_roles_counts_and_samples(spark):
    for approximate in (False, True):
        got = by_name(profile.profile(small(spark), "s", ["transaction_id"], approximate))
        assert [got[c]["detected_role"] for c in ("transaction_date", "revenue", "customer_segment", "transaction_id")] == [
            "temporal", "numerical", "categorical", "identifier",
        ]
        assert got["transaction_date"]["null_ratio"] == 0.1667 and got["transaction_date"]["date_format"] == "Y-m-d"
        assert [got[c]["cardinality"] for c in ("transaction_date", "revenue", "customer_segment", "transaction_id")] == [5, 4, 4, 6]
        assert got["transaction_id"]["is_unique"] and not got["revenue"]["is_unique"]
        assert got["revenue"]["sample_numbers"] == [100.0, 200.5, 100.0, 300.0, 50.0]
        assert got["transaction_date"]["sample_values"][:2] == ["2024-01-01", "2024-01-02"]


def test_approximate_roles_equal_exact_ones(spark):
    for source in ("orders", "customer", "documents", "lineitem"):
        df = spark.read.parquet(f"/root/testdata/sf0.01/{source}.parquet")
        roles = [{k: r["detected_role"] for k, r in by_name(profile.profile(df, approximate=a)).items()} for a in (True, False)]
        assert roles[0] == roles[1], source


def test_samples_beyond_the_first_rows(spark):
    df = spark.range(300).select("id", F.when(F.col("id") >= 290, F.col("id") * 2).alias("late"), F.lit(None).cast("int").alias("never"))
    got = by_name(profile.profile(df.repartition(5), "s", ["id"]))
    assert got["late"]["sample_numbers"] == [580.0, 582.0, 584.0, 586.0, 588.0]
    assert got["never"]["sample_values"] == [] and got["id"]["sample_values"] == ["0", "1", "2", "3", "4"]


def test_integer_keys_and_measures(spark):
    df = spark.range(100).select(
        (F.col("id") + 1000).alias("key"), (F.col("id") * 977).alias("scattered"), (F.col("id") % 7).alias("quantity"),
        (F.col("id") - 50).alias("signed"), (F.col("id") % 2 == 0).alias("flag"),
    )
    got = {n: r["detected_role"] for n, r in by_name(profile.profile(df)).items()}
    assert got == {"key": "identifier", "scattered": "numerical", "quantity": "numerical", "signed": "numerical", "flag": "categorical"}


def test_empty_table(spark):
    got = by_name(profile.profile(small(spark).limit(0), "s", ["transaction_id"]))
    assert all(r["row_count"] == 0 and r["null_ratio"] == 0.0 and not r["is_unique"] for r in got.values())


def test_profile_does_not_depend_on_partitioning(spark):
    one, many = (profile.profile(small(spark).repartition(n), "s", ["transaction_id"]) for n in (1, 17))
    assert sorted(map(str, records(one))) == sorted(map(str, records(many)))


def test_contract_of_two_sources(spark):
    first = profile.profile(small(spark), "a", ["transaction_id"])
    other = spark.createDataFrame(
        [("2024-01-01", "n", "no", 0.5, 0.1, 3.0)] * 3, "month_start string, region string, region_country string, margin double, tax_rate double, x double"
    ).withColumn("n", F.lit(1))
    rows = records(contract.build_contract(first.unionByName(profile.profile(other, "b", ["x"]))))
    a, b = sorted(rows, key=lambda r: r["source_id"])
    assert a["kpi_definitions"] == [{"column": "revenue", "aggregation": "sum", "sliceable_by": ["customer_segment"]}]
    assert a["calendar"] == {"time_column": "transaction_date", "granularity": "day"}
    assert a["columns_by_role"]["identifier"] == ["transaction_id"] and set(a["access_tags"].values()) == {"public"}
    assert {d["column"]: d["aggregation"] for d in b["kpi_definitions"]} == {"margin": "avg", "tax_rate": "rate", "x": "sum", "n": "avg"}
    assert b["hierarchies"] == [{"parent": "region", "child": "region_country"}] and b["calendar"]["granularity"] == "month"
    assert a["thresholds"] == {"materiality_std_devs": 1.0, "min_support_rows": 10}


def test_required_fields_and_first_settings(spark):
    built = contract.build_contract(profile.profile(small(spark), "a", ["transaction_id"]))
    assert contract.invalid_contracts(built).count() == 0
    broken = built.withColumn("calendar", F.lit(None).cast(built.schema["calendar"].dataType))
    assert records(contract.invalid_contracts(broken)) == [{"source_id": "a", "missing_fields": ["calendar"]}]
    weights = "struct<statistical:double,business:double>"
    two = built.withColumn("thresholds", F.lit(None).cast(built.schema["thresholds"].dataType)).unionByName(
        built.withColumn("source_id", F.lit("b")).withColumn("materiality_weights", F.from_json(F.lit('{"statistical":0.9,"business":0.1}'), weights))
    )
    assert records(contract.settings(two)) == [{"threshold": 1.0, "weight_statistical": 0.9, "weight_business": 0.1}]


def test_whole_column_decides_between_sum_and_average(spark):
    """Zeros in front do not turn an amount into a ratio."""
    values = [0.0] * 5 + [5000.0 + i for i in range(195)]
    rows = [(i, v, (i % 11) / 10) for i, v in enumerate(values)]
    profiles = profile.profile(spark.createDataFrame(rows, "day bigint, revenue double, part double"), "s", ["day"])
    got = {r.name: r.aggregation for r in contract.classified(profiles).collect()}
    assert got["revenue"] == "sum" and got["part"] == "avg"
