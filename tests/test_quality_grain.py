from datetime import date, timedelta

import pytest
from conftest import records
from pyspark.sql import functions as F

from kpiloom.functions.dates import Cadence
from kpiloom.operators import grain, quality


def issues_of(df):
    return {(r["column"], r["issue_type"]): (r["severity"], r["affected_row_count"]) for r in records(df)}


def messy(spark):
    revenue = [100.0, 110.0, -50.0, 105.0, 95.0, 10000.0, 102.0, 98.0]
    region = ["n", None, "s", "n", None, "s", "n", "s"]
    rows = [(date(2024, 1, 1) + timedelta(days=i), region[i], revenue[i]) for i in range(8)]
    return spark.createDataFrame(rows, "order_date date, region string, revenue double")


def test_issues_of_a_messy_table(spark):
    got = issues_of(quality.quality_issues(messy(spark), "s", ["revenue"]))
    assert got == {
        ("region", "missing_values"): ("medium", 2), ("revenue", "invalid_range"): ("high", 1), ("revenue", "outlier"): ("low", 2),
    }
    scored = quality.score_issues(quality.quality_issues(messy(spark), "s", ["revenue"]), quality.source_rows(messy(spark), "s"))
    assert records(scored)[0]["score"] == 80.0  # 5 * 1.25 + 10 * 1.125 + 2 * 1.25 = 20
    assert ("revenue", "invalid_range") not in issues_of(quality.quality_issues(messy(spark), "s", ["revenue"], allow_negative=["revenue"]))


def test_clean_table_scores_full_marks(spark):
    df = spark.range(20).select(F.col("id"), (F.col("id") % 5 + 10.0).alias("v"))
    got = records(quality.score_issues(quality.quality_issues(df, "s"), quality.source_rows(df, "s")))
    assert got[0]["score"] == 100.0 and got[0]["issue_count"] == 0


def test_type_violations_and_missing_severity(spark):
    df = spark.createDataFrame([("100.0",), ("abc",), ("50.0",), (None,), ("1d",)], "revenue string")
    got = issues_of(quality.quality_issues(df, "s", declared_numeric=["revenue"]))
    assert got == {("revenue", "missing_values"): ("medium", 1), ("revenue", "type_violation"): ("medium", 2)}


@pytest.mark.parametrize("fingerprint", [False, True])
def test_copies_of_a_hot_row_and_null_rows(spark, fingerprint):
    df = spark.range(999).select(
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 5).otherwise(F.col("id")).alias("a"),
        F.when(F.col("id") % 3 == 1, None).otherwise(F.lit("x")).alias("b"),
    )
    assert tuple(quality.duplicate_rows(df.repartition(9), fingerprint).first()) == (999, 332 + 332)


def test_severity_order(spark):
    df = spark.createDataFrame([("s", "a", "x", "low", 9), ("s", "b", "x", "high", 1), ("s", "c", "x", "medium", 5)], quality.ISSUE_SCHEMA)
    assert [r["severity"] for r in records(quality.by_severity(df))] == ["high", "medium", "low"]


# --- grain -----------------------------------------------------------------------------------------------------------


def daily(spark):
    rows = [((date(2024, 1, 1) + timedelta(days=i)).isoformat(), region, 10.0 + i, 0.5) for region in ("north", "south") for i in range(14)]
    return spark.createDataFrame(rows, "date string, region string, revenue double, conversion_pct double")


def weekly(spark):
    rows = [(week, region, 700.0) for region in ("north", "south") for week in ("2024-01-01", "2024-01-08")]
    return spark.createDataFrame(rows, "week_starting string, region_code string, budget double")


def test_downsample_sums_and_averages(spark):
    got = records(grain.align_grain(daily(spark), "Daily", "Weekly", "date", "Y-m-d").orderBy("region", "date"))
    assert len(got) == 4
    assert [r["revenue"] for r in got if r["region"] == "north"] == [91.0, 140.0] and {r["conversion_pct"] for r in got} == {0.5}


def test_month_starts_stay_in_their_month(spark):
    df = spark.createDataFrame([("2024-02-01", 1.5), ("2024-02-29", 2.0), ("2024-03-01", 4.0)], "d string, v double")
    got = records(grain.align_grain(df, "Daily", "Monthly", "d", "Y-m-d").orderBy("d"))
    assert [(r["d"], r["v"]) for r in got] == [(date(2024, 2, 1), 3.5), (date(2024, 3, 1), 4.0)]


def test_upsample_carries_weeks_to_days(spark):
    got = records(grain.align_grain(weekly(spark), "Weekly", "Daily", "week_starting", "Y-m-d"))
    assert len(got) == 28 and {r["budget"] for r in got} == {700.0}
    assert len({r["week_starting"] for r in got}) == 14 and max(r["week_starting"] for r in got) == date(2024, 1, 14)


def test_upsample_carries_rows_not_values_and_fills_the_start_with_nulls(spark):
    rows = [("2024-01-01", "a", 1.0, 5.0), ("2024-01-15", "a", None, 7.0), ("2024-01-08", None, 3.0, 9.0)]
    df = spark.createDataFrame(rows, "w string, d string, x double, y double")
    got = {(r["w"].isoformat(), r["d"]): (r["x"], r["y"]) for r in records(grain.align_grain(df, "Weekly", "Daily", "w", "Y-m-d"))}
    assert len(got) == 42
    assert got[("2024-01-14", "a")] == (1.0, 5.0) and got[("2024-01-21", "a")] == (None, 7.0)
    assert got[("2024-01-07", None)] == (None, None) and got[("2024-01-21", None)] == (3.0, 9.0)


def test_upsample_of_a_late_month_without_dimensions(spark):
    df = spark.createDataFrame([(date(2024, 1, 31), 1.0), (date(2024, 2, 10), 2.0)], "m date, v double")
    got = records(grain.align_grain(df, Cadence.MONTHLY, Cadence.DAILY, "m").orderBy("m"))
    assert (got[0]["m"], got[-1]["m"], len(got)) == (date(2024, 1, 1), date(2024, 2, 29), 60)


def test_upsample_rejects_repeated_periods(spark):
    df = weekly(spark).unionByName(weekly(spark))
    with pytest.raises(Exception, match="share a period"):
        grain.align_grain(df, "Weekly", "Daily", "week_starting", "Y-m-d").count()


def keys(day="date", geo="region"):
    return {day: {0: "date", 1: "week_starting"}, geo: {0: "region", 1: "region_code"}}


def sources(spark, week=None):
    return [
        grain.Source(daily(spark), "Daily", "date", "Y-m-d"),
        grain.Source(week if week is not None else weekly(spark), "Weekly", "week_starting", "Y-m-d"),
    ]


def test_reconcile_daily_with_weekly(spark):
    got = {(r["geo"], r["day"].date().isoformat()): r for r in records(grain.reconcile(sources(spark), keys("day", "geo")))}
    assert len(got) == 28
    assert got[("north", "2024-01-10")]["revenue"] == 19.0 and got[("north", "2024-01-10")]["budget"] == 700.0


def test_reconcile_keeps_missing_weeks_null_and_the_first_overlap(spark):
    late = weekly(spark).filter("week_starting >= '2024-01-08'").withColumn("revenue", F.lit(1.0))
    got = records(grain.reconcile(sources(spark, late), keys()))
    assert len(got) == 28
    for r in got:
        assert (r["budget"] is None) == (r["date"].date() < date(2024, 1, 8)) and r["revenue"] >= 10.0


def test_reconcile_arity_and_keys(spark):
    only = weekly(spark)
    assert grain.reconcile([grain.Source(only, "Weekly")], {}) is only
    with pytest.raises(ValueError, match="at least one"):
        grain.reconcile([], {})
    with pytest.raises(ValueError, match="shares no join key"):
        grain.reconcile(sources(spark), {"x": {0: "date"}})


def test_hot_and_null_join_keys(spark):
    left = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 1).otherwise(F.col("id")).alias("k"))
    right = spark.createDataFrame([(None, "none"), (1, "hot"), (2, "two")], "k bigint, name string")
    got = {r["name"]: r["n"] for r in records(grain.join_on_keys(left, right, ["k"]).groupBy("name").agg(F.count("*").alias("n")))}
    assert got == {"none": 1000, "hot": 1000, "two": 1, None: 999}
