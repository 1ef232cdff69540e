from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pytest
from conftest import records
from pyspark.sql import functions as F

from kpiloom.model import Kpi
from kpiloom.operators import contract, feedback, kpi, materiality, profile


def frame(spark, values, start=date(2024, 1, 1)):
    rows = [((start + timedelta(days=i)).isoformat(), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "d string, revenue double")


def trend(spark, df, *kpis):
    return kpi.kpi_trend(df, kpis, "d", date_format="Y-m-d")


def test_value_baseline_and_benchmark(spark):
    row = records(kpi.compute_kpis(trend(spark, frame(spark, range(10, 22)), Kpi("revenue"))))[0]
    assert (row["value"], row["baseline"], row["benchmark"], row["period_count"]) == (21.0, 17.0, 15.5, 12)
    interval = row["confidence_interval"]
    assert interval["lower"] < 15.5 < interval["upper"]
    means = np.random.default_rng(42).choice(np.arange(10.0, 22.0), size=(1000, 12)).mean(axis=1)
    assert interval["lower"] == np.quantile(means, (1 - 0.95) / 2)


def test_average_count_and_short_series(spark):
    rows = [(f"2024-01-0{i}", v) for i in range(1, 5) for v in (float(i), i + 20.0)] + [("2024-01-05", None), ("2024-01-05", 2.0), ("broken", 9.0)]
    df = spark.createDataFrame(rows, "d string, revenue double")
    got = records(trend(spark, df, Kpi("revenue", "avg"), Kpi("revenue", "count"), Kpi("revenue", "rate")))
    by = {(r["kpi"], r["idx"]): r["value"] for r in got}
    assert by[("avg(revenue)", 3)] == 14.0 and by[("count(revenue)", 4)] == 1.0 and by[("rate(revenue)", 4)] == 2.0
    one = records(kpi.compute_kpis(trend(spark, frame(spark, [5.0]), Kpi("revenue"))))[0]
    assert one["baseline"] is None and one["confidence_interval"] is None


def test_sum_of_missing_values_is_zero_and_mean_is_left_out(spark):
    df = spark.createDataFrame([("2024-01-01", None), ("2024-01-02", 3.0)], "d string, revenue double")
    got = records(trend(spark, df, Kpi("revenue"), Kpi("revenue", "avg")))
    assert sorted((r["kpi"], r["value"]) for r in got) == [("avg(revenue)", 3.0), ("sum(revenue)", 0.0), ("sum(revenue)", 3.0)]


def status(spark, values, aggregation="sum"):
    df, k = frame(spark, values), Kpi("revenue", aggregation)
    return records(kpi.validate_kpis(kpi.period_statistics(df, [k], "d", date_format="Y-m-d"), [k], df.columns))[0]


@pytest.mark.parametrize("periods,expected", [(1, "invalid"), (3, "low-data"), (7, "low-data"), (8, "valid"), (20, "valid")])
def test_sample_size_decides_status(spark, periods, expected):
    assert status(spark, range(1, periods + 1))["status"] == expected


def test_zero_rate_and_unknown_columns(spark):
    assert status(spark, [0.0] * 10, "rate")["reason"] == "zero denominator for ratio aggregation"
    df, k = frame(spark, range(9)), Kpi("other")
    row = records(kpi.validate_kpis(kpi.period_statistics(df, [k], "d", date_format="Y-m-d"), [k], df.columns))[0]
    assert row["reason"] == "measure column 'other' not in dataset"


def test_discovery_names_and_duplicates(spark):
    rows = [((date(2024, 1, 1) + timedelta(days=i)).isoformat(), "ab"[i % 2], 10.5 * i, i % 4 + 2) for i in range(30)]
    df = spark.createDataFrame(rows, "date string, region string, revenue double, orders bigint")
    built = contract.build_contract(profile.profile(df, "a", ["date"]).unionByName(profile.profile(df, "b", ["date"])))
    found = records(kpi.discover_kpis(built, df.columns, "date"))
    assert sorted(r["name"] for r in found) == ["sum(orders) by region", "sum(revenue) by region"]
    assert kpi.discover_kpis(built, ["date", "revenue"], "date").first()["name"] == "sum(revenue)"
    assert {k.name for k in kpi.as_kpis(kpi.discover_kpis(built, df.columns, "date"))} == {r["name"] for r in found}


def test_batch_keeps_invalid_and_reports_failed(spark):
    validated = spark.createDataFrame([("a", "valid", 9), ("b", "invalid", 0), ("c", "low-data", 3)], "kpi string, status string, period_count int")
    results = kpi.batch_results(validated, spark.createDataFrame([("a", 1.0, 9)], "kpi string, value double, period_count int"))
    assert records(kpi.batch_summary(results)) == [{"processed": 2, "failed": 1, "failures": ["c"]}]


def test_failing_kpis_do_not_stop_the_batch(spark):
    rows = [(date(2024, 1, 1 + i // 2), f"{i}.5", "x" if i == 13 else "y" if i == 17 else str(i), 1.7e308, Decimal(9 * 10**37), float(i)) for i in range(20)]
    rows.append((None, "1.0", "unread", 1.0, Decimal(1), 1.0))  # no time: in no trend, so its text does no harm
    df = spark.createDataFrame(rows, "d date, good string, bad string, wide double, fixed decimal(38,0), `a.b` double")
    kpis = [Kpi("good"), Kpi("good", "avg"), Kpi("bad"), Kpi("bad", "count"), Kpi("wide", "avg"), Kpi("fixed"), Kpi("a.b"), Kpi("none")]
    results = kpi.run_batch(kpi.period_statistics(df, kpis, "d"), kpis, df.columns)
    by = {r["kpi"]: r for r in records(results)}
    assert {k: r["error"] for k, r in by.items() if r["error"]} == {
        "sum(bad)": "2024-01-07: 'x' is no number", "avg(wide)": "2024-01-01: total is not finite",
        "sum(fixed)": "2024-01-01: total exceeds its type",
    }
    assert by["sum(bad)"]["status"] == "valid" and by["sum(bad)"]["value"] is None
    assert (by["sum(good)"]["value"], by["avg(good)"]["value"], by["count(bad)"]["value"], by["sum(a.b)"]["value"]) == (38.0, 19.0, 2.0, 37.0)
    assert by["sum(none)"]["status"] == "invalid" and by["sum(good)"]["confidence_interval"] is not None
    assert records(kpi.batch_summary(results)) == [
        {"processed": 5, "failed": 3, "failures": ["avg(wide)", "sum(bad)", "sum(fixed)"]}
    ]


def test_failure_without_time_and_text_that_only_holds_numbers(spark):
    df = spark.createDataFrame([("1",), (None,), ("two",)], "v string")
    statistics = kpi.period_statistics(df, [Kpi("v")], None)
    assert records(kpi.failures(statistics, has_time=False)) == [{"kpi": "sum(v)", "error": "'two' is no number"}]
    sound = kpi.period_statistics(df.filter("v <> 'two'"), [Kpi("v")], None)
    assert sound.first()["value"] == 1.0 and kpi.failures(sound, has_time=False).isEmpty()


def score(spark, values, **settings):
    summary = kpi.summarize(trend(spark, frame(spark, values), Kpi("revenue")))
    return records(materiality.score_materiality(summary, **settings))[0]["materiality"]


def test_materiality(spark):
    stable = [100.0 + (i % 3) for i in range(19)]
    big, small = score(spark, stable + [140.0]), score(spark, stable + [101.5], threshold=5.0)
    assert big == 10.0 and small < big / 2
    assert score(spark, [100.0] * 20) == 0.0 and score(spark, [100.0] * 19 + [120.0]) == 10.0 and score(spark, [5.0]) == 0.0
    assert score(spark, [100.0] * 19 + [120.0], multiplier=0.55) == 5.5
    values = np.array(stable + [103.0])
    s = abs(103 - values[-8:-1].mean()) / values[:-1].std(ddof=1)
    expected = s * (0.9 * min(s / 3, 1) + 0.1 * min(s / 4, 1))
    assert score(spark, values, threshold=4.0, weight_statistical=9.0, weight_business=1.0) == pytest.approx(expected, abs=1e-4)


def test_trend_does_not_depend_on_partitioning(spark):
    df = spark.range(5000).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("d"),
        (F.pmod(F.hash("id"), F.lit(100_000)) / 1000.0).alias("revenue"),
    )
    got = [sorted(map(str, records(kpi.kpi_trend(df.repartition(n), [Kpi("revenue"), Kpi("revenue", "avg")], "d", "week")))) for n in (1, 17)]
    assert got[0] == got[1]


def test_feedback_multipliers(spark):
    def rows(user, kind, **counts):
        return [(f"{user}{kind}{v}{i}", user, kind, v) for v, n in counts.items() for i in range(n)]

    data = rows("u", "region", reject=3, correct=4) + rows("u", "price", reject=10) + rows("u", "mix", reject=2, confirm=4) + rows("v", "region", confirm=1)
    df = spark.createDataFrame(data, "feedback_id string, user_id string, driver_type string, verdict string")
    got = {(r["user_id"], r["driver_type"]): r["multiplier"] for r in records(feedback.adjustments(df))}
    assert got == {("u", "region"): 0.55, ("u", "price"): 0.25, ("u", "mix"): 1.0, ("v", "region"): 1.0}
    asked = spark.createDataFrame([("u", "region"), ("u", "new")], "user_id string, driver_type string")
    assert {r["driver_type"]: r["multiplier"] for r in records(feedback.with_multiplier(asked, feedback.adjustments(df)))} == {"region": 0.55, "new": 1.0}


def test_unknown_verdicts_fail(spark):
    df = spark.createDataFrame([("maybe", "insight")], "verdict string, target_type string")
    with pytest.raises(Exception, match="unknown verdict"):
        feedback.checked(df).collect()
