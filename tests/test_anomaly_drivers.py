import random
from datetime import date, timedelta

import numpy as np
import pytest
from conftest import records
from pyspark.sql import functions as F

from kpiloom.model import Kpi
from kpiloom.operators import anomaly, causal, drivers, findings, kpi
from kpiloom.functions import series


def noise(n, level=100.0, seed=4):
    rng = random.Random(seed)
    return [level + rng.gauss(0, 1) for _ in range(n)]


def flagged(df, method):
    return sorted(r["idx"] for r in records(df) if r["method"] == method)


def test_spikes_are_flagged_and_calm_series_are_not(trend_of):
    rising = noise(90, -40.0, 21)
    dented = [v - 33.0 if i == 61 else v for i, v in enumerate(rising)]
    assert 61 in flagged(anomaly.control_limit_breaches(trend_of(dented)), "control_limit_breaches")
    assert flagged(anomaly.mad_outliers(trend_of(dented)), "outliers") == [61]
    assert anomaly.detect_anomalies(trend_of([-0.25] * 19)).count() == 0
    assert anomaly.detect_anomalies(trend_of([4, 4, 900, 4, 5])).count() == 0  # too short to judge


def test_any_move_after_a_constant_window_breaks_the_limits(trend_of):
    assert flagged(anomaly.control_limit_breaches(trend_of([5.0] * 9 + [5.1] + [5.0] * 3)), "control_limit_breaches") == [9]


def test_level_shift_is_found_per_series(spark, trend_of):
    steps = trend_of(noise(45, 12.0, 31) + noise(30, -26.0, 32), "steps")
    both = steps.unionByName(trend_of(noise(70, 500.0, 34), "level"))
    found = records(anomaly.level_shifts(both))
    assert sorted((r["kpi"], r["idx"]) for r in found) == [("steps", 45)]


def test_detectors_equal_plain_numpy(trend_of):
    rng = np.random.default_rng(12)
    values = np.round(rng.normal(100, 5, 80), 3)
    values[[20, 50]] += 60
    df = trend_of(values)
    expected = [i for i in range(7, 80) if abs(values[i] - values[i - 7 : i].mean()) > 3 * values[i - 7 : i].std(ddof=1)]
    assert flagged(anomaly.control_limit_breaches(df), "control_limit_breaches") == expected
    median = np.median(values)
    z = np.abs(0.6745 * (values - median) / np.median(np.abs(values - median)))
    assert flagged(anomaly.mad_outliers(df), "outliers") == [int(i) for i in np.where(z > 3.5)[0]]
    local = {r["idx"]: r["local_mean"] for r in records(anomaly.local_direction(df))}
    for i in (0, 2, 40, 79):
        around = [values[j] for j in range(max(0, i - 3), min(80, i + 4)) if j != i]
        assert local[i] == pytest.approx(np.mean(around), rel=1e-9)


def test_neighbouring_methods_support_each_other(spark, trend_of):
    values = noise(40)
    values[20] = 160.0
    directed = anomaly.local_direction(trend_of(values))
    marked = directed.select(
        "kpi", "idx", "period", "value", "direction", F.lit(False).alias("change_points"),
        (F.col("idx") == 21).alias("control_limit_breaches"), F.col("idx").isin(20, 30).alias("outliers"),
    )
    checked = spark.createDataFrame([("k", "valid", 40)], "kpi string, status string, period_count bigint")
    got = {r["finding_key"]: r for r in records(anomaly.anomaly_findings(marked, checked))}
    assert got["anomaly:outliers:20"]["direction"] == "up"
    assert got["anomaly:outliers:20"]["corroborating_methods"] == [{"method": "control_limit_breaches", "direction": "down"}]
    assert got["anomaly:outliers:30"]["corroborating_methods"] == []
    wide = {r["idx"]: r for r in records(anomaly.flag_table(marked))}
    assert wide == {r["idx"]: r for r in records(anomaly.pivot_flags(anomaly.flags_of(marked)))} and set(wide) == {20, 21, 30}
    assert wide[21]["control_limit_breaches"] and not wide[21]["outliers"] and not wide[21]["change_points"]


# --- drivers ---------------------------------------------------------------------------------------------------------


def moved(spark, rows, aggregation="sum", dims=("region",)):
    df = spark.createDataFrame(rows, "d date, region string, revenue double")
    kpis = [Kpi("revenue", aggregation)]
    movements = drivers.latest_movements(kpi.kpi_trend(df, kpis, "d"), kpis)
    return drivers.decompose(df, movements, dims, "d")


ONE, TWO = date(2021, 5, 9), date(2021, 5, 10)
# Three slices: one grows, one shrinks by less, one stays.
BASE = [(ONE, "A", 64.0), (ONE, "B", 20.0), (ONE, "S", 8.0), (TWO, "A", 96.0), (TWO, "B", 12.0), (TWO, "S", 8.0)]


def by_slice(df):
    return {r["slice"]: r for r in records(df)}


def test_designed_contributions(spark):
    got = by_slice(moved(spark, BASE))
    assert {s: r["contribution"] for s, r in got.items()} == {"A": 32.0, "B": -8.0, "S": 0.0} and got["S"]["total_movement"] == 24.0
    assert got["A"]["share_pct"] == pytest.approx(400 / 3) and [got[s]["direction"] for s in "ABS"] == ["up", "down", "flat"]
    assert (got["B"]["before_value"], got["B"]["after_value"]) == (92.0, 116.0)
    assert [r["slice"] for r in records(drivers.ranked(moved(spark, BASE)))] == ["A", "B", "S"]


def test_new_and_missing_slices(spark):
    got = by_slice(moved(spark, BASE + [(TWO, "fresh", 40.5), (ONE, "gone", 11.0), (TWO, None, 0.5), (date(2020, 2, 29), "past", 77.0)]))
    assert (got["fresh"]["before"], got["fresh"]["contribution"], got["gone"]["contribution"]) == (0.0, 40.5, -11.0)
    assert got["(null)"]["contribution"] == 0.5 and got["A"]["total_movement"] == 24.0 + 40.5 - 11.0 + 0.5 and "past" not in got


def test_counts_decompose_exactly(spark):
    df = moved(spark, BASE + [(TWO, "A", 1.0), (TWO, "B", None)], "count")
    got = by_slice(df)
    assert (got["A"]["contribution"], got["B"]["contribution"], got["A"]["total_movement"]) == (1.0, 0.0, 1.0)
    assert records(drivers.dimension_summary(df))[0]["reconciled"] is True


def test_ratio_parts_and_residual(spark):
    rows = [(ONE, "A", 10.0), (ONE, "A", 20.0), (ONE, "B", 30.0), (TWO, "A", 20.0), (TWO, "B", 40.0), (TWO, "B", 60.0)]
    df = moved(spark, rows, "avg")
    got = by_slice(df)
    # volume part: change in count times 20; rate part: change of the slice mean times its new count
    assert got["A"]["contribution"] == (1 - 2) * 20.0 + (20.0 - 15.0) * 1 and got["B"]["contribution"] == (2 - 1) * 20.0 + (50.0 - 30.0) * 2
    summary = records(drivers.dimension_summary(df))[0]
    assert summary["residual"] == -15.0 + 60.0 - 20.0 and summary["reconciled"] is None


def test_one_period_is_not_enough(spark):
    with pytest.raises(ValueError, match="two periods"):
        moved(spark, BASE[:2])


def test_hot_slice_and_ranking_of_dimensions(spark):
    df = spark.range(6000).select(
        F.when(F.col("id") % 2 == 0, ONE).otherwise(TWO).alias("d"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("region"),
        F.when(F.col("id") % 5 == 0, "x").otherwise("y").alias("flag"), (F.col("id") % 11).cast("double").alias("revenue"),
    ).repartition(9)
    kpis = [Kpi("revenue"), Kpi("revenue", "count")]
    slices = drivers.decompose(df, drivers.latest_movements(kpi.kpi_trend(df, kpis, "d"), kpis), ["region", "flag"], "d")
    dims = records(drivers.ranked_dimensions(slices))
    assert len(dims) == 4 and all(r["reconciled"] for r in dims) and {r["dimension_rank"] for r in dims} == {1, 2}
    assert slices.filter("kpi = 'sum(revenue)' and dimension = 'region'").count() == 4001
    top = records(drivers.top_slices(slices, 3))
    assert len(top) == 3 + 3 + 2 + 2 and max(r["rank"] for r in top) == 3
    assert all(r["matches"] for r in records(drivers.display_check(slices)))


def test_dimension_merge():
    assert drivers.dimensions_of(Kpi("v", slice_columns=("b", "a")), ["a", "c", "b"]) == ["b", "a", "c"]


def test_diff_in_diff(spark):
    later = date(2024, 1, 8)
    rows = [(d, r, v) for d, r, v in ((ONE, "A", 100.0), (ONE, "B", 100.0), (later, "A", 130.0), (later, "B", 110.0)) for _ in range(2)]
    df = spark.createDataFrame(rows, "date date, region string, revenue double")
    got = records(causal.diff_in_diff(df, "region", "revenue", ONE, later, "date"))[0]
    assert got["treatment_value"] == "A" and got["did_estimate"] == 20.0 and (got["n_treat_after"], got["n_ctrl_after"]) == (2, 2)
    assert got["p_value"] is None and got["effect_size"] is None  # no variance


def test_diff_in_diff_p_value_and_empty_groups(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(10, 2, 12), rng.normal(12, 3, 15)
    rows = [(TWO, "A", float(v)) for v in a] + [(TWO, None, float(v)) for v in b]
    df = spark.createDataFrame(rows, "date date, region string, revenue double")
    got = records(causal.diff_in_diff(df, "region", "revenue", ONE, TWO, "date", scale=9))[0]
    assert got["treat_before"] == 0.0 and got["n_ctrl_before"] == 0
    expected = series.welch_p_value(12, a.mean(), a.var(ddof=1), 15, b.mean(), b.var(ddof=1))
    assert got["p_value"] == pytest.approx(expected, rel=1e-6) and 0 < expected < 1
    assert got["effect_size"] == pytest.approx((a.mean() - b.mean()) / np.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2), rel=1e-6)


# --- confidence ------------------------------------------------------------------------------------------------------

FINDING = (
    "quality_score double, p_value double, effect_size double, statistic double, kpi_status string, period_count bigint,"
    " corroborating_methods array<struct<method:string,direction:string>>"
)


def confidence(spark, *row, **options):
    return records(findings.score_confidence(spark.createDataFrame([row], FINDING), **options))[0]["confidence"]


def test_weak_evidence_abstains_and_says_what_is_missing(spark):
    got = confidence(spark, 45.0, None, None, 12.5, "low-data", 4, [])
    assert got["level"] == "abstain" and "more time periods (at least 8 required, have 4)" in got["missing_evidence"]
    nothing = confidence(spark, 50.0, None, None, None, "low-data", 3, [])
    assert nothing["level"] == "abstain" and "a significance test or effect size" in nothing["missing_evidence"]


def test_strong_and_contradictory_evidence(spark):
    strong = confidence(spark, 98.0, 0.01, None, 20.0, "valid", 52, [("control_limit_breaches", "up")])
    assert strong["level"] == "high" and strong["missing_evidence"] == []
    torn = confidence(spark, 99.0, 0.001, None, 5.0, "valid", 40, [("a", "up"), ("b", "down")])
    assert torn["level"] == "abstain" and any("contradictory" in r for r in torn["reasons"])
    assert confidence(spark, None, 0.3, None, 1.0, "valid", 30, [])["level"] == "abstain"


def test_effect_sizes_have_their_own_limits(spark):
    negative = (90.0, None, -0.1, 5.0, "valid", 20, [])
    assert "weak" in confidence(spark, *negative)["reasons"][1]
    assert "strong" in confidence(spark, *negative, p_or_effect=True)["reasons"][1]
    assert "strong" in confidence(spark, 90.0, None, -1.2, 5.0, "valid", 20, [])["reasons"][1]


def test_abstained_findings_lose_their_payload(spark):
    df = spark.createDataFrame([("f1", "k", 5.0, "low-data", 2)], "finding_id string, kpi string, statistic double, kpi_status string, period_count bigint")
    df = df.withColumns({
        "p_value": F.lit(None).cast("double"), "effect_size": F.lit(None).cast("double"),
        "corroborating_methods": F.array().cast("array<struct<method:string,direction:string>>"),
    })
    low = records(findings.apply_confidence(df, 10.0))[0]
    assert low["abstained"] and low["statistic"] is None and low["finding_id"] == "f1" and low["message"]
    kept = records(findings.apply_confidence(df, 100.0))[0]
    assert not kept["abstained"] and kept["statistic"] == 5.0 and kept["message"] is None
    scores = spark.createDataFrame([("d", 10.0)], "dataset_id string, score double")
    assert records(findings.apply_confidence(df.withColumn("dataset_id", F.lit("d")), scores))[0]["abstained"]


def test_default_lineage(spark):
    got = spark.range(1).select(
        findings.default_lineage(F.lit("t"), F.lit("d"), F.lit("k"), F.lit("n")),
        findings.default_lineage(F.lit("t"), F.lit(None).cast("string"), F.lit("k"), F.lit("")),
    ).first()
    assert tuple(got) == (["canonical dataset d", "KPI k", "KPI name: n", "finding: t"], ["KPI k", "finding: t"])
