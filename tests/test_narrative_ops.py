import json
from datetime import datetime

import pytest
from conftest import records
from pyspark.sql import functions as F

from kpiloom.operators import checks, governance, narrative, telemetry
from kpiloom.operators.governance import Persona
from kpiloom.plans import movement
from kpiloom.model import Kpi


def lit(v, kind="string"):
    return F.lit(v).cast(kind)


def bullets(spark, name, way, magnitude, pct=None, dim=None, part=None, contribution=None, share=None, part_way=None, level=None):
    c = narrative.bullets_of(
        lit(name), lit(way), lit(magnitude, "double"), lit(pct, "double"), lit(dim), lit(part), lit(contribution, "double"),
        lit(share, "double"), lit(part_way), lit(level),
    )
    return spark.range(1).select(c.alias("b")).first()["b"]


def test_bullets(spark):
    got = bullets(spark, "Freight cost", "up", 4210.75, 0.125, "carrier", "Rail", 6000.0, 142.49, "up", "medium")
    assert got == [
        "Freight cost increased by 4,210.75 (+12.5%).",
        "Top driver: carrier = 'Rail' contributed 6,000.00 (up), 142.5% of the total movement.",
        "Confidence: medium-confidence.",
    ]
    assert bullets(spark, "Returns", "flat", 0.0) == ["Returns held steady.", "Confidence: unscored."]
    assert bullets(spark, "Returns", "down", -0.5) == ["Returns decreased by -0.50.", "Confidence: unscored."]
    assert bullets(spark, "R", "down", -7.0, None, "k", None, -2.25)[1] == "Top driver: k = an unlabeled slice contributed -2.25 (down)."


# A dimension of each driver type, by a part of its name.
NAMES = {
    "price": "discount_step", "volume": "order_size", "mix": "sku_group", "marketing": "campaign_code", "supply": "warehouse_id",
    "seasonality": "Holiday", "channel": "platform", "region": "postal_zone", "quality": "complaint_kind", "other": "colour",
}


def findings(spark, level="high", abstained=False):
    part = {"rank": 1, "slice": "Z9", "before": 12.0, "after": 92.0, "contribution": 80.0, "share_pct": 64.0, "direction": "up"}
    rows = [
        (f"f-{d}", d, d, 1, 125.0, 300.0, 425.0, "2019-02-04", "2019-02-11", abstained, [part], {"level": level, "reasons": ["r"], "missing_evidence": []},
         {"finding_type": "driver_contribution", "method": "m", "source_freshness": "s", "lineage": ["a"]})
        for d in NAMES.values()
    ]
    return spark.createDataFrame(
        rows, "finding_id string, kpi string, dimension string, dimension_rank int, total_movement double, before_value double, after_value double,"
        " before_period string, after_period string, abstained boolean,"
        " slices array<struct<rank:int,slice:string,before:double,after:double,contribution:double,share_pct:double,direction:string>>,"
        " confidence struct<level:string,reasons:array<string>,missing_evidence:array<string>>,"
        " evidence struct<finding_type:string,method:string,source_freshness:string,lineage:array<string>>",
    )


def test_packages_for_every_driver_type(spark):
    got = {r["kpi"]: r["package"] for r in records(narrative.packages(findings(spark)))}
    assert {p["driver"]["type"] for p in got.values()} == set(NAMES)
    for kind, name in NAMES.items():
        p = got[name]
        assert p["driver"]["type"] == kind and all(p.values()) and p["owner"] == ("cfo" if kind == "price" else "category_manager")
    assert got["postal_zone"]["expected_impact"] == (
        "'Z9' in postal_zone contributed 80.00 (64.0% of the 125.00 total movement) from 2019-02-04 to 2019-02-11"
    )


def test_abstained_findings_give_no_package(spark):
    assert narrative.packages(findings(spark, "abstain")).count() == 0
    rejected = {r["rejection"] for r in records(narrative.rejection_reason(findings(spark, "abstain", True)))}
    assert rejected == {"abstained finding — no recommendation can be built"}
    empty = findings(spark).withColumn("slices", F.expr("filter(slices, s -> false)"))
    assert narrative.packages(empty).count() == 0 and narrative.insights(empty).count() == 0


def test_json_hash_and_prompt_are_stable(spark):
    def build(n):
        rows = narrative.hashed(narrative.packages(findings(spark).repartition(n)), "cfo")
        return sorted((r["package_hash"], r["package_json"], r["p"]) for r in records(rows.withColumn("p", narrative.prompt(F.col("package")))))

    first = build(1)
    assert first == build(7) and len({h for h, _, _ in first}) == len(NAMES)
    decoded = json.loads(first[0][1])
    assert list(decoded) == sorted(decoded) and list(decoded["driver"]) == sorted(decoded["driver"])
    assert "Bulleted recommendation:" in first[0][2] and "Accountable owner: " in first[0][2]


# --- governance ------------------------------------------------------------------------------------------------------


def kpis(spark):
    return spark.createDataFrame(
        [("a", "revenue", ["region"], "valid"), ("b", "cost", ["region"], "valid"), ("c", "revenue", ["product"], "valid"), ("d", "revenue", ["product"], None), ("e", "revenue", [], "valid")],
        "name string, measure string, slice_columns array<string>, status string",
    )


def contracts(spark):
    return spark.createDataFrame(
        [("s1", {"measure": ["revenue"], "dimension": ["region"], "time": None, "identifier": ["customer_id"]}, {"salary": "pii", "region": "public"}),
         ("s2", {"measure": ["region"], "dimension": ["product"], "time": None, "identifier": None}, {"cost": "financial"})],
        "source_id string, columns_by_role struct<measure:array<string>,dimension:array<string>,time:array<string>,identifier:array<string>>, access_tags map<string,string>",
    )


def visible(spark, **rules):
    return sorted(r["name"] for r in records(governance.for_persona(kpis(spark), Persona.parse(rules), contracts(spark))))


def test_persona_rules_on_kpis(spark):
    assert visible(spark) == ["a", "b", "c", "d", "e"]
    assert visible(spark, allowed_domains=["region"]) == ["a", "b", "d", "e"]
    assert visible(spark, restricted_columns=["cost"]) == ["a", "c", "d", "e"]
    assert visible(spark, restricted_roles=["financial"]) == ["a", "c", "d", "e"]
    assert visible(spark, restricted_roles=["dimension"]) == ["e"]


def test_equal_names_of_two_datasets_hide_only_their_own(spark):
    rows = spark.createDataFrame(
        [("d1", "margin", "revenue", ["region"]), ("d2", "margin", "revenue", ["channel"]), (None, "margin", "revenue", ["region"])],
        "dataset_id string, name string, measure string, slice_columns array<string>",
    )
    seen = governance.for_persona(rows, Persona.parse({"restricted_roles": ["dimension"]}), contracts(spark))
    assert [r["dataset_id"] for r in records(seen)] == ["d2"]


def test_persona_rules_on_findings(spark):
    df = spark.createDataFrame([("region", [1, 2, 3]), ("product", [4]), (None, [5, 6])], "dimension string, slices array<int>")
    def see(**rules):
        return sorted(((r["dimension"], r["slices"]) for r in records(governance.for_persona(df, Persona.parse(rules), contracts(spark)))), key=str)

    assert see(allowed_domains=["region"], max_slices=2) == [("region", [1, 2]), (None, [5, 6])]
    assert see(restricted_columns=["region"], max_slices=0) == [("product", []), (None, [])]
    assert see(restricted_roles=["dimension"]) == [(None, [5, 6])]
    assert governance.for_persona(df, Persona.parse("{}")) is df


# --- telemetry and checks --------------------------------------------------------------------------------------------


def test_call_totals_and_cost(spark):
    df = spark.createDataFrame([(1, 100, 50, 200, False), (2, 200, 80, 300, False), (3, 0, 0, 5, True)], "id int, p bigint, c bigint, latency_ms bigint, cached boolean")
    calls = df.select(
        F.col("id").alias("call_id"), F.lit("u").alias("user_id"), F.lit("k").alias("kpi_id"), F.col("p").alias("prompt_tokens"), F.col("c").alias("completion_tokens"),
        "latency_ms", telemetry.cost_usd(F.col("p"), F.col("c")).alias("cost_usd"), "cached", F.timestamp_seconds("id").alias("created_at"),
    )
    got = records(telemetry.call_totals(calls))[0]
    assert (got["total_calls"], got["total_prompt_tokens"], got["total_completion_tokens"], got["cached_calls"]) == (3, 300, 130, 1)
    assert got["total_cost_usd"] == 8.2e-5 and got["cache_hit_rate"] == pytest.approx(1 / 3)
    none = records(telemetry.call_totals(calls.limit(0)))[0]
    assert none["cache_hit_rate"] == 0.0 and none["total_cost_usd"] == 0.0 and none["avg_latency_ms"] == 0.0
    assert records(telemetry.call_ledger(calls))[0]["last_call"]["call_id"] == 3
    running = sorted((r["call_number"], r["cumulative_cost_usd"]) for r in records(telemetry.cumulative_cost(calls)))
    assert running == [(1, 3e-05), (2, 8.2e-05), (3, 8.2e-05)]
    costs = spark.range(1).select(*[telemetry.cost_usd(F.lit(a), F.lit(b)) for a, b in ((10**6, 0), (0, 10**6), (500_000, 250_000))]).first()
    assert tuple(costs) == (0.10, 0.40, 0.15)
    assert telemetry.stage_summary() == {"total_stages": 16, "llm_stages": 1, "deterministic_stages": 15}


def test_running_cost_of_one_hot_user_with_equal_times(spark):
    calls = spark.range(4000).select(
        F.col("id").alias("call_id"), F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("user_id"),
        F.timestamp_seconds(F.floor(F.col("id") / 2500)).alias("created_at"), ((F.col("id") % 7) / 1_000_000.0).alias("cost_usd"),
    ).repartition(13)
    got = {(r["user_id"], r["call_id"]): r for r in records(telemetry.cumulative_cost(calls))}
    assert len(got) == 4000
    seen = {}
    for r in sorted(records(calls), key=lambda r: (r["created_at"], r["call_id"])):
        place, total = seen.get(r["user_id"], (0, 0))
        seen[r["user_id"]] = place + 1, total + r["call_id"] % 7
        mine = got[(r["user_id"], r["call_id"])]
        assert (mine["call_number"], mine["cumulative_cost_usd"]) == (place + 1, (total + r["call_id"] % 7) / 1_000_000.0)


def test_history_bounds_and_pages(spark):
    rows = [(i, "u" if i % 2 else "v", "upload" if i % 3 else "delete", "kpi", datetime(2024, 1, 1 + i)) for i in range(20)]
    df = spark.createDataFrame(rows, "log_id int, user_id string, action_type string, target_type string, created_at timestamp")
    got = telemetry.history(df, "u", action_type="upload", since=datetime(2024, 1, 6), until=datetime(2024, 1, 12))
    assert sorted(r["log_id"] for r in records(got)) == [5, 7, 11]
    assert [r["log_id"] for r in records(telemetry.history_page(telemetry.history(df, "u"), 2, 3))] == [13, 11, 9]
    assert len(records(telemetry.history_page(telemetry.history(df, "u"), -4, 0))) == 1


def passed(df):
    return records(df)[0]["passed"]


def test_checks(spark, trend_of):
    df = spark.createDataFrame([("A", "a1", 1), ("A", "a2", 2), ("B", "b1", 2), (None, "x", 9), ("B", "a1", 4)], "p string, c string, k int")
    parents = spark.createDataFrame([(1,), (2,)], "k int")
    assert passed(checks.row_count(df, "n", at_least=5, exactly=5)) and not passed(checks.row_count(df, "n", at_least=6))
    assert not passed(checks.unique_key(df, ["k"], "n")) and passed(checks.unique_key(df, ["p", "c"], "n"))
    assert records(checks.no_orphans(df, "k", parents, "k", "n"))[0]["measured"] == 2.0
    assert passed(checks.group_count(df, ["p"], "n", 3))
    assert records(checks.consistent_hierarchy(df, "p", "c", "n"))[0]["measured"] == 2.0
    assert records(checks.consistent_hierarchy(df, "p", "c", "n", {"A": ["a1", "a2"], "B": ["b1"]}))[0]["measured"] == 1.0
    assert passed(checks.value_set(df, "p", ["B", "A"], "n")) and not passed(checks.value_set(df, "p", ["A", "B", "C"], "n"))
    trend = trend_of([10.0] * 10 + [31.0, 5.0])
    assert passed(checks.spike(trend, "k", datetime(2024, 1, 11).date(), "n")) and passed(checks.drop(trend, "k", datetime(2024, 1, 12).date(), "n"))
    assert not passed(checks.spike(trend, "k", datetime(2024, 1, 2).date(), "n"))
    shift = spark.range(100).select("id", F.when(F.col("id") < 60, 10.0).otherwise(23.0).alias("v"))
    assert passed(checks.level_shift(shift, "v", "id", 60, "n")) and not passed(checks.level_shift(shift, "v", "id", 20, "n", 3.0))
    assert passed(checks.ratio_band(df, F.col("p").isNull(), "n", 0.15, 0.25)) and passed(checks.row_tally(df, F.col("k") > 3, "n", 2))
    assert passed(checks.above_average(df, "k", F.col("k") > 3, "n", 1.4))
    both = checks.combine([checks.row_tally(df, F.col("k") > 3, "n", 2), checks.row_count(df, "m", exactly=1)])
    assert records(checks.all_passed(both)) == [{"all_passed": False, "failed": 1}]


# --- the whole analysis ----------------------------------------------------------------------------------------------


def sales(spark, days, last_factor=1.0):
    return spark.range(days * 60).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % days).cast("int")).alias("day"),
        F.element_at(F.array(F.lit("north"), F.lit("south"), F.lit("east")), (F.col("id") % 3 + 1).cast("int")).alias("region"),
        F.when(F.col("id") % 7 < 3, "online").otherwise("shop").alias("channel"),
        ((100 + F.col("id") % 13) * F.when((F.col("id") % days == days - 1) & (F.col("id") % 3 == 0), last_factor).otherwise(1.0)).alias("revenue"),
    )


def test_report_explains_a_drop(spark):
    report = movement.analyse(sales(spark, 40, 0.2), [Kpi("revenue"), Kpi("revenue", "count")], "day", ["region", "channel"], quality_score=98.0)
    text = {r["kpi"]: r["bullets"] for r in records(report.insights)}
    assert "decreased by" in text["sum(revenue)"][0] and len(text["sum(revenue)"]) == 3
    flagged = {(r["method"], r["idx"]) for r in records(report.anomalies) if r["kpi"] == "sum(revenue)"}
    assert ("control_limit_breaches", 39) in flagged
    assert {r["kpi"] for r in records(report.packages)} == {"sum(revenue)", "count(revenue)"}
    assert {r["status"] for r in records(report.validated)} == {"valid"}


def test_report_abstains_on_short_history(spark):
    report = movement.analyse(sales(spark, 4, 0.2), [Kpi("revenue")], "day", ["region"], quality_score=20.0)
    assert report.insights.count() == 0 and report.packages.count() == 0
    assert all(r["abstained"] for r in records(report.findings)) and report.anomalies.count() == 0
