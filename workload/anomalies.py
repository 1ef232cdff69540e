"""Detectors and their mutual support."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.operators import anomaly, findings, kpi, long_series
from kpiloom.session import cut_lineage
from workload import Query, table
from workload.kpis import LINEITEM_KPIS, lineitem_trend, lineitem_trend_sql

SLICES = ("l_returnflag", "l_linestatus")


def daily(spark: SparkSession, folder: str) -> DataFrame:
    return lineitem_trend(spark, folder)


def two_methods(spark: SparkSession, folder: str) -> DataFrame:
    """Marks of the two window methods, which SQL can express."""
    return anomaly.marks(daily(spark, folder), change_points=False)


FLAGS_SQL = """, lim AS (SELECT *, count(value) OVER (PARTITION BY kpi) AS n, count(value) OVER w AS c,
    list(value) OVER w AS l, list_sum(list(value) OVER w) / 7.0 AS m
  FROM trend WINDOW w AS (PARTITION BY kpi ORDER BY idx ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
breaches AS (SELECT kpi, 'control_limit_breaches' AS method, idx, period, value FROM lim WHERE c = 7 AND n >= 8
    AND abs(value - m) > 3.0 * sqrt(list_sum(list_transform(l, lambda x: (x - m) * (x - m))) / 6.0)),
med AS (SELECT kpi, median(value) AS med, count(value) AS n FROM trend GROUP BY kpi),
dist AS (SELECT t.*, med, n, abs(value - med) AS dist FROM trend t JOIN med USING (kpi)),
mad AS (SELECT kpi, median(dist) AS mad FROM dist GROUP BY kpi),
outliers AS (SELECT kpi, 'outliers' AS method, idx, period, value FROM dist JOIN mad USING (kpi)
  WHERE n >= 8 AND mad > 0 AND abs(0.6745 * (value - med) / mad) > 3.5),
flags AS (SELECT * FROM breaches UNION ALL SELECT * FROM outliers),
near AS (SELECT kpi, idx, value, list_concat(
    list(value) OVER (PARTITION BY kpi ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
    list(value) OVER (PARTITION BY kpi ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) AS l FROM trend),
dir AS (SELECT kpi, idx, value, list_sum(l) / nullif(len(l), 0) AS local_mean FROM near),
directed AS (SELECT kpi, idx, local_mean, CASE WHEN value > local_mean THEN 'up' WHEN value < local_mean THEN 'down' ELSE 'flat' END AS direction FROM dir)"""

SUPPORT_SQL = """, own AS (SELECT f.*, direction FROM flags f JOIN directed USING (kpi, idx)),
sup AS (SELECT a.*, b.method AS other_method, b.direction AS other_direction, b.idx AS other_idx
  FROM own a LEFT JOIN own b ON a.kpi = b.kpi AND abs(a.idx - b.idx) <= 1 AND a.method <> b.method)"""


FLAG_TABLE_SQL = """ SELECT kpi, idx, period, value, false AS change_points,
  bool_or(method = 'control_limit_breaches') AS control_limit_breaches, bool_or(method = 'outliers') AS outliers FROM flags GROUP BY ALL"""


def change_points(spark: SparkSession, folder: str) -> DataFrame:
    """Change points of weekly revenue in every slice, with prices half as high again from June 1998 on."""
    repriced = table(spark, folder, "lineitem").withColumn(
        "l_extendedprice",
        F.when(F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp_ntz"), F.col("l_extendedprice") * 1.5).otherwise(
            F.col("l_extendedprice")
        ),
    )
    trend = kpi.kpi_trend(repriced, LINEITEM_KPIS, "l_shipdate", "week", SLICES)
    return anomaly.level_shifts(trend, SLICES)


def findings_with_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """All three methods on weekly KPIs, as findings that may abstain."""
    lineitem = table(spark, folder, "lineitem")
    statistics = cut_lineage(kpi.period_statistics(lineitem, LINEITEM_KPIS, "l_shipdate", "week"))
    trend = kpi.trend_points(statistics)
    checked = kpi.validate_kpis(statistics, LINEITEM_KPIS, lineitem.columns)
    found = anomaly.anomaly_findings(anomaly.marks(trend), checked)
    scored = findings.apply_confidence(found, 91.5)
    return scored.select(
        "kpi", "finding_key", "finding_type", "period", "direction", "abstained", "message",
        F.col("confidence.level").alias("level"), F.array_join("confidence.reasons", "; ").alias("reasons"),
    )


def finding_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence of the findings of the two window detectors on daily KPIs."""
    lineitem = table(spark, folder, "lineitem")
    statistics = cut_lineage(kpi.period_statistics(lineitem, LINEITEM_KPIS, "l_shipdate"))
    trend = kpi.trend_points(statistics)
    checked = kpi.validate_kpis(statistics, LINEITEM_KPIS, lineitem.columns)
    scored = findings.score_confidence(
        anomaly.anomaly_findings(anomaly.marks(trend, change_points=False), checked).withColumn("quality_score", F.lit(91.0))
    )
    return scored.select(
        "kpi", "method", "idx", "direction", "kpi_status", "period_count",
        F.size("corroborating_methods").cast("bigint").alias("support"), F.col("confidence.level").alias("level"),
    )


LEVELS_SQL = SUPPORT_SQL + """, grp AS (SELECT kpi, method, idx, direction, count(other_method) AS support,
    count(DISTINCT other_direction) AS directions FROM sup GROUP BY ALL),
n AS (SELECT kpi, count(*) AS period_count FROM trend GROUP BY kpi),
sc AS (SELECT grp.*, period_count, ((91.0 - 40.0) / 60.0) * 0.30 + 0.55 * 0.30 + 1.0 * 0.25
   + CASE WHEN support = 0 THEN 0.7 WHEN directions > 1 THEN 0.0 ELSE 1.0 END * 0.15 AS composite FROM grp JOIN n USING (kpi))
SELECT kpi, method, idx, direction, 'valid' AS kpi_status, period_count, support,
  CASE WHEN directions > 1 OR composite < 0.5 THEN 'abstain' WHEN composite >= 0.8 THEN 'high' WHEN composite >= 0.65 THEN 'medium' ELSE 'low' END AS level
FROM sc"""


def long_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Every event a period of its type's series, judged by ranges of 300 periods with halo rows."""
    points = table(spark, folder, "events").select(F.col("event_type").alias("kpi"), F.col("event_id").alias("period"), "value")
    rated = long_series.marks(long_series.trend_points(points), range_rows=300)
    return rated.filter(F.col("control_limit_breaches") | F.col("outliers") | (F.col("idx") % 100 == 0))


LONG_SQL = ("WITH trend AS (SELECT event_type AS kpi, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx, event_id AS period, value FROM events)"
  + FLAGS_SQL + """, marked AS (SELECT t.kpi, t.idx, t.period, t.value, direction, false AS change_points,
  (kpi, idx) IN (SELECT (kpi, idx) FROM breaches) AS control_limit_breaches, (kpi, idx) IN (SELECT (kpi, idx) FROM outliers) AS outliers
  FROM trend t JOIN directed USING (kpi, idx))
SELECT * FROM marked WHERE control_limit_breaches OR outliers OR idx % 100 = 0""")


def evidence_records(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of the findings of the two window detectors."""
    lineitem = table(spark, folder, "lineitem")
    statistics = cut_lineage(kpi.period_statistics(lineitem, LINEITEM_KPIS, "l_shipdate"))
    checked = kpi.validate_kpis(statistics, LINEITEM_KPIS, lineitem.columns)
    marked = anomaly.marks(kpi.trend_points(statistics), change_points=False)
    found = anomaly.anomaly_findings(marked, checked, (), "lineitem-canonical", "1998-12-01")
    return found.select(
        "kpi", "dataset_id", "finding_key", F.col("evidence.finding_type").alias("finding_type"), F.col("evidence.method").alias("method"),
        F.col("evidence.statistic").alias("statistic"), F.col("evidence.source_freshness").alias("source_freshness"),
        F.array_join("evidence.lineage", "; ").alias("lineage"),
    )


EVIDENCE_SQL = """ SELECT kpi, 'lineitem-canonical' AS dataset_id, 'anomaly:' || method || ':' || idx AS finding_key, 'anomaly_' || method AS finding_type,
  label AS method, value AS statistic, '1998-12-01' AS source_freshness,
  'KPI ' || kpi || '; detector: ' || label || ' at trend index ' || idx || '; period: ' || CAST(period AS DATE) AS lineage
FROM flags JOIN (VALUES ('control_limit_breaches', '±3σ trailing control-limit breach'), ('outliers', 'MAD outlier (modified z > 3.5)')) t(method, label) USING (method)"""


QUERIES = {
    "long_series_marks": Query(long_marks, LONG_SQL),
    "anomaly_evidence": Query(evidence_records, lineitem_trend_sql() + FLAGS_SQL + EVIDENCE_SQL),
    "control_limits": Query(
        lambda s, f: anomaly.control_limit_breaches(daily(s, f)), lineitem_trend_sql() + FLAGS_SQL + " SELECT * FROM breaches"
    ),
    "mad_outliers": Query(
        lambda s, f: anomaly.mad_outliers(daily(s, f)), lineitem_trend_sql() + FLAGS_SQL + " SELECT * FROM outliers"
    ),
    "local_direction": Query(
        lambda s, f: anomaly.local_direction(daily(s, f)).select("kpi", "idx", "local_mean", "direction"),
        lineitem_trend_sql() + FLAGS_SQL + " SELECT * FROM directed",
    ),
    "anomaly_corroboration": Query(
        lambda s, f: anomaly.corroborated(two_methods(s, f)),
        lineitem_trend_sql() + FLAGS_SQL + SUPPORT_SQL + " SELECT * FROM sup",
    ),
    "anomaly_method_counts": Query(
        lambda s, f: anomaly.method_counts(anomaly.flags_of(two_methods(s, f)), ("kpi",)),
        lineitem_trend_sql() + FLAGS_SQL + " SELECT kpi, method, count(*) AS flags FROM flags GROUP BY ALL",
    ),
    "anomaly_flag_table": Query(
        lambda s, f: anomaly.flag_table(two_methods(s, f)),
        lineitem_trend_sql() + FLAGS_SQL + FLAG_TABLE_SQL,
    ),
    "anomaly_flag_pivot": Query(
        lambda s, f: anomaly.pivot_flags(anomaly.flags_of(two_methods(s, f))), lineitem_trend_sql() + FLAGS_SQL + FLAG_TABLE_SQL
    ),
    "anomaly_confidence_levels": Query(finding_levels, lineitem_trend_sql() + FLAGS_SQL + LEVELS_SQL),
    "anomaly_findings": Query(findings_with_confidence),
    "change_points": Query(change_points),
}
