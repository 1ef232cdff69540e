"""Findings, confidence, insights and recommendation packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.functions import text
from kpiloom.model import Kpi
from kpiloom.operators import drivers, findings, kpi, narrative
from kpiloom.plans import movement
from kpiloom.session import cut_lineage
from kpiloom.sources import datasets
from workload import Query, rounded, table
from workload.drivers import DIMENSIONS_SQL, ORDER_WATERFALL_SQL, did, order_waterfall
from workload.kpis import ORDER_KPIS

QUALITY = 96.5


def order_findings(spark: SparkSession, folder: str, quality: float | DataFrame | None = QUALITY) -> DataFrame:
    """Scored findings of the monthly order KPIs."""
    orders = table(spark, folder, "orders")
    statistics = cut_lineage(kpi.period_statistics(orders, ORDER_KPIS, "o_orderdate", "month"))
    checked = kpi.validate_kpis(statistics, ORDER_KPIS, orders.columns)
    slices = order_waterfall(spark, folder)
    built = findings.driver_findings(
        drivers.ranked_dimensions(slices), drivers.top_slices(slices, 12), checked, "orders-canonical", ("orders",), "2001-08-02"
    )
    return findings.apply_confidence(built, quality)


def finding_rows(spark: SparkSession, folder: str, quality: float | DataFrame | None) -> DataFrame:
    rows = order_findings(spark, folder, quality)
    return rows.select(
        "finding_id", "kpi", "finding_type", "dimension", "dimension_rank", F.size("slices").cast("bigint").alias("slice_count"),
        "statistic", F.col("confidence.level").alias("level"), "abstained", F.array_join("confidence.reasons", "; ").alias("reasons"),
        F.array_join("confidence.missing_evidence", "; ").alias("missing"), F.array_join("evidence.lineage", "; ").alias("lineage"),
    )


def finding_sql(quality: str, shown: str, score: str, missing: str) -> str:
    return ORDER_WATERFALL_SQL + DIMENSIONS_SQL + f""", first AS (SELECT kpi, dimension, slice, contribution, share_pct, direction FROM drv
    QUALIFY row_number() OVER (PARTITION BY kpi, dimension ORDER BY abs(contribution) DESC, slice) = 1),
cnt AS (SELECT count(DISTINCT date_trunc('month', o_orderdate)) AS periods FROM orders),
f AS (SELECT d.*, periods, {rounded('contribution', 4)} AS statistic, least(slice_count, 12) AS shown_slices,
    {score} * 0.30 + 0.55 * 0.30 + 1.0 * 0.25 + 0.7 * 0.15 AS composite
  FROM ranked_dims d JOIN first USING (kpi, dimension), cnt),
l AS (SELECT *, CASE WHEN composite < 0.5 THEN 'abstain' WHEN composite >= 0.8 THEN 'high' WHEN composite >= 0.65 THEN 'medium' ELSE 'low' END AS level FROM f)
SELECT sha256('finding:' || kpi || ':driver_contribution:dimension:' || dimension) AS finding_id, kpi, 'driver_contribution' AS finding_type,
  CASE WHEN level <> 'abstain' THEN dimension END AS dimension, CASE WHEN level <> 'abstain' THEN dimension_rank END AS dimension_rank,
  CASE WHEN level <> 'abstain' THEN shown_slices END AS slice_count, CASE WHEN level <> 'abstain' THEN statistic END AS statistic, level, level = 'abstain' AS abstained,
  '{shown}; deterministic method, no inferential p-value; sufficient sample (' || periods || ' periods); single method, uncorroborated; composite evidence score '
    || printf('%.2f', composite) || CASE WHEN level = 'abstain' THEN ' below 0.5' ELSE '' END AS reasons,
  '{missing}corroboration from a second detection method' AS missing,
  'sources: orders; canonical dataset orders-canonical; KPI ' || kpi || '; driver decomposition across dimension ''' || dimension || '''' AS lineage FROM l"""


def short_history(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of a KPI that exists for five days only, which abstain at low quality."""
    day = F.to_date("o_orderdate")
    orders = table(spark, folder, "orders").withColumn("late_price", F.when(day.between("2001-07-10", "2001-07-14"), F.col("o_totalprice")))
    late = [Kpi("late_price", "avg", scale=2)]
    statistics = cut_lineage(kpi.period_statistics(orders, late, "o_orderdate"))
    trend = kpi.trend_points(statistics)
    slices = drivers.decompose(orders, drivers.latest_movements(trend, late), ["o_orderstatus", "o_orderpriority"], "o_orderdate")
    built = findings.driver_findings(
        drivers.ranked_dimensions(slices), drivers.top_slices(slices, 12), kpi.validate_kpis(statistics, late, orders.columns)
    )
    return findings.apply_confidence(built, 30.0).select(
        "finding_id", "kpi", "dimension", "abstained", "message", F.col("confidence.level").alias("level"),
        F.array_join("confidence.reasons", "; ").alias("reasons"),
    )


SHORT_SQL = """SELECT sha256('finding:avg(late_price):driver_contribution:dimension:' || d) AS finding_id, 'avg(late_price)' AS kpi, NULL::VARCHAR AS dimension, true AS abstained,
  'Insufficient or contradictory evidence — abstaining from a conclusion.' AS message, 'abstain' AS level,
  'data-quality score 30.0/100; deterministic method, no inferential p-value; low-data KPI (' || n || ' periods); single method, uncorroborated; composite evidence score 0.37 below 0.5' AS reasons
FROM (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) AS n FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2001-07-10' AND DATE '2001-07-14'),
  (VALUES ('o_orderstatus'), ('o_orderpriority')) t(d)"""


def graded_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence of one finding per order line, with evidence drawn from its columns, counted by outcome."""
    n = F.col("l_linenumber")
    methods = F.when(n == 7, F.array(_method("a", "up"), _method("b", "down"))).when(
        n >= 4, F.array(_method("a", "up"))
    ).otherwise(F.array().cast("array<struct<method:string,direction:string>>"))
    lines = table(spark, folder, "lineitem").select(
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity") * 2.0).alias("quality_score"),
        F.when(n % 3 == 0, F.col("l_tax") * 4.0).alias("p_value"),
        F.when(n % 3 == 1, F.col("l_discount") * -10.0).alias("effect_size"),
        F.when(n != 5, F.col("l_extendedprice")).alias("statistic"),
        F.when(F.col("l_linestatus") == "O", "valid").when(n % 2 == 0, "low-data").when(n == 3, "invalid").alias("kpi_status"),
        F.when(n != 1, F.col("l_suppkey") % 16).alias("period_count"), methods.alias("corroborating_methods"),
    )
    scored = findings.score_confidence(lines)
    kept = F.size("confidence.missing_evidence").cast("bigint")
    return scored.groupBy(F.col("confidence.level").alias("level"), F.col("confidence.reasons")[1].alias("strength"),
                          F.col("confidence.reasons")[2].alias("sample"), kept.alias("missing")).agg(F.count(F.lit(1)).alias("findings"))


def _method(name: str, way: str):
    return F.struct(F.lit(name).alias("method"), F.lit(way).alias("direction"))


GRADED_SQL = """WITH e AS (SELECT CASE WHEN l_returnflag <> 'R' THEN l_quantity * 2.0 END AS q, CASE WHEN l_linenumber % 3 = 0 THEN l_tax * 4.0 END AS p,
  CASE WHEN l_linenumber % 3 = 1 THEN abs(l_discount * -10.0) END AS ef, l_linenumber <> 5 AS has_stat,
  CASE WHEN l_linestatus = 'O' THEN 'valid' WHEN l_linenumber % 2 = 0 THEN 'low-data' WHEN l_linenumber = 3 THEN 'invalid' END AS st,
  CASE WHEN l_linenumber <> 1 THEN l_suppkey % 16 END AS n, CASE WHEN l_linenumber = 7 THEN 2 WHEN l_linenumber >= 4 THEN 1 ELSE 0 END AS m,
  CASE WHEN l_linenumber % 3 = 1 THEN l_discount * -10.0 END AS raw_ef FROM lineitem),
s AS (SELECT *, CASE WHEN q IS NULL THEN 0.0 ELSE greatest(least((q - 40.0) / 60.0, 1.0), 0.0) END AS qs,
  CASE WHEN p IS NOT NULL THEN CASE WHEN p <= 0.05 THEN 1.0 WHEN p <= 0.20 THEN 0.6 ELSE 0.2 END
       WHEN ef IS NOT NULL THEN CASE WHEN ef >= 0.8 THEN 1.0 WHEN ef >= 0.5 THEN 0.6 ELSE 0.2 END
       WHEN has_stat THEN 0.55 ELSE 0.0 END AS ss,
  CASE WHEN st = 'invalid' OR (st IS NULL AND n IS NULL) THEN 0.0 WHEN st = 'low-data' THEN 0.4 WHEN n IS NULL OR n >= 8 THEN 1.0 ELSE 0.4 END AS ns,
  CASE m WHEN 0 THEN 0.7 WHEN 1 THEN 1.0 ELSE 0.0 END AS ag,
  CASE WHEN st = 'invalid' OR (st IS NULL AND n IS NULL) THEN 'underlying KPI is invalid' WHEN st = 'low-data' THEN 'low-data KPI (' || coalesce(n, 7) || ' periods)'
       WHEN n IS NULL THEN 'KPI validation passed' WHEN n >= 8 THEN 'sufficient sample (' || n || ' periods)' ELSE 'only ' || n || ' periods' END AS sample,
  CASE WHEN coalesce(p, ef) IS NULL THEN CASE WHEN has_stat THEN 'deterministic method, no inferential p-value' ELSE 'no statistical evidence attached' END
       ELSE CASE WHEN p IS NOT NULL THEN CASE WHEN p <= 0.05 THEN 'strong' WHEN p <= 0.20 THEN 'moderate' ELSE 'weak' END
                 ELSE CASE WHEN ef >= 0.8 THEN 'strong' WHEN ef >= 0.5 THEN 'moderate' ELSE 'weak' END END
            || ' significance (p/effect ' || printf('%.4f', coalesce(p, raw_ef)) || ')' END AS strength FROM e),
c AS (SELECT *, CAST(qs AS DOUBLE) * 0.30 + CAST(ss AS DOUBLE) * 0.30 + CAST(ns AS DOUBLE) * 0.25 + CAST(ag AS DOUBLE) * 0.15 AS composite,
  (CASE WHEN q IS NULL OR q < 60 THEN 1 ELSE 0 END) + (CASE WHEN ss = 0.2 OR ss = 0.0 THEN 1 ELSE 0 END)
  + (CASE WHEN ns = 0.4 THEN 1 ELSE 0 END) + (CASE WHEN m = 0 THEN 1 ELSE 0 END) AS noted FROM s)
SELECT CASE WHEN m = 2 OR composite < 0.5 THEN 'abstain' WHEN composite >= 0.8 THEN 'high' WHEN composite >= 0.65 THEN 'medium' ELSE 'low' END AS level,
  strength, sample, CAST(CASE WHEN m = 2 THEN 1 WHEN composite < 0.5 AND noted = 0 THEN 1 ELSE noted END AS BIGINT) AS missing, count(*) AS findings
FROM c GROUP BY ALL"""


def insight_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = narrative.insights(order_findings(spark, folder))
    return rows.select("insight_id", "kpi", F.array_join("bullets", "\n").alias("bullets"), "paragraph", "level")


_LEADING_SQL = ORDER_WATERFALL_SQL + DIMENSIONS_SQL + f""", lead AS (SELECT d.*, f.slice, {rounded('f.contribution', 4)} AS contribution,
    {rounded('f.share_pct', 2)} AS share_pct, f.direction, {rounded('d.total_movement', 4)} AS moved FROM ranked_dims d JOIN (
    SELECT * FROM drv QUALIFY row_number() OVER (PARTITION BY kpi, dimension ORDER BY abs(contribution) DESC, slice) = 1) f USING (kpi, dimension)
  WHERE dimension_rank = 1)"""

INSIGHT_SQL = _LEADING_SQL + """, said AS (SELECT kpi,
  kpi || ' ' || CASE WHEN moved > 0 THEN 'increased by ' ELSE 'decreased by ' END || format('{:,.2f}', moved)
    || ' (' || printf('%+.1f', (after_value - before_value) / abs(before_value) * 100) || '%).' AS b1,
  'Top driver: ' || dimension || ' = ''' || slice || ''' contributed ' || format('{:,.2f}', contribution) || ' (' || direction || '), '
    || printf('%.1f', share_pct) || '% of the total movement.' AS b2, 'Confidence: high-confidence.' AS b3 FROM lead)
SELECT sha256('insight:' || kpi) AS insight_id, kpi, b1 || chr(10) || b2 || chr(10) || b3 AS bullets, b1 || ' ' || b2 || ' ' || b3 AS paragraph, 'high' AS level FROM said"""


def package_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = narrative.recommendation_packages(order_findings(spark, folder))
    p = F.col("package")
    return rows.select(
        "package_id", "kpi", p["driver"]["dimension"].alias("dimension"), p["driver"]["type"].alias("driver_type"),
        p["controllable_lever"].alias("lever"), p["owner"].alias("owner"), p["expected_impact"].alias("expected_impact"),
        p["monitoring_plan"].alias("monitoring_plan"), p["confidence"]["level"].alias("level"),
    )


PACKAGE_SQL = _LEADING_SQL + """ SELECT sha256('package:' || kpi) AS package_id, kpi, dimension, 'volume' AS driver_type, 'Demand generation & traffic' AS lever,
  'category_manager' AS owner, '''' || slice || ''' in ' || dimension || ' contributed ' || format('{:,.2f}', contribution) || ' (' || printf('%.1f', share_pct)
    || '% of the ' || format('{:,.2f}', total_movement) || ' total movement) from ' || before_period || ' to ' || after_period AS expected_impact,
  'Track order volume and conversion rate weekly after the action is taken; compare the next period-over-period movement in ' || dimension
    || ' against the ' || format('{:,.2f}', contribution) || ' contribution baseline' AS monitoring_plan, 'high' AS level FROM lead"""


def package_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Hash and prompt of every package, built twice to show that they do not depend on the run."""
    rows = narrative.recommendation_packages(order_findings(spark, folder))
    return rows.select("kpi", "package_hash", "package_json", narrative.prompt(F.col("package")).alias("prompt"))


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    rows = narrative.recommendation_packages(order_findings(spark, folder))
    return rows.select("kpi", narrative.prompt(F.col("package")).alias("prompt"))


def _plain(value: str) -> str:
    return f"regexp_replace(CAST(CAST({value} AS DECIMAL(34,4)) AS VARCHAR), '(\\.\\d+?)0+$', '\\1')"


def _quoted(words: str) -> str:
    return "'" + words.replace("'", "''") + "'"


PROMPT_SQL = f"""WITH p AS ({PACKAGE_SQL}), l AS ({_LEADING_SQL} SELECT kpi, slice, direction, contribution, share_pct FROM lead)
SELECT kpi, {_quoted(narrative.PROMPT_RULES)} || chr(10) || chr(10) || 'Structured facts:' || chr(10) || 'KPI movement summary: ' || expected_impact || chr(10)
  || 'Driver: ' || dimension || ' = ''' || slice || ''' (type volume, direction ' || direction || ', contribution ' || {_plain('contribution')}
  || ', ' || {_plain('share_pct')} || '% of total movement)' || chr(10) || 'Controllable lever: ' || lever || chr(10)
  || 'Candidate action: ' || {_quoted(narrative.LEVERS['volume'][1])} || chr(10) || 'Expected impact: ' || expected_impact || chr(10)
  || 'Accountable owner: ' || owner || chr(10) || 'Confidence level: ' || level || chr(10) || 'Monitoring plan: ' || monitoring_plan
  || chr(10) || chr(10) || 'Bulleted recommendation:' AS prompt FROM p JOIN l USING (kpi)"""


def rejected(spark: SparkSession, folder: str) -> DataFrame:
    """Why findings without quality report give no package."""
    rows = narrative.rejection_reason(order_findings(spark, folder, None))
    return rows.groupBy("rejection").agg(F.count(F.lit(1)).alias("findings"))


def part_types(spark: SparkSession, folder: str) -> DataFrame:
    """Driver type, lever and owner for names made from part names and types."""
    part = table(spark, folder, "part")
    words = F.array(F.lit("PRICE"), F.lit("day_of"), F.lit("Supplier"), F.lit("market"), F.lit("sku_"), F.lit("review"), F.lit("x"))
    name = F.concat(F.element_at(words, (F.col("p_partkey") % 7 + 1).cast("int")), F.lit("_"), F.col("p_type"))
    kind = narrative.driver_type(name)
    lever = narrative.lever(kind)
    return part.select(name.alias("dimension"), kind.alias("driver_type"), lever["lever"].alias("lever"), narrative.owner_of(lever["lever"]).alias("owner")).groupBy(
        "dimension", "driver_type", "lever", "owner"
    ).agg(F.count(F.lit(1)).alias("parts"))


def _types_sql() -> str:
    cases = " ".join(f"WHEN contains(lower(dimension), '{k}') THEN '{t}'" for k, t in narrative.DRIVER_KEYWORDS)
    levers = ", ".join(f"('{t}', '{entry[0]}', '{entry[2]}')" for t, entry in narrative.LEVERS.items())
    return f"""WITH d AS (SELECT ['PRICE', 'day_of', 'Supplier', 'market', 'sku_', 'review', 'x'][p_partkey % 7 + 1] || '_' || p_type AS dimension FROM part),
t AS (SELECT dimension, CASE {cases} ELSE 'other' END AS driver_type FROM d)
SELECT dimension, driver_type, lever, owner, count(*) AS parts FROM t JOIN (VALUES {levers}) l(driver_type, lever, owner) USING (driver_type) GROUP BY ALL"""


def parsed_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of conversation texts read as bulleted answers."""
    turns = table(spark, folder, "conversations").withColumn("bullet", F.explode(text.bullets(F.col("text"))))
    return turns.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("bullets"), F.sum(F.length("bullet")).alias("characters"))


BULLETS_SQL = r"""WITH l AS (SELECT conv_id, turn, text, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line FROM conversations),
s AS (SELECT conv_id, turn, text, trim(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^[-*•]+', '')) AS x FROM l),
u AS (SELECT conv_id, turn, text, trim(CASE WHEN length(x) > 2 THEN regexp_replace(x, '^\d[.)]', '') ELSE x END) AS x FROM s)
SELECT conv_id, turn, CASE WHEN count(*) FILTER (length(x) > 0) = 0 THEN 1 ELSE count(*) FILTER (length(x) > 0) END AS bullets,
  CASE WHEN count(*) FILTER (length(x) > 0) = 0 THEN max(length(trim(text))) ELSE CAST(sum(length(x)) FILTER (length(x) > 0) AS BIGINT) END AS characters
FROM u GROUP BY conv_id, turn"""


def causal_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """The difference-in-differences finding with its confidence."""
    built = findings.causal_findings(did(spark, folder), "sum(o_totalprice)", "valid", "orders-canonical", ("orders",), "2001-08-02")
    scored = findings.apply_confidence(built, QUALITY)
    return scored.select("finding_id", "kpi", "did_estimate", "p_value", "effect_size", "abstained", F.col("confidence.level").alias("level"))


def full_report(spark: SparkSession, folder: str) -> DataFrame:
    """The whole analysis of orders, shown as the insight of every KPI."""
    report = movement.analyse(
        table(spark, folder, "orders"), ORDER_KPIS, "o_orderdate", ["o_orderstatus", "o_orderpriority"], "month", QUALITY,
        dataset_id="orders-canonical", source_ids=("orders",), source_freshness="2001-08-02",
    )
    return report.insights.select("insight_id", "kpi", F.array_join("bullets", "\n").alias("bullets"), "paragraph", "level")


def by_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """The findings with the score of the weakest source of their dataset."""
    members = spark.createDataFrame([("orders-canonical", ["orders", "customer"]), ("other", ["customer"])], "dataset_id string, source_ids array<string>")
    reports = spark.createDataFrame([("orders", QUALITY), ("customer", 12.0)], "source_id string, score double")
    return finding_rows(spark, folder, datasets.weakest_quality(members, reports))


QUERIES = {
    "findings_by_dataset_quality": Query(
        by_dataset, finding_sql("12", "data-quality score 12.0/100", "0.0", "underlying data quality above 60 (currently 12.0); ")
    ),
    "driver_findings": Query(
        lambda s, f: finding_rows(s, f, QUALITY), finding_sql("96.5", "data-quality score 96.5/100", "((96.5 - 40.0) / 60.0)", "")
    ),
    "driver_findings_low_quality": Query(
        lambda s, f: finding_rows(s, f, 12.0),
        finding_sql("12", "data-quality score 12.0/100", "0.0", "underlying data quality above 60 (currently 12.0); "),
    ),
    "driver_findings_abstained": Query(short_history, SHORT_SQL),
    "confidence_levels": Query(graded_lines, GRADED_SQL),
    "causal_finding": Query(causal_confidence),
    "insights": Query(insight_rows, INSIGHT_SQL),
    "movement_report": Query(full_report, INSIGHT_SQL),
    "recommendation_packages": Query(package_rows, PACKAGE_SQL),
    "package_rejections": Query(
        rejected, ORDER_WATERFALL_SQL + DIMENSIONS_SQL
        + " SELECT NULL::VARCHAR AS rejection, count(*) AS findings FROM ranked_dims WHERE 0 * 0.30 + 0.55 * 0.30 + 0.25 + 0.7 * 0.15 >= 0.5"
    ),
    "package_texts": Query(package_texts),
    "package_prompts": Query(prompts, PROMPT_SQL),
    "driver_types": Query(part_types, _types_sql()),
    "answer_bullets": Query(parsed_answers, BULLETS_SQL),
}
