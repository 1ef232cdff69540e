"""Trends, summaries, materiality, validation and discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.model import Kpi
from kpiloom.operators import contract, drivers, kpi, materiality, profile
from kpiloom.session import cut_lineage
from workload import Query, small_total, table

LINEITEM_KPIS = [
    Kpi("l_extendedprice", "sum", scale=2),
    Kpi("l_quantity", "count", scale=2),
    Kpi("l_discount", "avg", scale=2),
    Kpi("l_tax", "rate", scale=2),
]
ORDER_KPIS = [Kpi("o_totalprice", "sum", scale=2), Kpi("o_orderkey", "count")]


def lineitem_trend(spark: SparkSession, folder: str, grain: str = "day", by: tuple[str, ...] = ()) -> DataFrame:
    return kpi.kpi_trend(table(spark, folder, "lineitem"), LINEITEM_KPIS, "l_shipdate", grain, by)


def order_trend(spark: SparkSession, folder: str, grain: str = "month") -> DataFrame:
    return kpi.kpi_trend(table(spark, folder, "orders"), ORDER_KPIS, "o_orderdate", grain)


def order_materiality(spark: SparkSession, folder: str) -> DataFrame:
    summary = kpi.summarize(order_trend(spark, folder))
    scored = materiality.score_materiality(summary)
    return materiality.by_materiality(scored.withColumn("prior_std", F.round("prior_std", 3)).drop("sigmas"))


# --- the same in SQL -------------------------------------------------------------------------------------------------

_LINEITEM_VALUES = """
  SELECT {keys} CAST({period} AS DATE) AS period,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS a,
         CAST(count(l_quantity) AS DOUBLE) AS b,
         CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(l_discount) AS c,
         CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(l_tax) AS d
  FROM lineitem GROUP BY ALL
"""
_LINEITEM_LONG = """
  SELECT {keys} 'sum(l_extendedprice)' AS kpi, period, a AS value FROM w
  UNION ALL SELECT {keys} 'count(l_quantity)', period, b FROM w
  UNION ALL SELECT {keys} 'avg(l_discount)', period, c FROM w
  UNION ALL SELECT {keys} 'rate(l_tax)', period, d FROM w
"""


def lineitem_trend_sql(period: str = "l_shipdate", keys: str = "") -> str:
    """CTEs ending in ``trend``: kpi, keys, idx, period, value."""
    cols = f"{keys}, " if keys else ""
    return f"""WITH w AS ({_LINEITEM_VALUES.format(keys=cols, period=period)}),
long AS ({_LINEITEM_LONG.format(keys=cols)}),
trend AS (SELECT kpi, {cols} row_number() OVER (PARTITION BY kpi{', ' + keys if keys else ''} ORDER BY period) - 1 AS idx,
                 period, value FROM long)"""


ORDER_TREND_SQL = """WITH w AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS a, CAST(count(o_orderkey) AS DOUBLE) AS b
  FROM orders GROUP BY 1),
long AS (SELECT 'sum(o_totalprice)' AS kpi, period, a AS value FROM w
         UNION ALL SELECT 'count(o_orderkey)', period, b FROM w),
trend AS (SELECT kpi, row_number() OVER (PARTITION BY kpi ORDER BY period) - 1 AS idx, period, value FROM long)"""

SUMMARY_SQL = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY kpi ORDER BY period DESC) AS back FROM trend),
summary AS (
  SELECT kpi, max(period) FILTER (back = 1) AS period, max(value) FILTER (back = 1) AS value,
         {small_total('value', 'back BETWEEN 2 AND 8')}
           / nullif(count(value) FILTER (back BETWEEN 2 AND 8), 0) AS baseline,
         {small_total('value')} / count(value) AS benchmark,
         stddev_samp(value) FILTER (back > 1) AS prior_std,
         count(*) AS period_count
  FROM ranked GROUP BY kpi)"""

MATERIALITY_SQL = """moved AS (
  SELECT *, CASE WHEN coalesce(prior_std, 0) > 0 THEN abs(value - baseline) / prior_std
                 WHEN abs(value - baseline) > 0 THEN 10.0 ELSE 0.0 END AS s FROM summary),
scored AS (
  SELECT kpi, period, value, baseline, benchmark, round(prior_std, 3) AS prior_std, period_count,
         CASE WHEN value IS NULL OR baseline IS NULL OR period_count < 2 THEN 0.0 ELSE
           CAST(printf('%.4f', CAST(least(s * (0.5 * least(s / 3.0, 1.0) + 0.5 * CASE WHEN s >= 1.0 THEN 1.0 ELSE s END), 10.0) AS DOUBLE)) AS DOUBLE) END AS materiality
  FROM moved)"""


def _validation_kpis() -> list[Kpi]:
    return [
        Kpi("o_totalprice", "sum", scale=2), Kpi("o_totalprice", "avg", scale=2), Kpi("o_orderstatus", "count"),
        Kpi("no_such_column", "sum"), Kpi("always_null", "sum"), Kpi("always_zero", "rate"), Kpi("last_week_only", "avg", scale=2),
        Kpi("one_day_only", "avg", scale=2),
    ]


def _validation_frame(spark: SparkSession, folder: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, folder, "orders").withColumns({
        "always_null": F.lit(None).cast("double"),
        "always_zero": F.lit(0.0),
        "last_week_only": F.when(day.between("2001-07-01", "2001-07-05"), F.col("o_totalprice")),
        "one_day_only": F.when(day == "2001-07-01", F.col("o_totalprice")),
    })


def validation(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    frame = _validation_frame(spark, folder)
    statistics = cut_lineage(kpi.period_statistics(frame, _validation_kpis(), "o_orderdate"))
    return kpi.validate_kpis(statistics, _validation_kpis(), frame.columns), statistics


VALIDATION_SQL = """WITH f AS (
  SELECT *, CAST(o_orderdate AS DATE) AS d,
         CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '2001-07-01' AND DATE '2001-07-05' THEN o_totalprice END AS lw,
         CASE WHEN CAST(o_orderdate AS DATE) = DATE '2001-07-01' THEN o_totalprice END AS od FROM orders),
m AS (
  SELECT 'sum(o_totalprice)' AS kpi, 'o_totalprice' AS measure, 'sum' AS aggregation, true AS has,
         count(DISTINCT d) AS periods, count(o_totalprice) AS n, max(abs(o_totalprice)) AS x FROM f
  UNION ALL SELECT 'avg(o_totalprice)', 'o_totalprice', 'avg', true, count(DISTINCT d) FILTER (o_totalprice IS NOT NULL),
         count(o_totalprice), max(abs(o_totalprice)) FROM f
  UNION ALL SELECT 'count(o_orderstatus)', 'o_orderstatus', 'count', true, count(DISTINCT d), count(o_orderstatus), NULL FROM f
  UNION ALL SELECT 'sum(no_such_column)', 'no_such_column', 'sum', false, 0, 0, NULL
  UNION ALL SELECT 'sum(always_null)', 'always_null', 'sum', true, count(DISTINCT d), 0, NULL FROM f
  UNION ALL SELECT 'rate(always_zero)', 'always_zero', 'rate', true, count(DISTINCT d), count(*), 0.0 FROM f
  UNION ALL SELECT 'avg(last_week_only)', 'last_week_only', 'avg', true, count(DISTINCT d) FILTER (lw IS NOT NULL), count(lw), max(abs(lw)) FROM f
  UNION ALL SELECT 'avg(one_day_only)', 'one_day_only', 'avg', true, count(DISTINCT d) FILTER (od IS NOT NULL), count(od), max(abs(od)) FROM f),
v AS (SELECT kpi, measure, aggregation, periods AS period_count, CASE
    WHEN NOT has THEN 'invalid|measure column ''' || measure || ''' not in dataset'
    WHEN periods = 0 THEN 'invalid|no values for measure'
    WHEN n = 0 THEN 'invalid|measure column is all null'
    WHEN aggregation IN ('avg', 'rate') AND x <= 1e-12 THEN 'invalid|zero denominator for ratio aggregation'
    WHEN periods < 2 THEN 'invalid|degenerate trend (fewer than 2 period values)'
    WHEN periods < 8 THEN 'low-data|only ' || periods || ' time periods (< 8 required)'
    ELSE 'valid|enough time periods with values' END AS o FROM m),
validated AS (SELECT kpi, measure, aggregation, period_count, split_part(o, '|', 1) AS status, split_part(o, '|', 2) AS reason FROM v)"""


def validated(spark: SparkSession, folder: str) -> DataFrame:
    return validation(spark, folder)[0]


def _batch_kpis() -> list[Kpi]:
    """The KPIs above and five over measures that cannot be computed in part or hold numbers as text."""
    return _validation_kpis() + [
        Kpi("number_text", "sum", scale=2), Kpi("broken_text", "sum", scale=2), Kpi("broken_text", "count"),
        Kpi("huge_decimal", "sum"), Kpi("huge_double", "avg"),
    ]


def batch(spark: SparkSession, folder: str) -> DataFrame:
    last = F.col("o_orderkey") % 1000 == 7
    frame = _validation_frame(spark, folder).withColumns({
        "number_text": F.col("o_totalprice").cast("string"),
        "broken_text": F.when(last, F.concat(F.lit("n/a "), "o_orderkey")).otherwise(F.col("o_totalprice").cast("string")),
        "huge_decimal": F.lit("9" * 38).cast("decimal(38,0)"),
        "huge_double": F.when(F.to_date("o_orderdate") < "2000-01-01", 1.7e308).otherwise(1.0),
    })
    statistics = cut_lineage(kpi.period_statistics(frame, _batch_kpis(), "o_orderdate"))
    results = kpi.run_batch(statistics, _batch_kpis(), frame.columns, intervals=False)
    return results.select("kpi", "status", "period_count", "value", "baseline", "error")


def batch_counts(spark: SparkSession, folder: str) -> DataFrame:
    summary = kpi.batch_summary(batch(spark, folder))
    return summary.select("processed", "failed", F.array_join("failures", ", ").alias("failures"))


# The values follow from the orders; the failures from the first day that holds a broken text or two huge numbers.
BATCH_SQL = VALIDATION_SQL + f""",
days AS (SELECT d AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n,
  CAST(sum(CAST(lw AS DECIMAL(18,2))) AS DOUBLE) / nullif(count(lw), 0) AS late,
  min('n/a ' || o_orderkey) FILTER (o_orderkey % 1000 = 7) AS broken FROM f GROUP BY d),
trend AS (SELECT 'sum(o_totalprice)' AS kpi, period, total AS value FROM days
  UNION ALL SELECT 'sum(number_text)', period, total FROM days
  UNION ALL SELECT 'avg(o_totalprice)', period, total / n FROM days
  UNION ALL SELECT 'count(o_orderstatus)', period, CAST(n AS DOUBLE) FROM days
  UNION ALL SELECT 'count(broken_text)', period, CAST(n AS DOUBLE) FROM days
  UNION ALL SELECT 'avg(last_week_only)', period, late FROM days WHERE late IS NOT NULL),
{SUMMARY_SQL},
told AS (SELECT 'sum(broken_text)' AS kpi, min(period || ': ''' || broken || ''' is no number') AS error FROM days
  UNION ALL SELECT 'sum(huge_decimal)', min(period || ': total exceeds its type') FILTER (n > 1) FROM days
  UNION ALL SELECT 'avg(huge_double)', min(period || ': total is not finite') FILTER (n > 1 AND period < DATE '2000-01-01') FROM days),
every AS (SELECT kpi, status, period_count FROM validated
  UNION ALL SELECT k, 'valid', (SELECT count(*) FROM days) FROM (VALUES ('sum(number_text)'), ('sum(broken_text)'), ('count(broken_text)'),
    ('sum(huge_decimal)'), ('avg(huge_double)')) t(k)),
results AS (SELECT e.kpi, e.status, e.period_count, s.value, s.baseline, told.error FROM every e
  LEFT JOIN summary s ON e.kpi = s.kpi AND e.status <> 'invalid' LEFT JOIN told ON e.kpi = told.kpi)"""


def contracts(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts of orders and lineitem, from their profiles. Written once: they are read as a stored table."""
    profiles = profile.profile(table(spark, folder, "orders"), "orders", ["o_orderkey"]).unionByName(
        profile.profile(table(spark, folder, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"])
    )
    return cut_lineage(contract.build_contract(profiles))


def discovery(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates on the joined fact table whose time column is the order date."""
    columns = table(spark, folder, "orders").columns + table(spark, folder, "lineitem").columns
    found = kpi.discover_kpis(contracts(spark, folder), columns, "o_orderdate")
    return found.withColumn("slice_columns", F.array_join("slice_columns", ","))


# Measures and dimensions follow from the column statistics: doubles are measures, near-unique dense integers are keys.
DISCOVERY_SQL = """WITH ints AS (
  SELECT 'orders' AS source, 0 AS pos, 'o_orderkey' AS name, count(DISTINCT o_orderkey) AS k, count(o_orderkey) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders
  UNION ALL SELECT 'orders', 1, 'o_custkey', count(DISTINCT o_custkey), count(o_custkey), min(o_custkey), max(o_custkey) FROM orders
  UNION ALL SELECT 'lineitem', 0, 'l_orderkey', count(DISTINCT l_orderkey), count(l_orderkey), min(l_orderkey), max(l_orderkey) FROM lineitem
  UNION ALL SELECT 'lineitem', 1, 'l_partkey', count(DISTINCT l_partkey), count(l_partkey), min(l_partkey), max(l_partkey) FROM lineitem
  UNION ALL SELECT 'lineitem', 2, 'l_suppkey', count(DISTINCT l_suppkey), count(l_suppkey), min(l_suppkey), max(l_suppkey) FROM lineitem
  UNION ALL SELECT 'lineitem', 3, 'l_linenumber', count(DISTINCT l_linenumber), count(l_linenumber), min(l_linenumber), max(l_linenumber) FROM lineitem),
samples AS (
  SELECT name, count(*) FILTER (v BETWEEN 0 AND 1) = count(v) AND count(v) >= 2 AS unit FROM (
    SELECT 'l_orderkey' AS name, CAST(l_orderkey AS DOUBLE) AS v FROM lineitem
    UNION ALL SELECT 'l_partkey' AS name, CAST(l_partkey AS DOUBLE) AS v FROM lineitem
    UNION ALL SELECT 'l_suppkey' AS name, CAST(l_suppkey AS DOUBLE) AS v FROM lineitem
    UNION ALL SELECT 'l_linenumber' AS name, CAST(l_linenumber AS DOUBLE) AS v FROM lineitem
    UNION ALL SELECT 'l_quantity' AS name, CAST(l_quantity AS DOUBLE) AS v FROM lineitem
    UNION ALL SELECT 'l_extendedprice' AS name, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem
    UNION ALL SELECT 'l_discount' AS name, CAST(l_discount AS DOUBLE) AS v FROM lineitem
    UNION ALL SELECT 'l_tax' AS name, CAST(l_tax AS DOUBLE) AS v FROM lineitem
    UNION ALL SELECT 'o_orderkey', CAST(o_orderkey AS DOUBLE) AS v FROM orders
    UNION ALL SELECT 'o_custkey', CAST(o_custkey AS DOUBLE) AS v FROM orders
    UNION ALL SELECT 'o_totalprice', CAST(o_totalprice AS DOUBLE) AS v FROM orders) GROUP BY name),
measures AS (
  SELECT source, name FROM ints WHERE NOT (k > 0.95 * n AND lo >= 0 AND hi - lo <= 2 * n)
  UNION ALL SELECT 'orders', 'o_totalprice'
  UNION ALL SELECT 'lineitem', unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'])),
defs AS (
  SELECT m.name AS measure, CASE WHEN coalesce(s.unit, false) THEN 'avg' ELSE 'sum' END AS aggregation,
         CASE WHEN source = 'orders' THEN 'o_orderstatus,o_orderpriority' ELSE 'l_returnflag,l_linestatus' END AS slice_columns
  FROM measures m LEFT JOIN samples s ON m.name = s.name)
SELECT aggregation || '(' || measure || ') by ' || replace(slice_columns, ',', ' & ') AS name, measure, aggregation, slice_columns,
       'o_orderdate' AS time_column FROM defs"""


def merged_dimensions(spark: SparkSession, folder: str) -> DataFrame:
    """Each candidate's own slices followed by the dimensions of all contracts, each once."""
    columns = table(spark, folder, "orders").columns + table(spark, folder, "lineitem").columns
    found = kpi.discover_kpis(contracts(spark, folder), columns, "o_orderdate")
    declared = F.array(*[F.lit(d) for d in ("l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority")])
    return drivers.merged_dimensions(found, declared).select("name", F.array_join("dimensions", ",").alias("dimensions"))


def settings_materiality(spark: SparkSession, folder: str) -> DataFrame:
    """Materiality under each contract's own settings and a feedback multiplier."""
    held = contract.settings(contracts(spark, folder))
    scored = materiality.score_materiality(
        _with_settings(order_trend(spark, folder), held),
        F.col("threshold"), F.col("weight_statistical"), F.col("weight_business"), 0.55,
    )
    return scored.select("kpi", "materiality")


def _with_settings(trend: DataFrame, held: DataFrame) -> DataFrame:
    return kpi.summarize(trend).withColumn("_one", F.lit(1)).join(held.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")


def bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    return kpi.bootstrap_intervals(lineitem_trend(spark, folder, "day"))


def totals(spark: SparkSession, folder: str) -> DataFrame:
    return kpi.kpi_trend(table(spark, folder, "lineitem"), LINEITEM_KPIS, None).select("kpi", "idx", "value")


QUERIES = {
    "kpi_trend_daily": Query(lineitem_trend, lineitem_trend_sql() + " SELECT * FROM trend"),
    "kpi_trend_weekly_by_slice": Query(
        lambda s, f: lineitem_trend(s, f, "week", ("l_returnflag", "l_linestatus")),
        lineitem_trend_sql("date_trunc('week', l_shipdate)", "l_returnflag, l_linestatus") + " SELECT * FROM trend",
    ),
    "kpi_without_time_axis": Query(totals, """
WITH w AS (SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS a, CAST(count(l_quantity) AS DOUBLE) AS b,
  CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(l_discount) AS c,
  CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(l_tax) AS d FROM lineitem)
SELECT 'sum(l_extendedprice)' AS kpi, CAST(0 AS BIGINT) AS idx, a AS value FROM w UNION ALL SELECT 'count(l_quantity)', 0, b FROM w
UNION ALL SELECT 'avg(l_discount)', 0, c FROM w UNION ALL SELECT 'rate(l_tax)', 0, d FROM w"""),
    "kpi_summary": Query(
        lambda s, f: kpi.summarize(lineitem_trend(s, f)).withColumn("prior_std", F.round("prior_std", 4)),
        lineitem_trend_sql() + ", " + SUMMARY_SQL + " SELECT * REPLACE (round(prior_std, 4) AS prior_std) FROM summary",
    ),
    "kpi_materiality": Query(
        order_materiality, ORDER_TREND_SQL + ", " + SUMMARY_SQL + ", " + MATERIALITY_SQL + " SELECT * FROM scored"
    ),
    "kpi_materiality_contract_settings": Query(
        settings_materiality,
        ORDER_TREND_SQL + ", " + SUMMARY_SQL + ", " + MATERIALITY_SQL.replace(", 10.0) AS DOUBLE)", ", 10.0) * 0.55 AS DOUBLE)")
        + " SELECT kpi, materiality FROM scored",
    ),
    "kpi_validation": Query(validated, VALIDATION_SQL + " SELECT * FROM validated"),
    "kpi_status_counts": Query(
        lambda s, f: kpi.status_counts(validated(s, f)), VALIDATION_SQL + " SELECT status, count(*) AS kpis FROM validated GROUP BY status"
    ),
    "kpi_batch_results": Query(batch, BATCH_SQL + " SELECT * FROM results"),
    "kpi_batch_summary": Query(
        batch_counts,
        BATCH_SQL + """ SELECT count(*) FILTER (error IS NULL) AS processed, count(*) FILTER (error IS NOT NULL) AS failed,
          string_agg(kpi, ', ' ORDER BY kpi) FILTER (error IS NOT NULL) AS failures FROM results""",
    ),
    "kpi_discovery": Query(discovery, DISCOVERY_SQL),
    "merged_dimensions": Query(
        merged_dimensions, f"""SELECT name, CASE WHEN slice_columns LIKE 'l_%' THEN 'l_returnflag,l_linestatus,o_orderstatus,o_orderpriority'
          ELSE 'o_orderstatus,o_orderpriority,l_returnflag,l_linestatus' END AS dimensions FROM ({DISCOVERY_SQL})""",
    ),
    "kpi_bootstrap_interval": Query(bootstrap),
}
