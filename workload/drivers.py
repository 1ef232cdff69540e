"""Waterfalls, ratio decomposition, rankings and difference in differences."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.model import Kpi
from kpiloom.operators import causal, drivers, kpi
from workload import Query, small_total, table
from workload.kpis import ORDER_KPIS, order_trend

ORDER_DIMENSIONS = ["o_orderstatus", "o_orderpriority"]
LINEITEM_DIMENSIONS = ["l_suppkey", "l_partkey", "l_returnflag", "l_linestatus"]
REVENUE = [Kpi("l_extendedprice", "sum", scale=2)]
DISCOUNT = [Kpi("l_discount", "avg", scale=2)]


def order_waterfall(spark: SparkSession, folder: str) -> DataFrame:
    movements = drivers.latest_movements(order_trend(spark, folder), ORDER_KPIS)
    return drivers.decompose(table(spark, folder, "orders"), movements, ORDER_DIMENSIONS, "o_orderdate", "month")


def lineitem_waterfall(spark: SparkSession, folder: str, kpis=None, dims=None) -> DataFrame:
    kpis = kpis or REVENUE
    lineitem = table(spark, folder, "lineitem")
    trend = kpi.kpi_trend(lineitem, kpis, "l_shipdate", "month")
    movements = drivers.latest_movements(trend, kpis)
    return drivers.decompose(lineitem, movements, dims or LINEITEM_DIMENSIONS, "l_shipdate", "month")


# --- the same in SQL -------------------------------------------------------------------------------------------------

ORDER_WATERFALL_SQL = """WITH o AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS p, o_orderstatus, o_orderpriority, o_totalprice FROM orders),
b AS (SELECT max(p) AS after_period, (SELECT max(p) FROM o WHERE p < (SELECT max(p) FROM o)) AS before_period FROM o),
r AS (SELECT * FROM o, b WHERE p IN (before_period, after_period)),
long AS (SELECT p, before_period, after_period, 'o_orderstatus' AS dimension, o_orderstatus AS slice, o_totalprice FROM r
         UNION ALL SELECT p, before_period, after_period, 'o_orderpriority', o_orderpriority, o_totalprice FROM r),
g AS (SELECT dimension, slice, before_period, after_period,
        coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (p = before_period) AS DOUBLE), 0) AS sb,
        coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (p = after_period) AS DOUBLE), 0) AS sa,
        CAST(count(*) FILTER (p = before_period) AS DOUBLE) AS nb, CAST(count(*) FILTER (p = after_period) AS DOUBLE) AS na
      FROM long GROUP BY ALL),
tot AS (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (p = before_period) AS DOUBLE) AS tsb,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (p = after_period) AS DOUBLE) AS tsa,
               CAST(count(*) FILTER (p = before_period) AS DOUBLE) AS tnb, CAST(count(*) FILTER (p = after_period) AS DOUBLE) AS tna FROM r),
k AS (SELECT 'sum(o_totalprice)' AS kpi, dimension, slice, before_period, after_period, tsb AS before_value, tsa AS after_value, sb AS before, sa AS after FROM g, tot
      UNION ALL SELECT 'count(o_orderkey)', dimension, slice, before_period, after_period, tnb, tna, nb, na FROM g, tot),
drv AS (SELECT kpi, dimension, coalesce(slice, '(null)') AS slice, before_period, after_period, before_value, after_value,
        after_value - before_value AS total_movement, true AS additive, before, after, after - before AS contribution,
        CASE WHEN after_value <> before_value THEN abs(after - before) / abs(after_value - before_value) * 100.0 ELSE 0.0 END AS share_pct,
        CASE WHEN after > before THEN 'up' WHEN after < before THEN 'down' ELSE 'flat' END AS direction FROM k)"""

LINEITEM_WATERFALL_SQL = """WITH o AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS p, * FROM lineitem),
b AS (SELECT max(p) AS after_period, (SELECT max(p) FROM o WHERE p < (SELECT max(p) FROM o)) AS before_period FROM o),
r AS (SELECT o.*, before_period, after_period FROM o, b WHERE p IN (before_period, after_period)),
long AS (SELECT p, before_period, after_period, 'l_suppkey' AS dimension, CAST(l_suppkey AS VARCHAR) AS slice, l_extendedprice, l_discount FROM r
   UNION ALL SELECT p, before_period, after_period, 'l_partkey', CAST(l_partkey AS VARCHAR), l_extendedprice, l_discount FROM r
   UNION ALL SELECT p, before_period, after_period, 'l_returnflag', l_returnflag, l_extendedprice, l_discount FROM r
   UNION ALL SELECT p, before_period, after_period, 'l_linestatus', l_linestatus, l_extendedprice, l_discount FROM r),
tot AS (SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (p = before_period) AS DOUBLE) AS before_value,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (p = after_period) AS DOUBLE) AS after_value,
               CAST(sum(CAST(l_discount AS DECIMAL(18,2))) FILTER (p = before_period) AS DOUBLE) / count(*) FILTER (p = before_period) AS before_rate,
               CAST(sum(CAST(l_discount AS DECIMAL(18,2))) FILTER (p = after_period) AS DOUBLE) / count(*) FILTER (p = after_period) AS after_rate FROM r),
g AS (SELECT dimension, slice, before_period, after_period,
        coalesce(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (p = before_period) AS DOUBLE), 0) AS before,
        coalesce(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (p = after_period) AS DOUBLE), 0) AS after,
        coalesce(CAST(sum(CAST(l_discount AS DECIMAL(18,2))) FILTER (p = before_period) AS DOUBLE) / nullif(count(*) FILTER (p = before_period), 0), 0) AS rb,
        coalesce(CAST(sum(CAST(l_discount AS DECIMAL(18,2))) FILTER (p = after_period) AS DOUBLE) / nullif(count(*) FILTER (p = after_period), 0), 0) AS ra,
        CAST(count(*) FILTER (p = before_period) AS DOUBLE) AS nb, CAST(count(*) FILTER (p = after_period) AS DOUBLE) AS na
      FROM long GROUP BY ALL),
drv AS (SELECT 'sum(l_extendedprice)' AS kpi, dimension, slice, before_period, after_period, before_value, after_value,
        after_value - before_value AS total_movement, true AS additive, before, after, after - before AS contribution,
        abs(after - before) / abs(after_value - before_value) * 100.0 AS share_pct,
        CASE WHEN after > before THEN 'up' WHEN after < before THEN 'down' ELSE 'flat' END AS direction FROM g, tot)"""

RATIO_SQL = LINEITEM_WATERFALL_SQL + """, q AS (SELECT *, (na - nb) * before_rate + (ra - rb) * na AS contribution FROM g, tot
   WHERE dimension IN ('l_returnflag', 'l_linestatus'))
SELECT 'avg(l_discount)' AS kpi, dimension, slice, before_period, after_period, before_rate AS before_value, after_rate AS after_value,
  after_rate - before_rate AS total_movement, false AS additive, rb AS before, ra AS after, contribution,
  abs(contribution) / abs(after_rate - before_rate) * 100.0 AS share_pct,
  CASE WHEN contribution > 0 THEN 'up' WHEN contribution < 0 THEN 'down' ELSE 'flat' END AS direction FROM q"""

TOP_SQL = """ SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kpi, dimension ORDER BY abs(contribution) DESC, slice) AS rank FROM drv)
WHERE rank <= {k}"""

DIMENSIONS_SQL = f""", dims AS (SELECT kpi, dimension, before_period, after_period, before_value, after_value, total_movement, additive,
  count(*) AS slice_count, {small_total('contribution')} AS contribution_sum, max(abs(contribution)) AS top_strength
  FROM drv GROUP BY ALL),
ranked_dims AS (SELECT *, contribution_sum - total_movement AS residual,
  abs(contribution_sum - total_movement) <= greatest(1e-6, abs(total_movement) * 1e-9, 1e-6 * greatest(abs(before_value), abs(after_value), 1.0)) AS reconciled,
  row_number() OVER (PARTITION BY kpi ORDER BY top_strength DESC, dimension) AS dimension_rank FROM dims)"""

DID_BEFORE, DID_AFTER = date(2001, 5, 1), date(2001, 6, 1)


def did(spark: SparkSession, folder: str) -> DataFrame:
    return causal.diff_in_diff(
        table(spark, folder, "orders"), "o_orderpriority", "o_totalprice", DID_BEFORE, DID_AFTER, "o_orderdate", grain="month", scale=2
    )


def did_means(spark: SparkSession, folder: str) -> DataFrame:
    shown = did(spark, folder).drop("p_value")
    return shown.withColumns({c: F.round(c, 6) for c in ("effect_size",)} | {c: F.round(c, 2) for c in ("var_treat", "var_ctrl")})


DID_SQL = """WITH t AS (SELECT min(o_orderpriority) AS v FROM orders),
r AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS p, o_orderpriority = v AS treated, v, o_totalprice AS x FROM orders, t
      WHERE o_orderdate >= DATE '2001-05-01' AND o_orderdate < DATE '2001-07-01'),
s AS (SELECT 'o_orderpriority' AS treatment_dim, max(v) AS treatment_value, DATE '2001-05-01' AS before_period, DATE '2001-06-01' AS after_period,
  {groups} FROM r)
SELECT * REPLACE (round(var_treat, 2) AS var_treat, round(var_ctrl, 2) AS var_ctrl),
  (treat_after - treat_before) - (ctrl_after - ctrl_before) AS did_estimate,
  round((treat_after - ctrl_after) / sqrt((var_treat + var_ctrl) / 2.0), 6) AS effect_size FROM s"""


def _did_groups() -> str:
    out = []
    for side, cond in (("treat", "treated"), ("ctrl", "NOT treated")):
        for name, p in (("before", "2001-05-01"), ("after", "2001-06-01")):
            w = f"FILTER ({cond} AND p = DATE '{p}')"
            out.append(f"CAST(sum(CAST(x AS DECIMAL(18,2))) {w} AS DOUBLE) / count(x) {w} AS {side}_{name}")
            out.append(f"count(x) {w} AS n_{side}_{name}")
            if name == "after":
                out.append(f"var_samp(x) {w} AS var_{side}")
    return ", ".join(out)


def bounds(spark: SparkSession, folder: str) -> DataFrame:
    """The two compared periods of each KPI as rows."""
    found = drivers.latest_movements(order_trend(spark, folder), ORDER_KPIS)
    rows = [(m.kpi.name, m.before, m.after, m.before_value, m.after_value) for m in found]
    return spark.createDataFrame(rows, "kpi string, before_period date, after_period date, before_value double, after_value double")


QUERIES = {
    "period_bounds": Query(
        bounds, ORDER_WATERFALL_SQL + " SELECT DISTINCT kpi, before_period, after_period, before_value, after_value FROM drv"
    ),
    "waterfall": Query(lambda s, f: drivers.ranked(order_waterfall(s, f)), ORDER_WATERFALL_SQL + " SELECT * FROM drv"),
    "waterfall_many_slices": Query(lineitem_waterfall, LINEITEM_WATERFALL_SQL + " SELECT * FROM drv"),
    "top_slices": Query(
        lambda s, f: drivers.top_slices(lineitem_waterfall(s, f), 6), LINEITEM_WATERFALL_SQL + TOP_SQL.format(k=6)
    ),
    "dimension_ranking": Query(
        lambda s, f: drivers.ranked_dimensions(lineitem_waterfall(s, f)).withColumn("residual", F.round("residual", 4)),
        LINEITEM_WATERFALL_SQL + DIMENSIONS_SQL + " SELECT * REPLACE (round(residual, 4) AS residual) FROM ranked_dims",
    ),
    "ratio_decomposition": Query(
        lambda s, f: lineitem_waterfall(s, f, DISCOUNT, ["l_returnflag", "l_linestatus"]), RATIO_SQL
    ),
    "displayed_sums_reconcile": Query(
        lambda s, f: drivers.display_check(order_waterfall(s, f)),
        ORDER_WATERFALL_SQL + """ SELECT *, abs(displayed_sum - displayed_total) < 1e-3 AS matches FROM (SELECT kpi, dimension,
          CAST(sum(CAST(CAST(printf('%.4f', contribution) AS DOUBLE) AS DECIMAL(38,4))) AS DOUBLE) AS displayed_sum, max(CAST(printf('%.4f', total_movement) AS DOUBLE)) AS displayed_total
          FROM drv GROUP BY ALL)""",
    ),
    "diff_in_diff_groups": Query(did_means, DID_SQL.format(groups=_did_groups())),
    "diff_in_diff_p_value": Query(did),
}
