"""Grain alignment and canonical joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.functions.dates import Cadence
from kpiloom.operators import grain, join_keys
from kpiloom.session import cut_lineage
from workload import Query, small_total, table


def daily_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Lineitem as a daily source: two dimensions of which one has gaps, two sums, a named ratio and a 0..1 column."""
    return table(spark, folder, "lineitem").select(
        F.col("l_shipdate").alias("ship_date"), F.when(F.col("l_orderkey") % 9 != 0, F.col("l_returnflag")).alias("flag"),
        "l_linestatus", F.col("l_linenumber").alias("lines"), F.col("l_extendedprice").alias("revenue"),
        (F.col("l_discount") * 100.0).alias("discount_pct"), F.col("l_tax").alias("tax"),
    )


def downsampled_sql(unit: str) -> str:
    return f"""SELECT CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS ship_date, CASE WHEN l_orderkey % 9 <> 0 THEN l_returnflag END AS flag,
  l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
  {small_total('l_discount * 100.0')} / count(*) AS discount_pct,
  CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS tax FROM lineitem GROUP BY ALL"""


def periods(spark: SparkSession, folder: str, unit: str) -> DataFrame:
    """Periodic revenue per supplier. Suppliers start late and skip periods by themselves; some values are missing."""
    start = F.trunc(F.to_date("l_shipdate"), unit)
    revenue = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    grouped = table(spark, folder, "lineitem").groupBy(
        start.alias("period_start"), F.col("l_suppkey").cast("string").alias("supplier")
    ).agg(revenue.alias("revenue"))
    return grouped.withColumn("revenue", F.when(F.day("period_start") % 5 != 0, F.col("revenue")))


def upsampled_sql(unit: str, end: str) -> str:
    return f"""WITH s AS (SELECT CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS p, CAST(l_suppkey AS VARCHAR) AS supplier,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem GROUP BY ALL),
s2 AS (SELECT p, supplier, CASE WHEN day(p) % 5 <> 0 THEN revenue END AS revenue FROM s),
g AS (SELECT CAST(unnest(generate_series(min(p), {end}, INTERVAL 1 DAY)) AS DATE) AS d FROM s2),
f AS (SELECT DISTINCT supplier FROM s2)
SELECT d AS period_start, f.supplier, revenue FROM g CROSS JOIN f ASOF LEFT JOIN s2 ON f.supplier = s2.supplier AND g.d >= s2.p"""


def customer_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Customers, nations and regions joined on shared keys; columns a later source repeats are dropped from it."""
    customer = table(spark, folder, "customer").withColumn("c_nationkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_nationkey")))
    nation = table(spark, folder, "nation").withColumn("c_name", F.col("n_name")).withColumn(
        "n_nationkey", F.when(F.col("n_nationkey") != 3, F.col("n_nationkey"))
    )
    region = table(spark, folder, "region")
    keys = {"nation": {0: "c_nationkey", 1: "n_nationkey"}, "region": {1: "n_regionkey", 2: "r_regionkey"}}
    sources = [grain.Source(df, Cadence.DAILY) for df in (customer, nation, region)]
    return grain.sorted_canonical(grain.reconcile(sources, keys), ["nation", "c_custkey"])


CHAIN_SQL = """SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey END AS nation, c_acctbal, c_mktsegment,
  n_name, n_regionkey AS region, r_name FROM customer
LEFT JOIN (SELECT CASE WHEN n_nationkey <> 3 THEN n_nationkey END AS k, n_name, n_regionkey FROM nation) n
  ON CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey END IS NOT DISTINCT FROM k
LEFT JOIN region ON n_regionkey IS NOT DISTINCT FROM r_regionkey"""


def mixed_cadence(spark: SparkSession, folder: str) -> DataFrame:
    """Daily order revenue per status joined with weekly figures carried to days."""
    day = table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("order_day"), "o_orderstatus").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue")
    )
    week = table(spark, folder, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "week").alias("week_start"), F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("weekly_orders"), F.lit(1.0).alias("revenue")
    )
    sources = [grain.Source(day, Cadence.DAILY, "order_day"), grain.Source(week, Cadence.WEEKLY, "week_start")]
    keys = {"day": {0: "order_day", 1: "week_start"}, "status": {0: "o_orderstatus", 1: "status"}}
    joined = grain.reconcile(sources, keys)
    return joined.select(F.to_date("day").alias("day"), "status", "revenue", "weekly_orders")


MIXED_SQL = """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders GROUP BY ALL),
w AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, o_orderstatus AS status, count(*) AS weekly_orders FROM orders GROUP BY ALL)
SELECT day, d.status, revenue, weekly_orders FROM d ASOF LEFT JOIN w ON d.status = w.status AND d.day >= w.week"""


def mixed_cadence_found(spark: SparkSession, folder: str) -> DataFrame:
    """The same with days as text and nothing declared: time columns, their format and the keys are found by content."""
    day = table(spark, folder, "orders").groupBy(F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"), "o_orderstatus").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue")
    )
    week = table(spark, folder, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "week").alias("week_start"), F.col("o_orderstatus").alias("state")).agg(
        F.count(F.lit(1)).alias("weekly_orders")
    )
    sources = [grain.Source(cut_lineage(day), Cadence.DAILY), grain.Source(cut_lineage(week), Cadence.WEEKLY)]
    joined = grain.reconcile(sources)
    return joined.select(F.to_date("day").alias("day"), F.col("o_orderstatus").alias("status"), "revenue", "weekly_orders")


KEYED_TABLES = ("lineitem", "orders", "customer", "nation", "region", "supplier")


def found_keys(spark: SparkSession, folder: str) -> DataFrame:
    """How six tables join, by their values alone. Customer and supplier texts are codes of their rows."""
    frames = [table(spark, folder, t) for t in KEYED_TABLES]
    pairs = [(KEYED_TABLES[p.left], p.left_column, KEYED_TABLES[p.right], p.right_column, p.unique, p.shared) for p in join_keys.infer_join_keys(frames)]
    return spark.createDataFrame(pairs, "left_table string, left_column string, right_table string, right_column string, is_unique boolean, shared long")


def found_keys_sql() -> str:
    """Every pair of whole-number or text columns of an earlier and a later table, counted exactly; the most alike unique one."""
    columns = {
        "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"],
        "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
        "nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"], "supplier": ["s_suppkey", "s_name", "s_nationkey"],
    }
    values = " UNION ALL ".join(
        f"SELECT {place} AS place, '{t}' AS tab, '{c}' AS col, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY v"
        for place, t in enumerate(KEYED_TABLES) for c in columns[t]
    )
    return f"""WITH vals AS ({values}),
sizes AS (SELECT place, tab, col, count(*) AS d, sum(n) AS n FROM vals GROUP BY ALL),
shared AS (SELECT l.tab AS lt, l.col AS lc, r.tab AS rt, r.col AS rc, count(*) AS shared FROM vals l JOIN vals r ON l.v = r.v AND l.place < r.place GROUP BY ALL)
SELECT lt AS left_table, lc AS left_column, rt AS right_table, rc AS right_column, true AS is_unique, shared FROM shared
JOIN sizes l ON l.tab = lt AND l.col = lc JOIN sizes r ON r.tab = rt AND r.col = rc
WHERE r.d >= 0.95 * r.n AND shared >= 0.8 * l.d
QUALIFY row_number() OVER (PARTITION BY rt ORDER BY shared / (l.d + r.d - shared) DESC, l.place, lc, rc) = 1"""


def ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Which numeric columns average instead of sum."""
    df = daily_sales(spark, folder)
    numeric = ["lines", "revenue", "discount_pct", "tax"]
    found = grain.ratio_columns(df, numeric)
    return spark.createDataFrame([(c, c in found) for c in numeric], "column string, is_ratio boolean")


QUERIES = {
    "downsample_weekly": Query(
        lambda s, f: grain.align_grain(daily_sales(s, f), "Daily", "Weekly", "ship_date"), downsampled_sql("week")
    ),
    "downsample_monthly": Query(
        lambda s, f: grain.align_grain(daily_sales(s, f), Cadence.REAL_TIME, Cadence.MONTHLY, "ship_date"), downsampled_sql("month")
    ),
    "upsample_weekly": Query(
        lambda s, f: grain.align_grain(periods(s, f, "week"), "Weekly", "Daily", "period_start"), upsampled_sql("week", "max(p) + 6")
    ),
    "upsample_monthly": Query(
        lambda s, f: grain.align_grain(periods(s, f, "month"), "Monthly", "Daily", "period_start"), upsampled_sql("month", "last_day(max(p))")
    ),
    "left_join_chain": Query(customer_chain, CHAIN_SQL),
    "reconcile_mixed_cadence": Query(mixed_cadence, MIXED_SQL),
    "reconcile_found_keys": Query(mixed_cadence_found, MIXED_SQL),
    "join_keys_found": Query(found_keys, found_keys_sql()),
    "ratio_columns": Query(
        ratios, """SELECT 'lines' AS "column", min(l_linenumber) >= 0 AND max(l_linenumber) <= 1 AS is_ratio FROM lineitem
          UNION ALL SELECT 'revenue', min(l_extendedprice) >= 0 AND max(l_extendedprice) <= 1 FROM lineitem
          UNION ALL SELECT 'discount_pct', true UNION ALL SELECT 'tax', min(l_tax) >= 0 AND max(l_tax) <= 1 FROM lineitem""",
    ),
}
