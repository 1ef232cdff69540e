"""Profiles, roles, contracts and date texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.functions import dates
from kpiloom.operators import contract, profile
from workload import Query, rounded, table
from workload.kpis import contracts

# Spark type names of the test tables' columns.
ORDERS = [
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
    ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
]
LINEITEM = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
]
CUSTOMER = [
    ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"),
]
STATS = "source_id, position, name, dtype, row_count, null_count, null_ratio, cardinality, cardinality_ratio, is_unique, detected_role"


def profile_sql(source: str, columns: list[tuple[str, str]], relation: str | None = None) -> str:
    parts = []
    for i, (name, dtype) in enumerate(columns):
        integer = dtype in ("int", "bigint")
        lo, hi = (f"CAST(min({name}) AS BIGINT)", f"CAST(max({name}) AS BIGINT)") if integer else ("NULL", "NULL")
        parts.append(
            f"SELECT CAST({i} AS INTEGER) AS position, '{name}' AS name, '{dtype}' AS dtype, count(*) AS row_count,"
            f" count(*) - count({name}) AS null_count, count(DISTINCT {name}) AS cardinality, count({name}) AS n,"
            f" {lo} AS lo, {hi} AS hi FROM {relation or source}"
        )
    return f"""SELECT '{source}' AS source_id, position, name, dtype, row_count, null_count, {rounded('null_count / row_count', 4)} AS null_ratio,
 cardinality, {rounded('cardinality / n', 4)} AS cardinality_ratio, cardinality = row_count AS is_unique,
 CASE WHEN dtype IN ('timestamp_ntz', 'date') THEN 'temporal' WHEN dtype = 'double' THEN 'numerical'
      WHEN dtype = 'string' AND cardinality > 0.95 * n THEN 'identifier'
      WHEN dtype IN ('int', 'bigint') AND cardinality > 0.95 * n AND lo >= 0 AND hi - lo <= 2 * n THEN 'identifier'
      WHEN dtype IN ('int', 'bigint') THEN 'numerical' ELSE 'categorical' END AS detected_role
FROM ({' UNION ALL '.join(parts)})"""


def statistics(df: DataFrame, source: str) -> DataFrame:
    return profile.profile(df, source).select(*[c.strip() for c in STATS.split(",")])


def holed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with some values missing."""
    return table(spark, folder, "orders").withColumns({
        "o_totalprice": F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")),
        "o_orderpriority": F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")),
    })


HOLED_SQL = """(SELECT * REPLACE (CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS o_orderpriority) FROM orders)"""


def samples(spark: SparkSession, folder: str) -> DataFrame:
    rows = profile.profile(table(spark, folder, "customer"), "customer", ["c_custkey"])
    return rows.filter(F.col("name") != "c_acctbal").select("name", F.array_join("sample_values", "|").alias("sample_values"))


def _sample_sql(column: str) -> str:
    return (
        f"SELECT '{column}' AS name, string_agg(v, '|' ORDER BY k) AS sample_values FROM (SELECT c_custkey AS k, "
        f"CAST({column} AS VARCHAR) AS v FROM customer WHERE {column} IS NOT NULL ORDER BY c_custkey LIMIT 5)"
    )


def dated(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates as text in several layouts, some broken, and texts that are no dates."""
    day = F.col("o_orderdate")
    broken = F.col("o_orderkey") % 25 == 0
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice",
        F.when(broken, "unknown").otherwise(F.date_format(day, "yyyy-MM-dd")).alias("iso"),
        F.when(broken, "n.a.").otherwise(F.date_format(day, "d/M/yyyy")).alias("european"),
        F.date_format(day, "MM/dd/yyyy").alias("american"),
        F.when(F.col("o_orderkey") % 5 == 0, "late").otherwise(F.date_format(day, "yyyy-MM-dd")).alias("too_broken"),
        F.concat(F.lit("T"), F.date_format(day, "yyyyMMdd")).alias("label"),
        F.date_format(day, "MMM d, yyyy").alias("worded"),
        F.date_format(day, "yyyyMMdd").alias("compact"),
    )


def formats(spark: SparkSession, folder: str) -> DataFrame:
    return profile.profile(dated(spark, folder), "dated").select("name", "detected_role", "date_format")


DATED_SQL = """d AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 25 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso,
  CASE WHEN o_orderkey % 25 = 0 THEN 'n.a.' ELSE strftime(o_orderdate, '%-d/%-m/%Y') END AS european, strftime(o_orderdate, '%m/%d/%Y') AS american,
  CASE WHEN o_orderkey % 5 = 0 THEN 'late' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS too_broken,
  'T' || strftime(o_orderdate, '%Y%m%d') AS label, strftime(o_orderdate, '%b %-d, %Y') AS worded, strftime(o_orderdate, '%Y%m%d') AS compact FROM orders)"""


def _format_sql(name: str) -> str:
    tried = [("Y-m-d", "%Y-%m-%d"), ("d/m/Y", "%d/%m/%Y"), ("m/d/Y", "%m/%d/%Y"), ("Ymd", "%Y%m%d"), ("b d, Y", "%b %d, %Y")]
    cases = " ".join(f"WHEN count(try_strptime({name}, '{p}')) > 0.9 * count({name}) THEN '{n}'" for n, p in tried)
    return f"SELECT '{name}' AS name, count(DISTINCT {name}) > 0.95 * count({name}) AS uniq, CASE {cases} END AS date_format FROM d"


FORMATS_SQL = "WITH " + DATED_SQL + """ SELECT name, CASE WHEN date_format IS NOT NULL THEN 'temporal' WHEN uniq THEN 'identifier' ELSE 'categorical' END AS detected_role,
  date_format FROM (""" + " UNION ALL ".join(
    _format_sql(n) for n in ("iso", "european", "american", "too_broken", "label", "worded", "compact")
) + """) UNION ALL SELECT 'o_orderkey', 'identifier', NULL UNION ALL SELECT 'o_totalprice', 'numerical', NULL"""


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly totals over rows whose date text parses."""
    text = dated(spark, folder)
    time = dates.parse_text(F.col("european"), "d/m/Y")
    rows = text.select(dates.period_of(time, "month").alias("period"), "o_totalprice").filter(F.col("period").isNotNull())
    return rows.groupBy("period").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


def joined_names(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with their place, under names of which some extend others."""
    c, n, r = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("r_name").alias("region"), F.col("n_name").alias("region_nation"),
        F.col("c_mktsegment").alias("segment"), F.concat("r_name", "c_mktsegment").alias("segment_by_region"),
        F.col("c_acctbal").alias("balance"),
    )


def contract_rows(spark: SparkSession, folder: str) -> DataFrame:
    return contracts(spark, folder).select(
        "source_id", F.col("calendar.time_column").alias("time_column"), F.col("calendar.granularity").alias("granularity"),
        F.array_join("columns_by_role.measure", ",").alias("measures"), F.array_join("columns_by_role.dimension", ",").alias("dimensions"),
        F.array_join("columns_by_role.identifier", ",").alias("identifiers"),
        F.col("thresholds.materiality_std_devs").alias("threshold"), F.size("access_tags").cast("bigint").alias("tagged"),
    )


CONTRACT_SQL = f"""WITH p AS ({profile_sql('orders', ORDERS)} UNION ALL {profile_sql('lineitem', LINEITEM)})
SELECT source_id, max(name) FILTER (detected_role = 'temporal') AS time_column, 'day' AS granularity,
  coalesce(string_agg(name, ',' ORDER BY position) FILTER (detected_role = 'numerical'), '') AS measures,
  coalesce(string_agg(name, ',' ORDER BY position) FILTER (detected_role = 'categorical'), '') AS dimensions,
  coalesce(string_agg(name, ',' ORDER BY position) FILTER (detected_role = 'identifier'), '') AS identifiers,
  CAST(1.0 AS DOUBLE) AS threshold, count(*) AS tagged FROM p GROUP BY source_id"""


def roles(spark: SparkSession, folder: str) -> DataFrame:
    """Semantic role and default aggregation of every column."""
    rows = profile.profile(table(spark, folder, "lineitem"), "lineitem")
    renamed = rows.withColumn(
        "name",
        F.when(F.col("name") == "l_discount", "discount_pct").when(F.col("name") == "l_tax", "tax_rate").otherwise(F.col("name")),
    )
    return contract.classified(renamed).select("name", "role", "aggregation")


ROLES_SQL = f"""SELECT CASE name WHEN 'l_discount' THEN 'discount_pct' WHEN 'l_tax' THEN 'tax_rate' ELSE name END AS name,
  CASE detected_role WHEN 'temporal' THEN 'time' WHEN 'numerical' THEN 'measure' WHEN 'identifier' THEN 'identifier' ELSE 'dimension' END AS role,
  CASE WHEN detected_role = 'numerical' THEN CASE name WHEN 'l_discount' THEN 'avg' WHEN 'l_tax' THEN 'rate' ELSE 'sum' END END AS aggregation
FROM ({profile_sql('lineitem', LINEITEM)})"""


def broken_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts of which one lost two required fields."""
    rows = contracts(spark, folder)
    lost = F.col("source_id") == "orders"
    cut = rows.withColumns({c: F.when(~lost, F.col(c)) for c in ("calendar", "thresholds")})
    return contract.invalid_contracts(cut).select("source_id", F.array_join("missing_fields", ",").alias("missing_fields"))


QUERIES = {
    "profile_orders": Query(
        lambda s, f: statistics(holed_orders(s, f), "orders"), profile_sql("orders", ORDERS, HOLED_SQL)
    ),
    "profile_lineitem": Query(
        lambda s, f: statistics(table(s, f, "lineitem"), "lineitem"), profile_sql("lineitem", LINEITEM)
    ),
    "profile_customer": Query(
        lambda s, f: statistics(table(s, f, "customer"), "customer"), profile_sql("customer", CUSTOMER)
    ),
    "profile_samples": Query(
        samples, " UNION ALL ".join(_sample_sql(c) for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
    ),
    "profile_approximate": Query(
        lambda s, f: profile.profile(table(s, f, "lineitem"), "lineitem", approximate=True).select(
            "name", "row_count", "null_count", "detected_role"
        ),
        f"SELECT name, row_count, null_count, detected_role FROM ({profile_sql('lineitem', LINEITEM)})",
    ),
    "time_column": Query(
        lambda s, f: profile.time_column(profile.profile(dated(s, f), "dated")),
        "SELECT 'dated' AS source_id, 'iso' AS time_column, 'Y-m-d' AS date_format",
    ),
    "date_formats": Query(formats, FORMATS_SQL),
    "parsed_dates": Query(
        parsed, "WITH " + DATED_SQL + """ SELECT CAST(date_trunc('month', try_strptime(european, '%d/%m/%Y')) AS DATE) AS period,
          CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM d WHERE try_strptime(european, '%d/%m/%Y') IS NOT NULL GROUP BY 1""",
    ),
    "hierarchies": Query(
        lambda s, f: contract.hierarchies(profile.profile(joined_names(s, f), "customers")),
        """WITH names AS (SELECT * FROM (VALUES ('region'), ('region_nation'), ('segment'), ('segment_by_region')) t(name))
           SELECT 'customers' AS source_id, a.name AS parent, b.name AS child FROM names a JOIN names b ON a.name < b.name AND starts_with(b.name, a.name)""",
    ),
    "semantic_roles": Query(roles, ROLES_SQL),
    "contracts": Query(contract_rows, CONTRACT_SQL),
    "invalid_contracts": Query(
        broken_contracts, "SELECT 'orders' AS source_id, 'calendar,thresholds' AS missing_fields"
    ),
}
