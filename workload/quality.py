"""Quality issues on lineitem with injected defects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.functions.exact import exact_quantiles
from kpiloom.operators import quality
from kpiloom.sources import datasets
from workload import Query, rounded, table

NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
COLUMNS = NUMBERS + ["l_returnflag", "l_linestatus", "l_shipdate", "typed_amount"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def defective(spark: SparkSession, folder: str) -> DataFrame:
    """Lineitem with missing and negative values, extreme prices, number texts that are none, and repeated rows."""
    key = F.col("l_orderkey")
    dirty = table(spark, folder, "lineitem").withColumns({
        "l_returnflag": F.when(key % 3 != 0, F.col("l_returnflag")),
        "l_linestatus": F.when(key % 7 != 0, F.col("l_linestatus")),
        "l_tax": F.when(key % 11 != 0, F.col("l_tax")),
        "l_quantity": F.when(key % 50 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity")),
        "l_extendedprice": F.when(key % 40 == 0, F.col("l_extendedprice") * 25.0).otherwise(F.col("l_extendedprice")),
        "typed_amount": F.when(key % 20 == 0, "about ten").otherwise(F.col("l_linenumber").cast("string")),
    })
    copies = F.when(key % 30 == 0, 3).otherwise(1)
    return dirty.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


DEFECTIVE_SQL = """d AS (SELECT * FROM (SELECT * REPLACE (
    CASE WHEN l_orderkey % 3 <> 0 THEN l_returnflag END AS l_returnflag, CASE WHEN l_orderkey % 7 <> 0 THEN l_linestatus END AS l_linestatus,
    CASE WHEN l_orderkey % 11 <> 0 THEN l_tax END AS l_tax, CASE WHEN l_orderkey % 50 = 0 THEN -l_quantity ELSE l_quantity END AS l_quantity,
    CASE WHEN l_orderkey % 40 = 0 THEN l_extendedprice * 25.0 ELSE l_extendedprice END AS l_extendedprice),
    CASE WHEN l_orderkey % 20 = 0 THEN 'about ten' ELSE CAST(l_linenumber AS VARCHAR) END AS typed_amount FROM lineitem) x,
  (VALUES (1), (2), (3)) c(copy) WHERE copy = 1 OR l_orderkey % 30 = 0),
t AS (SELECT count(*) AS n FROM d)"""


def issues(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_issues(
        defective(spark, folder), "lineitem", MEASURES, allow_negative=("l_tax",), declared_numeric=("typed_amount",)
    )


def _issues_sql() -> str:
    missing = [f"SELECT '{c}' AS c, count(*) - count({c}) AS k FROM d" for c in COLUMNS]
    negative = [f"SELECT '{c}' AS c, count(*) FILTER ({c} < 0) AS k FROM d" for c in MEASURES if c != "l_tax"]
    fences = [
        f"SELECT '{c}' AS c, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, count({c}) AS k FROM d" for c in NUMBERS
    ]
    outside = [
        f"SELECT '{c}' AS c, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS k FROM d, q"
        f" WHERE q.c = '{c}' AND q.k >= 8 AND q3 <> q1" for c in NUMBERS
    ]
    keys = ", ".join(COLUMNS)
    return f"""WITH {DEFECTIVE_SQL},
q AS ({' UNION ALL '.join(fences)}),
i AS (
  SELECT c AS "column", 'missing_values' AS issue_type, CASE WHEN k / n > 0.3 THEN 'high' WHEN k / n > 0.1 THEN 'medium' ELSE 'low' END AS severity, k
    FROM ({' UNION ALL '.join(missing)}), t WHERE k / n > 0.05
  UNION ALL SELECT '(all columns)', 'duplicate_rows', CASE WHEN k / n > 0.10 THEN 'high' WHEN k / n > 0.02 THEN 'medium' ELSE 'low' END, k
    FROM (SELECT CAST(sum(m - 1) AS BIGINT) AS k FROM (SELECT count(*) AS m FROM d GROUP BY {keys})), t WHERE k > 0
  UNION ALL SELECT c, 'invalid_range', 'high', k FROM ({' UNION ALL '.join(negative)}) WHERE k > 0
  UNION ALL SELECT 'typed_amount', 'type_violation', 'medium', count(*) FROM d WHERE TRY_CAST(typed_amount AS DOUBLE) IS NULL HAVING count(*) > 0
  UNION ALL SELECT c, 'outlier', 'low', k FROM ({' UNION ALL '.join(outside)}) WHERE k > 0),
issues AS (SELECT 'lineitem' AS source_id, "column", issue_type, severity, k AS affected_row_count FROM i)"""


ISSUES_SQL = _issues_sql()


def scored(spark: SparkSession, folder: str) -> DataFrame:
    clean = table(spark, folder, "region")
    rows = quality.source_rows(defective(spark, folder), "lineitem").unionByName(quality.source_rows(clean, "region"))
    return quality.score_issues(issues(spark, folder), rows)


SCORE_SQL = ISSUES_SQL + f""", p AS (SELECT sum(CAST(CASE severity WHEN 'high' THEN 10.0 WHEN 'medium' THEN 5.0 ELSE 2.0 END
    * least(1.0 + affected_row_count / n, 2.0) AS DECIMAL(20,10))) AS penalty, count(*) AS issue_count FROM issues, t)
SELECT 'lineitem' AS source_id, n AS row_count, issue_count, {rounded('greatest(least(100.0 - CAST(penalty AS DOUBLE), 100.0), 0.0)', 1)} AS score FROM p, t
UNION ALL SELECT 'region', count(*), 0, 100.0 FROM region"""


def quantiles(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Quartiles and medians of whole columns."""
    wanted = ["l_extendedprice", "l_quantity", "l_partkey"]
    found = exact_quantiles(table(spark, folder, "lineitem"), wanted, [0.25, 0.5, 0.75], **options)
    rows = [(c, p, v) for c, q in found.items() for p, v in q.items()]
    return spark.createDataFrame(rows, "column string, p double, value double")


def weakest(spark: SparkSession, folder: str) -> DataFrame:
    """Weakest source of each dataset: one dataset per market segment, built from the suppliers' scores of its nation."""
    reports = table(spark, folder, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_id"), F.pmod("s_acctbal", F.lit(100.0)).alias("score")
    ).withColumn("score", F.round("score", 2))
    members = table(spark, folder, "supplier").groupBy("s_nationkey").agg(
        F.array_sort(F.collect_list(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))).alias("source_ids")
    ).select(F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("dataset_id"), "source_ids")
    return datasets.weakest_quality(members, reports)


QUANTILES_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS p, CAST(quantile_cont({c}, {p}) AS DOUBLE) AS value FROM lineitem"
    for c in ("l_extendedprice", "l_quantity", "l_partkey") for p in (0.25, 0.5, 0.75)
)


QUERIES = {
    "quality_issues": Query(lambda s, f: quality.by_severity(issues(s, f)), ISSUES_SQL + " SELECT * FROM issues"),
    "quality_score": Query(scored, SCORE_SQL),
    "quality_weakest_source": Query(
        weakest, """WITH r AS (SELECT s_nationkey, 's' || s_suppkey AS source_id, round(((s_acctbal % 100.0) + 100.0) % 100.0, 2) AS score FROM supplier)
          SELECT 'nation ' || s_nationkey AS dataset_id, source_id, score FROM r
          QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY score, source_id) = 1""",
    ),
    "duplicate_rows": Query(
        lambda s, f: quality.duplicate_rows(defective(s, f)),
        f"WITH {DEFECTIVE_SQL} SELECT CAST(sum(m) AS BIGINT) AS row_count, CAST(sum(m - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS m FROM d GROUP BY {', '.join(COLUMNS)})",
    ),
    "duplicate_rows_fingerprint": Query(
        lambda s, f: quality.duplicate_rows(defective(s, f), fingerprint=True),
        f"WITH {DEFECTIVE_SQL} SELECT CAST(sum(m) AS BIGINT) AS row_count, CAST(sum(m - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS m FROM d GROUP BY {', '.join(COLUMNS)})",
    ),
    "exact_quantiles": Query(quantiles, QUANTILES_SQL),
    # Brackets narrowed to few values by a coarse sketch, so that every step of the search runs.
    "exact_quantiles_narrowed": Query(lambda s, f: quantiles(s, f, direct_limit=100), QUANTILES_SQL),
}
