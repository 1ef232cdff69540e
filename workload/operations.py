"""Feedback, model-call, latency and history queries, with events standing in for those logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.operators import checks, feedback, kpi, telemetry
from kpiloom.sources import datasets
from workload import Query, table
from workload.kpis import LINEITEM_KPIS

TYPES = ["price", "volume", "mix", "marketing", "supply"]
USER = 7


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("feedback_id"), "user_id", F.lit("insight").alias("target_type"),
        F.concat(F.lit("kpi-"), (F.col("event_id") % 40).cast("string")).alias("target_id"),
        F.when(kind == "purchase", "confirm").when(kind == "error", "reject").otherwise("correct").alias("verdict"),
        F.lit(None).cast("string").alias("driver_type"), F.col("ts").alias("created_at"),
    )


def meta(spark: SparkSession, folder: str) -> DataFrame:
    """Stored driver types; every thirteenth is missing."""
    names = F.array(*[F.lit(t) for t in TYPES])
    return table(spark, folder, "events").select(
        F.col("event_id").alias("feedback_id"),
        F.when(F.col("event_id") % 13 != 0, F.element_at(names, (F.col("user_id") % 5 + 1).cast("int"))).alias("driver_type"),
    )


def typed(spark: SparkSession, folder: str) -> DataFrame:
    return feedback.typed_feedback(feedback.checked(verdicts(spark, folder)), meta(spark, folder))


FEEDBACK_SQL = """WITH fb AS (SELECT event_id AS feedback_id, user_id, 'kpi-' || (event_id % 40) AS target_id, ts AS created_at,
  CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'reject' ELSE 'correct' END AS verdict,
  coalesce(CASE WHEN event_id % 13 <> 0 THEN ['price', 'volume', 'mix', 'marketing', 'supply'][user_id % 5 + 1] END, 'other') AS driver_type FROM events),
adj AS (SELECT user_id, driver_type, count(*) FILTER (verdict = 'confirm') AS confirm, count(*) FILTER (verdict = 'correct') AS correct,
  count(*) FILTER (verdict = 'reject') AS reject FROM fb GROUP BY ALL),
weights AS (SELECT *, CAST(printf('%.4f', least(greatest(CAST(1.0 AS DOUBLE) - CAST(0.15 AS DOUBLE) * reject + CAST(0.075 AS DOUBLE) * confirm, 0.25), 1.0)) AS DOUBLE) AS multiplier FROM adj)"""


def weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Multiplier of every user for two driver types, one of which many never judged."""
    users = table(spark, folder, "events").select("user_id").distinct()
    asked = users.select("user_id", F.explode(F.array(F.lit("price"), F.lit("other"))).alias("driver_type"))
    return feedback.with_multiplier(asked, feedback.adjustments(typed(spark, folder)))


def findings_log(spark: SparkSession, folder: str) -> DataFrame:
    """Stored findings, many without a dimension."""
    dimension = F.when(F.col("event_type") == "purchase", "customer_segment").when(F.col("event_type") == "view", "region_name")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("finding_id"), "user_id", (F.col("event_id") % 3).alias("kpi"), dimension.alias("dimension"),
        F.col("ts").alias("created_at"),
    )


def calls(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    prompt, completion = F.col("event_id") % 500, F.col("event_id") % 200
    return e.select(
        F.col("event_id").alias("call_id"), "user_id", F.concat(F.lit("kpi-"), (F.col("event_id") % 40).cast("string")).alias("kpi_id"),
        F.concat(F.lit("hash-"), (F.col("event_id") % 97).cast("string")).alias("package_hash"),
        prompt.alias("prompt_tokens"), completion.alias("completion_tokens"),
        F.floor(F.col("value") * 100.0 + 0.5).alias("latency_ms"), telemetry.cost_usd(prompt, completion).alias("cost_usd"),
        (F.col("event_id") % 3 == 0).alias("cached"), F.col("ts").alias("created_at"),
    )


CALLS_SQL = """WITH calls AS (SELECT event_id AS call_id, user_id, 'kpi-' || (event_id % 40) AS kpi_id, 'hash-' || (event_id % 97) AS package_hash,
  event_id % 500 AS prompt_tokens, event_id % 200 AS completion_tokens, CAST(floor(value * 100.0 + 0.5) AS BIGINT) AS latency_ms,
  round_even((event_id % 500) * CAST(0.10 AS DOUBLE) + (event_id % 200) * CAST(0.40 AS DOUBLE), 0) AS micro, event_id % 3 = 0 AS cached, ts AS created_at FROM events)"""


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.call_ledger(calls(spark, folder), ("user_id",)).select(
        "user_id", "calls", "cost_usd", F.col("last_call.call_id").alias("last_call_id"), F.col("last_call.prompt_tokens").alias("last_prompt_tokens")
    )


def timings(spark: SparkSession, folder: str) -> DataFrame:
    return calls(spark, folder).join(
        table(spark, folder, "events").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("stage")), "call_id"
    )


def activity(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("log_id"), "user_id", F.col("event_type").alias("action_type"),
        F.when(F.col("event_id") % 2 == 0, "kpi").otherwise("dataset").alias("target_type"), F.col("props").alias("summary"),
        F.col("ts").alias("created_at"),
    )


def page(spark: SparkSession, folder: str) -> DataFrame:
    rows = telemetry.history(
        activity(spark, folder), USER, target_type="kpi",
        since=F.lit("2024-01-03").cast("timestamp_ntz"), until=F.lit("2024-01-25").cast("timestamp_ntz"),
    )
    return telemetry.history_page(rows, page=2, page_size=10)


HISTORY_SQL = f"""SELECT event_id AS log_id, user_id, event_type AS action_type, 'kpi' AS target_type, props AS summary, ts AS created_at FROM events
  WHERE user_id = {USER} AND event_id % 2 = 0 AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-25'"""


def history_size(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.page_counts(telemetry.history(activity(spark, folder), USER), telemetry.PAGE_SIZE)


def table_checks(spark: SparkSession, folder: str) -> DataFrame:
    li, orders, customer, nation, region = (table(spark, folder, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    trend = kpi.kpi_trend(li, LINEITEM_KPIS, "l_shipdate", "month")
    last = trend.filter(F.col("kpi") == "sum(l_extendedprice)").agg(F.max("period")).first()[0]
    shifted = li.withColumn("price", F.when(F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp_ntz"), F.col("l_extendedprice") * 2.0).otherwise(F.col("l_extendedprice")))
    return checks.combine([
        checks.row_count(li, "lineitem has rows", at_least=2000),
        checks.row_count(region, "five regions", exactly=5),
        checks.unique_key(customer, ["c_custkey"], "customer key unique"),
        checks.unique_key(li, ["l_orderkey", "l_linenumber"], "line key unique"),
        checks.group_count(nation, ["n_regionkey"], "nations in every region", 5),
        checks.no_orphans(orders, "o_custkey", customer, "c_custkey", "orders have customers"),
        checks.consistent_hierarchy(nation, "n_regionkey", "n_nationkey", "nation has one region"),
        checks.value_set(li, "l_linestatus", ["O", "F"], "line status values"),
        checks.spike(trend, "sum(l_extendedprice)", last, "last month spikes"),
        checks.drop(trend, "sum(l_extendedprice)", last, "last month drops"),
        checks.level_shift(shifted, "price", "l_shipdate", "1998-06-01", "price level shift", 1.8),
        checks.ratio_band(li, F.col("l_returnflag") == "R", "share of returns", 0.30, 0.37),
        checks.row_tally(li, F.col("l_extendedprice") < 0, "no negative price", 0),
        checks.above_average(li, "l_quantity", F.col("l_returnflag") == "R", "returned quantity", 1.4),
    ])


CHECKS_SQL = """WITH m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS p, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem GROUP BY 1),
lm AS (SELECT arg_max(v, p) AS v, median(v) AS med FROM m),
sh AS (SELECT median(l_extendedprice) FILTER (l_shipdate < DATE '1998-06-01') AS b, median(l_extendedprice * 2.0) FILTER (l_shipdate >= DATE '1998-06-01') AS a FROM lineitem)
SELECT 'lineitem has rows' AS "check", count(*) >= 2000 AS passed, CAST(count(*) AS DOUBLE) AS measured FROM lineitem
UNION ALL SELECT 'five regions', count(*) = 5, count(*) FROM region
UNION ALL SELECT 'customer key unique', count(*) = count(DISTINCT c_custkey), count(*) - count(DISTINCT c_custkey) FROM customer
UNION ALL SELECT 'line key unique', count(*) = count(DISTINCT (l_orderkey, l_linenumber)), count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
UNION ALL SELECT 'nations in every region', count(DISTINCT n_regionkey) = 5, count(DISTINCT n_regionkey) FROM nation
UNION ALL SELECT 'orders have customers', count(*) = 0, count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'nation has one region', count(*) = 0, count(*) FROM (SELECT n_nationkey FROM nation GROUP BY 1 HAVING count(DISTINCT n_regionkey) > 1)
UNION ALL SELECT 'line status values', count(*) FILTER (s NOT IN ('O', 'F')) = 0 AND count(*) FILTER (s IN ('O', 'F')) = 2, count(*) FILTER (s NOT IN ('O', 'F')) FROM (SELECT DISTINCT l_linestatus AS s FROM lineitem)
UNION ALL SELECT 'last month spikes', v > 3.0 * med, v / med FROM lm
UNION ALL SELECT 'last month drops', v < 0.55 * med, v / med FROM lm
UNION ALL SELECT 'price level shift', a > 1.8 * b, a / b FROM sh
UNION ALL SELECT 'share of returns', avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) BETWEEN 0.30 AND 0.37, count(*) FILTER (l_returnflag = 'R') / count(*) FROM lineitem
UNION ALL SELECT 'no negative price', count(*) FILTER (l_extendedprice < 0) = 0, count(*) FILTER (l_extendedprice < 0) FROM lineitem
UNION ALL SELECT 'returned quantity', avg(l_quantity) FILTER (l_returnflag = 'R') > 1.4 * avg(l_quantity), avg(l_quantity) FILTER (l_returnflag = 'R') / avg(l_quantity) FROM lineitem"""


QUERIES = {
    "feedback_multipliers": Query(lambda s, f: feedback.adjustments(typed(s, f)), FEEDBACK_SQL + " SELECT * FROM weights"),
    "current_multiplier": Query(
        weighted, FEEDBACK_SQL + """ SELECT u.user_id, t.driver_type, coalesce(multiplier, 1.0) AS multiplier FROM (SELECT DISTINCT user_id FROM events) u
          CROSS JOIN (VALUES ('price'), ('other')) t(driver_type) LEFT JOIN weights w ON u.user_id = w.user_id AND t.driver_type = w.driver_type""",
    ),
    "feedback_recent": Query(
        lambda s, f: feedback.most_recent(typed(s, f), USER, 20).select("feedback_id", "target_id", "verdict", "driver_type", "created_at"),
        FEEDBACK_SQL + f" SELECT feedback_id, target_id, verdict, driver_type, created_at FROM fb WHERE user_id = {USER} ORDER BY created_at DESC, feedback_id LIMIT 20",
    ),
    "feedback_of_target": Query(
        lambda s, f: feedback.of_target(typed(s, f), USER, "kpi-5").select("feedback_id", "verdict", "driver_type"),
        FEEDBACK_SQL + f" SELECT feedback_id, verdict, driver_type FROM fb WHERE user_id = {USER} AND target_id = 'kpi-5'",
    ),
    "target_driver_types": Query(
        lambda s, f: feedback.target_driver_types(findings_log(s, f)),
        """WITH l AS (SELECT user_id, event_id % 3 AS kpi, CASE event_type WHEN 'purchase' THEN 'volume' WHEN 'view' THEN 'region' END AS t,
            row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts DESC, event_id DESC) AS n FROM events)
           SELECT user_id, kpi, coalesce(arg_min(t, n) FILTER (t IS NOT NULL), 'other') AS driver_type FROM l GROUP BY ALL""",
    ),
    "stage_latencies": Query(
        lambda s, f: telemetry.stage_latencies(timings(s, f)),
        CALLS_SQL + """ SELECT event_type AS stage, count(*) AS calls, CAST(sum(latency_ms) AS DOUBLE) / count(*) AS avg_latency_ms,
          min(latency_ms) AS min_latency_ms, max(latency_ms) AS max_latency_ms FROM calls JOIN events ON call_id = event_id GROUP BY 1""",
    ),
    "call_totals": Query(
        lambda s, f: telemetry.call_totals(calls(s, f), ("user_id",)),
        CALLS_SQL + """ SELECT user_id, count(*) AS total_calls, CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS total_completion_tokens,
          CAST(sum(CAST(micro AS BIGINT)) AS DOUBLE) / 1e6 AS total_cost_usd, CAST(sum(latency_ms) AS DOUBLE) / count(*) AS avg_latency_ms,
          count(*) FILTER (cached) AS cached_calls, count(*) FILTER (cached) / count(*) AS cache_hit_rate FROM calls GROUP BY user_id""",
    ),
    "call_ledger": Query(
        ledger, CALLS_SQL + """ SELECT user_id, count(*) AS calls, CAST(sum(CAST(micro AS BIGINT)) AS DOUBLE) / 1e6 AS cost_usd,
          arg_max(call_id, (created_at, call_id)) AS last_call_id, arg_max(prompt_tokens, (created_at, call_id)) AS last_prompt_tokens FROM calls GROUP BY user_id""",
    ),
    "cached_result": Query(
        lambda s, f: telemetry.cached_result(calls(s, f)).select("user_id", "package_hash", "call_id", "cost_usd"),
        CALLS_SQL + """ SELECT user_id, package_hash, call_id, micro / 1e6 AS cost_usd FROM calls WHERE NOT cached
          QUALIFY row_number() OVER (PARTITION BY user_id, package_hash ORDER BY created_at DESC, call_id DESC) = 1""",
    ),
    "cumulative_cost": Query(
        lambda s, f: telemetry.cumulative_cost(calls(s, f)).select("user_id", "call_id", "call_number", "cumulative_cost_usd"),
        CALLS_SQL + """ SELECT user_id, call_id, row_number() OVER w AS call_number, CAST(sum(CAST(micro AS BIGINT)) OVER w AS DOUBLE) / 1e6 AS cumulative_cost_usd
          FROM calls WINDOW w AS (PARTITION BY user_id ORDER BY created_at, call_id ROWS UNBOUNDED PRECEDING)""",
    ),
    "history_page": Query(page, HISTORY_SQL + " ORDER BY ts DESC, event_id DESC LIMIT 10 OFFSET 10"),
    "history_size": Query(
        history_size,
        f"SELECT count(*) AS row_count, greatest(CAST(ceil(count(*) / 25.0) AS BIGINT), 1) AS total_pages FROM events WHERE user_id = {USER}",
    ),
    "table_checks": Query(table_checks, CHECKS_SQL),
}
