"""Upkeep of stored tables, with test tables standing in for the metadata."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.functions import text
from kpiloom.operators import checks
from kpiloom.session import scratch_folder
from kpiloom.sources import datasets, readers
from kpiloom.sources.snapshots import StoredTable
from kpiloom.streaming import event_log
from workload import Query, table


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """Event rows as versions of one record per user and type; a plain click is a later correction."""
    return table(spark, folder, "events").select(
        "user_id", F.col("event_type").alias("key"), F.col("event_id").alias("version"), "value", F.col("ts").alias("changed_at")
    )


def latest(spark: SparkSession, folder: str) -> DataFrame:
    rows = versions(spark, folder)
    early, late = F.col("version") % 2 == 0, F.col("version") % 2 == 1
    stored = rows.filter(early)
    incoming = rows.filter(late).withColumn("changed_at", F.date_trunc("hour", "changed_at").cast("timestamp_ntz"))
    incoming = datasets.newest(incoming, ["user_id", "key", "changed_at"], [F.desc("version")])
    return datasets.upsert(stored, incoming, ["user_id", "key"], "changed_at")


LATEST_SQL = """WITH v AS (SELECT user_id, event_type AS key, event_id AS version, value, ts AS changed_at FROM events),
i AS (SELECT * REPLACE (date_trunc('hour', changed_at) AS changed_at) FROM v WHERE version % 2 = 1),
i2 AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY user_id, key, changed_at ORDER BY version DESC) = 1),
b AS (SELECT *, 0 AS incoming FROM v WHERE version % 2 = 0 UNION ALL SELECT *, 1 FROM i2)
SELECT user_id, key, version, value, changed_at FROM b QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY changed_at DESC, incoming DESC) = 1"""


def catalog(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Suppliers as sources, nations as datasets, customers as KPIs, orders as computations."""
    sources = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").alias("home"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("s_suppkey").cast("int") % 365).alias("uploaded_at"))
    members = sources.groupBy("home").agg(F.array_sort(F.collect_list("source_id")).alias("source_ids"))
    return {
        "sources": sources.drop("home"),
        "canonical_datasets": members.select(F.col("home").alias("dataset_id"), "source_ids"),
        "kpis": table(spark, folder, "customer").select(F.col("c_custkey").alias("kpi_id"), F.col("c_nationkey").alias("dataset_id")),
        "kpi_computations": table(spark, folder, "orders").select(F.col("o_custkey").alias("kpi_id"), "o_orderkey"),
        "profiles": table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("source_id"), "l_orderkey"),
    }


def after_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Rows left in every table after deleting the sources with a negative balance."""
    gone = table(spark, folder, "supplier").filter(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("source_id"))
    left = datasets.without_sources(catalog(spark, folder), gone)
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


DELETE_SQL = """WITH gone AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0), gd AS (SELECT DISTINCT s_nationkey AS d FROM supplier WHERE s_acctbal < 0),
gk AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT d FROM gd))
SELECT 'sources' AS "table", count(*) AS rows FROM supplier WHERE s_suppkey NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'canonical_datasets', count(DISTINCT s_nationkey) FROM supplier WHERE s_nationkey NOT IN (SELECT * FROM gd)
UNION ALL SELECT 'kpis', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT * FROM gd)
UNION ALL SELECT 'kpi_computations', count(*) FROM orders WHERE o_custkey NOT IN (SELECT * FROM gk)
UNION ALL SELECT 'profiles', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT * FROM gone)"""


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored_latest(spark: SparkSession, folder: str) -> DataFrame:
    """As ``latest``, but on a stored table: its rows before and after, told apart by snapshot."""
    rows = versions(spark, folder)
    table_ = StoredTable(spark, new_folder(spark, "versions"), ["user_id", "key"])
    table_.create(datasets.newest(rows.filter("version % 2 = 0"), ["user_id", "key"], [F.desc("changed_at"), F.desc("version")]))
    incoming = rows.filter("version % 2 = 1").withColumn("changed_at", F.date_trunc("hour", "changed_at").cast("timestamp_ntz"))
    table_.upsert(datasets.newest(incoming, ["user_id", "key", "changed_at"], [F.desc("version")]), "changed_at")
    return table_.read(0).withColumn("snapshot", F.lit(0)).unionByName(table_.read(1).withColumn("snapshot", F.lit(1)))


STORED_LATEST_SQL = """WITH v AS (SELECT user_id, event_type AS key, event_id AS version, value, ts AS changed_at FROM events),
o AS (SELECT * FROM v WHERE version % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY changed_at DESC, version DESC) = 1),
i AS (SELECT * REPLACE (date_trunc('hour', changed_at) AS changed_at) FROM v WHERE version % 2 = 1),
i2 AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY user_id, key, changed_at ORDER BY version DESC) = 1),
b AS (SELECT *, 0 AS incoming FROM o UNION ALL SELECT *, 1 FROM i2)
SELECT *, 0 AS snapshot FROM o UNION ALL
SELECT * EXCLUDE (incoming), 1 FROM b QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY changed_at DESC, incoming DESC) = 1"""

#: Keys of the stored catalog tables.
CATALOG_KEYS = {
    "sources": ["source_id"], "canonical_datasets": ["dataset_id"], "kpis": ["kpi_id"], "kpi_computations": ["kpi_id", "o_orderkey"],
    "profiles": ["source_id", "l_orderkey"],
}


def stored_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every stored table before and after the cascade of ``after_delete``."""
    tables = {}
    for name, rows in catalog(spark, folder).items():
        tables[name] = StoredTable(spark, new_folder(spark, name), CATALOG_KEYS[name], file_rows=20_000)
        tables[name].create(rows)
    gone = table(spark, folder, "supplier").filter(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("source_id"))
    datasets.delete_sources(tables, gone)
    parts = [
        stored.read(version).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), F.lit(when).alias("state"), "rows")
        for name, stored in tables.items() for when, version in (("before", 0), ("after", None))
    ]
    return reduce(DataFrame.unionByName, parts)


def replayed_log(spark: SparkSession, folder: str) -> DataFrame:
    """Even events appended in two batches and odd ones by a stream, all of it twice, into one log."""
    events = table(spark, folder, "events")
    log, inbox, check = (new_folder(spark, n) for n in ("event-log", "event-inbox", "event-check"))
    events.filter("event_id % 2 = 1").write.parquet(inbox)
    for _ in range(2):
        for batch in (0, 1):
            datasets.append_rows(events.filter(f"event_id % 4 = {2 * batch}"), log, "loader", batch)
        event_log.append_stream(spark.readStream.schema(events.schema).parquet(inbox), log, check).awaitTermination()
    return datasets.read_rows(spark, log)


def page_by_key(spark: SparkSession, folder: str) -> DataFrame:
    """A page deep inside lineitem stored by key, read from the files it lies in."""
    rows = table(spark, folder, "lineitem")
    stored = StoredTable(spark, new_folder(spark, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], file_rows=10_000)
    stored.create(rows)
    return stored.page(120, 37)


def usage(spark: SparkSession, folder: str) -> DataFrame:
    """How many datasets (one per order priority and status) use each customer's market segment as a source."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    used = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderpriority", "o_orderstatus").agg(
        F.array_sort(F.collect_set("c_mktsegment")).alias("source_ids")
    )
    sources = customer.select(F.col("c_mktsegment").alias("source_id")).distinct().unionByName(
        table(spark, folder, "region").select(F.col("r_name").alias("source_id"))
    )
    return datasets.source_usage(sources, used)


def freshness(spark: SparkSession, folder: str) -> DataFrame:
    c = catalog(spark, folder)
    return datasets.freshness(c["canonical_datasets"], c["sources"])


def preview(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.preview(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], page=3)


def records(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("status"))
    return datasets.preview_json(rows)


def parsed_properties(spark: SparkSession, folder: str) -> DataFrame:
    """JSON text read with a schema and written again."""
    rows = table(spark, folder, "events").withColumn("p", F.from_json("props", "k int"))
    return rows.select("event_id", F.col("p.k").cast("bigint").alias("k"), text.stable_json(F.col("p")).alias("again"))


def round_trip(spark: SparkSession, folder: str, fmt: str) -> DataFrame:
    """Orders written to a new folder as a dataset and loaded again with inferred types."""
    orders = table(spark, folder, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")))
    renamed = orders.withColumnsRenamed({"o_totalprice": " Total Price", "o_orderdate": "Order Date "})
    path = f"{scratch_folder(spark)}/round-trip-{fmt}-{uuid.uuid4().hex}"
    if fmt == "csv":
        datasets.write_dataset(renamed, path, "csv")
        back = readers.load_source(spark, path, ".CSV")
    elif fmt == "json":
        renamed.write.json(path)
        back = readers.load_json(spark, path, lines=True)
    else:
        datasets.write_dataset(orders.withColumnsRenamed({"o_totalprice": "Total_Price"}), path)
        back = readers.load_source(spark, path, "parquet")
    return back.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.col("total_price").cast("decimal(18,2)")).cast("double").alias("total")
    )


ROUND_TRIP_SQL = """SELECT CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS o_orderpriority, count(*) AS orders,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1"""


def by_reference(spark: SparkSession, folder: str, name: str, filetype: str) -> DataFrame:
    """A table written as a dataset and read through the catalog's row for it, all columns."""
    path = datasets.write_dataset(table(spark, folder, name), new_folder(spark, name), filetype)
    rows = [("u", "other", f"{path}-none", "parquet"), ("u", name, path, f".{filetype.upper()}"), ("v", name, f"{path}-none", "csv")]
    return datasets.read_dataset(spark, spark.createDataFrame(rows, "user_id string, dataset_id string, path string, filetype string"), "u", name)


QUERIES = {
    "dataset_by_reference": Query(lambda s, f: by_reference(s, f, "orders", "parquet"), "SELECT * FROM orders"),
    "dataset_by_reference_csv": Query(lambda s, f: by_reference(s, f, "customer", "csv"), "SELECT * FROM customer"),
    "latest_wins": Query(latest, LATEST_SQL),
    "stored_latest_wins": Query(stored_latest, STORED_LATEST_SQL),
    "stored_cascade_delete": Query(
        stored_delete, f"""SELECT *, 'after' AS state FROM ({DELETE_SQL}) UNION ALL
          SELECT 'sources', count(*), 'before' FROM supplier UNION ALL SELECT 'canonical_datasets', count(DISTINCT s_nationkey), 'before' FROM supplier
          UNION ALL SELECT 'kpis', count(*), 'before' FROM customer UNION ALL SELECT 'kpi_computations', count(*), 'before' FROM orders
          UNION ALL SELECT 'profiles', count(*), 'before' FROM lineitem""",
    ),
    "event_log_replayed": Query(replayed_log, "SELECT * FROM events"),
    "page_by_key": Query(
        page_by_key, "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 37 OFFSET 4403"
    ),
    "cascade_delete": Query(after_delete, DELETE_SQL),
    "source_usage": Query(
        usage, """WITH u AS (SELECT DISTINCT o_orderpriority, o_orderstatus, c_mktsegment AS source_id FROM orders JOIN customer ON o_custkey = c_custkey),
          s AS (SELECT DISTINCT c_mktsegment AS source_id FROM customer UNION ALL SELECT r_name FROM region)
          SELECT s.source_id, count(u.source_id) AS derived_dataset_count FROM s LEFT JOIN u USING (source_id) GROUP BY s.source_id""",
    ),
    "source_freshness": Query(
        freshness, "SELECT s_nationkey AS dataset_id, max(DATE '2024-01-01' + CAST(s_suppkey % 365 AS INTEGER)) AS source_freshness FROM supplier GROUP BY 1"
    ),
    "preview_page": Query(
        preview, "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 20 OFFSET 40"
    ),
    "preview_size": Query(
        lambda s, f: datasets.page_counts(table(s, f, "lineitem")),
        "SELECT count(*) AS row_count, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM lineitem",
    ),
    "preview_records": Query(
        records, """SELECT '{"o_orderkey":' || o_orderkey || ',"day":"' || CAST(o_orderdate AS DATE) || '","status":' ||
          CASE WHEN o_orderkey % 5 <> 0 THEN '"' || o_orderstatus || '"' ELSE 'null' END || '}' AS record FROM orders""",
    ),
    "json_properties": Query(
        parsed_properties,
        """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"k":' || json_extract(props, '$.k') || '}' AS again FROM events""",
    ),
    "orphans": Query(
        lambda s, f: checks.orphans(
            table(s, f, "lineitem"), "l_orderkey", table(s, f, "orders").filter(F.col("o_orderstatus") != "F"), "o_orderkey"
        ),
        "SELECT l_orderkey AS key, count(*) AS rows FROM lineitem ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') ON l_orderkey = o_orderkey GROUP BY 1",
    ),
    "repeated_keys": Query(
        lambda s, f: checks.repeated_keys(table(s, f, "lineitem"), ["l_orderkey", "l_linenumber"]),
        "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    ),
    "hierarchy_violations": Query(
        lambda s, f: checks.hierarchy_violations(table(s, f, "customer"), "c_mktsegment", "c_nationkey"),
        """SELECT c_mktsegment, c_nationkey, count(*) AS rows FROM customer WHERE c_nationkey IN
           (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1) GROUP BY ALL""",
    ),
    "csv_round_trip": Query(lambda s, f: round_trip(s, f, "csv"), ROUND_TRIP_SQL),
    "json_round_trip": Query(lambda s, f: round_trip(s, f, "json"), ROUND_TRIP_SQL),
    "parquet_round_trip": Query(lambda s, f: round_trip(s, f, "parquet"), ROUND_TRIP_SQL),
}
