"""Persona access rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.operators import contract, drivers, governance, kpi
from kpiloom.operators.governance import Persona
from workload import Query, table
from workload.drivers import LINEITEM_WATERFALL_SQL, TOP_SQL, lineitem_waterfall
from workload.kpis import DISCOVERY_SQL, contracts

REGIONAL = Persona.parse('{"allowed_domains": ["l_returnflag", "l_linestatus"], "restricted_columns": ["l_tax"], "restricted_roles": ["identifier"]}')
HEADLINE = Persona.parse({"restricted_columns": ["l_partkey"], "max_slices": 3})


def kpis(spark: SparkSession, folder: str, held: DataFrame) -> DataFrame:
    found = kpi.discover_kpis(
        held, table(spark, folder, "orders").columns + table(spark, folder, "lineitem").columns, "o_orderdate"
    )
    return found.withColumn("status", F.lit("valid"))


def visible_kpis(spark: SparkSession, folder: str) -> DataFrame:
    held = contracts(spark, folder)
    shown = governance.for_persona(kpis(spark, folder, held), REGIONAL, held)
    return shown.select("name", "measure", "aggregation")


def visible_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings with the strongest slices a headline persona may see."""
    top = drivers.top_slices(lineitem_waterfall(spark, folder), 6)
    nested = top.groupBy("kpi", "dimension").agg(F.array_sort(F.collect_list(F.struct("rank", "slice", "contribution"))).alias("slices"))
    shown = governance.for_persona(nested, HEADLINE)
    return shown.select("kpi", "dimension", F.inline("slices"))


def roles(spark: SparkSession, folder: str) -> DataFrame:
    return contract.column_roles(contracts(spark, folder))


QUERIES = {
    "persona_kpis": Query(
        visible_kpis, f"SELECT name, measure, aggregation FROM ({DISCOVERY_SQL}) WHERE slice_columns = 'l_returnflag,l_linestatus' AND measure <> 'l_tax'"
    ),
    "persona_findings": Query(
        visible_findings, LINEITEM_WATERFALL_SQL + TOP_SQL.format(k=3).replace("SELECT * FROM (", "SELECT kpi, dimension, rank, slice, contribution FROM (")
        + " AND dimension <> 'l_partkey'",
    ),
    "column_roles": Query(
        roles, f"""SELECT measure AS "column", 'measure' AS role FROM ({DISCOVERY_SQL}) UNION SELECT unnest(string_split(slice_columns, ',')), 'dimension' FROM ({DISCOVERY_SQL})
          UNION SELECT unnest(['o_orderdate', 'l_shipdate']), 'time'
          UNION SELECT c, 'identifier' FROM (VALUES ('o_orderkey'), ('o_custkey')) v(c) WHERE c NOT IN (SELECT measure FROM ({DISCOVERY_SQL}))""",
    ),
}
