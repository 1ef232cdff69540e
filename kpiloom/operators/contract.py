"""Semantic contracts: what each source's columns mean, one row per source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Profile role to semantic role.
SEMANTIC_ROLES = {"temporal": "time", "numerical": "measure", "categorical": "dimension", "identifier": "identifier"}
# Name parts that make a measure average instead of sum.
AVERAGE_HINTS = ("pct", "percent", "share", "fraction", "ratio")
RATE_HINT = "rate"
# Contract defaults.
MATERIALITY_STD_DEVS = 1.0
MIN_SUPPORT_ROWS = 10
DEFAULT_TAG = "public"
REQUIRED_FIELDS = ("kpi_definitions", "hierarchies", "calendar", "thresholds", "access_tags")


def _name_has(name: Column, parts: Sequence[str]) -> Column:
    return name.rlike("|".join(parts))


def semantic_role(detected_role: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in SEMANTIC_ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, detected_role), F.lit("dimension"))


def default_aggregation(name: Column, values: Column, smallest: Column, largest: Column) -> Column:
    """Ratio-like names and columns whose values, two or more, all lie within [0, 1] average, ``rate`` names are rates,
    everything else sums. The whole column decides, not its first values."""
    unit = (values >= 2) & (smallest >= 0.0) & (largest <= 1.0)
    return (
        F.when(_name_has(name, AVERAGE_HINTS), "avg")
        .when(F.contains(name, F.lit(RATE_HINT)), "rate")
        .when(F.coalesce(unit, F.lit(False)), "avg")
        .otherwise("sum")
    )


def granularity(time_column: Column) -> Column:
    return (
        F.when(F.contains(time_column, F.lit("week")), "week")
        .when(_name_has(time_column, ("month", "quarter", "year")), "month")
        .otherwise("day")
    )


def classified(profiles: DataFrame) -> DataFrame:
    """Profile rows with their semantic role and, for measures, the default aggregation."""
    role = semantic_role(F.col("detected_role"))
    return profiles.withColumn("role", role).withColumn(
        "aggregation", F.when(role == "measure", default_aggregation(
            F.col("name"), F.col("row_count") - F.col("null_count"), F.col("min_number"), F.col("max_number"),
        ))
    )


def hierarchy_pairs(names: Column) -> Column:
    """Pairs of names where the parent's name begins the child's name, sorted.

    Every proper prefix of a name is looked up among the names instead of comparing all pairs.
    """
    def parents(child: Column) -> Column:
        prefixes = F.transform(F.sequence(F.lit(1), F.length(child) - 1), lambda k: F.substring(child, F.lit(1), k))
        known = F.when(F.length(child) > 1, F.array_intersect(prefixes, names)).otherwise(F.array().cast("array<string>"))
        return F.transform(known, lambda parent: F.struct(parent.alias("parent"), child.alias("child")))

    return F.array_sort(F.flatten(F.transform(names, parents)))


def hierarchies(profiles: DataFrame) -> DataFrame:
    """Likely parent and child dimensions of every source."""
    dimension = semantic_role(F.col("detected_role")) == "dimension"
    grouped = profiles.filter(dimension).groupBy("source_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return grouped.select("source_id", F.inline(hierarchy_pairs(F.col("names"))))


def build_contract(profiles: DataFrame, grain: str | None = None) -> DataFrame:
    """Contract rows for all profiled sources at once, from one pass over the profile rows."""
    rows = classified(profiles)
    item = F.struct("position", "name", "aggregation")

    def named(role: str) -> Column:
        kept = F.array_sort(F.collect_list(F.when(F.col("role") == role, item)))
        return kept

    grouped = rows.groupBy("source_id").agg(
        named("measure").alias("m"), named("dimension").alias("d"), named("time").alias("t"), named("identifier").alias("i"),
        F.array_sort(F.collect_list(F.struct("position", "name"))).alias("all_columns"),
    )
    dimension_names = F.col("d.name")
    time_name = F.try_element_at("t", F.lit(1))["name"]
    definitions = F.transform(
        "m",
        lambda m: F.struct(
            m["name"].alias("column"), m["aggregation"].alias("aggregation"), dimension_names.alias("sliceable_by")
        ),
    )
    return grouped.select(
        "source_id",
        F.lit(grain).cast("string").alias("grain"),
        definitions.alias("kpi_definitions"),
        hierarchy_pairs(dimension_names).alias("hierarchies"),
        F.struct(
            time_name.alias("time_column"), F.coalesce(granularity(time_name), F.lit("day")).alias("granularity")
        ).alias("calendar"),
        F.struct(
            F.lit(MATERIALITY_STD_DEVS).alias("materiality_std_devs"), F.lit(MIN_SUPPORT_ROWS).alias("min_support_rows")
        ).alias("thresholds"),
        F.lit(None).cast("struct<statistical:double,business:double>").alias("materiality_weights"),
        F.map_from_entries(F.transform("all_columns", lambda c: F.struct(c["name"], F.lit(DEFAULT_TAG)))).alias("access_tags"),
        F.struct(
            F.col("m.name").alias("measure"), dimension_names.alias("dimension"),
            F.col("t.name").alias("time"), F.col("i.name").alias("identifier"),
        ).alias("columns_by_role"),
    )


def invalid_contracts(contracts: DataFrame) -> DataFrame:
    """Contracts lacking a required field, with the names of the missing fields."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED_FIELDS]))
    return contracts.select("source_id", missing.alias("missing_fields")).filter(F.size("missing_fields") > 0)


def column_roles(contracts: DataFrame, order_by: str = "source_id") -> DataFrame:
    """Role of every column: a contract role before an access tag, an earlier contract before a later one."""
    roles = ("measure", "dimension", "time", "identifier")

    def listed(role: str, rank: int) -> Column:
        names = F.coalesce(F.col(f"columns_by_role.{role}"), F.array().cast("array<string>"))
        return F.transform(names, lambda c: F.struct(c.alias("column"), F.lit(role).alias("role"), F.lit(rank).alias("rank")))

    pieces = [listed(role, rank) for rank, role in enumerate(roles)]
    tags = F.transform(
        F.map_entries("access_tags"),
        lambda e: F.struct(e["key"].alias("column"), e["value"].alias("role"), F.lit(len(roles)).alias("rank")),
    )
    tagged = F.coalesce(tags, F.array().cast("array<struct<column:string,role:string,rank:int>>"))
    rows = contracts.select(F.col(order_by).alias("_ord"), F.inline(F.concat(*pieces, tagged)))
    return rows.groupBy("column").agg(F.min_by("role", F.struct("_ord", "rank")).alias("role"))


def settings(contracts: DataFrame, by: Sequence[str] = (), order_by: str = "source_id") -> DataFrame:
    """Materiality settings of each dataset: the first contract holding thresholds or weights provides them."""
    def first_held(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col(order_by))).alias(name)

    return contracts.groupBy(*by).agg(first_held("thresholds"), first_held("materiality_weights")).select(
        *by,
        F.col("thresholds.materiality_std_devs").alias("threshold"),
        F.col("materiality_weights.statistical").alias("weight_statistical"),
        F.col("materiality_weights.business").alias("weight_business"),
    )
