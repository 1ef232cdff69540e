"""What a persona may see: KPIs and findings outside its rules are removed, not masked."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.operators.contract import column_roles


@dataclass(frozen=True)
class Persona:
    """Access rules. None means no restriction of that kind."""

    allowed_domains: tuple[str, ...] | None = None
    restricted_roles: tuple[str, ...] = ()
    restricted_columns: tuple[str, ...] = ()
    max_slices: int | None = None

    @classmethod
    def parse(cls, access_json: str | dict | None) -> "Persona | None":
        """Rules of a stored persona row; none when there are no rules."""
        rules = json.loads(access_json) if isinstance(access_json, str) else access_json
        if not rules:
            return None
        domains = rules.get("allowed_domains")
        return cls(
            None if domains is None else tuple(domains), tuple(rules.get("restricted_roles") or ()),
            tuple(rules.get("restricted_columns") or ()), rules.get("max_slices"),
        )


def _names(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def restricted_names(contracts: DataFrame | None, persona: Persona) -> DataFrame | None:
    """Columns whose role the persona may not see."""
    if contracts is None or not persona.restricted_roles:
        return None
    return column_roles(contracts).filter(F.col("role").isin(list(persona.restricted_roles))).select("column")


def visible_kpis(kpis: DataFrame, persona: Persona | None, contracts: DataFrame | None = None) -> DataFrame:
    """KPIs whose measure and slices the persona may see. Domains apply to KPIs that carry a status."""
    if persona is None:
        return kpis
    kept = kpis
    if persona.allowed_domains is not None:
        outside = F.size(F.array_except("slice_columns", _names(persona.allowed_domains))) > 0
        judged = F.coalesce(F.col("status") != "", F.lit(False)) if "status" in kpis.columns else F.lit(False)
        kept = kept.filter(~(judged & outside))
    if persona.restricted_columns:
        kept = kept.filter(~F.col("measure").isin(list(persona.restricted_columns)))
    hidden = restricted_names(contracts, persona)
    if hidden is not None:
        kept = kept.join(hidden.withColumnRenamed("column", "measure"), "measure", "left_anti")
        # equal names of different datasets are different KPIs
        own = [c for c in ("dataset_id", "name") if c in kpis.columns]
        touched = kept.select(*own, F.explode("slice_columns").alias("column")).join(hidden, "column", "left_semi")
        touched = touched.select(*own).distinct().alias("t")
        same = [F.col(f"k.{c}").eqNullSafe(F.col(f"t.{c}")) for c in own]
        kept = kept.alias("k").join(touched, same, "left_anti")
    return kept.select(*kpis.columns)


def visible_findings(findings: DataFrame, persona: Persona | None, contracts: DataFrame | None = None) -> DataFrame:
    """Findings on dimensions the persona may see, with at most its number of slices."""
    if persona is None:
        return findings
    kept = findings
    named = F.col("dimension").isNotNull()
    if persona.allowed_domains is not None:
        kept = kept.filter(~named | F.array_contains(_names(persona.allowed_domains), F.col("dimension")))
    if persona.restricted_columns:
        kept = kept.filter(~named | ~F.col("dimension").isin(list(persona.restricted_columns)))
    hidden = restricted_names(contracts, persona)
    if hidden is not None:
        kept = kept.join(hidden.withColumnRenamed("column", "dimension"), "dimension", "left_anti")
    if persona.max_slices is not None and "slices" in findings.columns:
        kept = kept.withColumn("slices", F.slice("slices", 1, persona.max_slices))
    return kept.select(*findings.columns)


def for_persona(data: DataFrame, persona: Persona | None, contracts: DataFrame | None = None) -> DataFrame:
    """The right filter for a KPI table or a finding table; without rules the data is unchanged."""
    if persona is None:
        return data
    if "measure" in data.columns:
        return visible_kpis(data, persona, contracts)
    if "dimension" in data.columns:
        return visible_findings(data, persona, contracts)
    return data


def owned(df: DataFrame, user_id: str) -> DataFrame:
    """Rows of one user."""
    return df.filter(F.col("user_id") == user_id)
