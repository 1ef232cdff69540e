"""From a fact table and its contract to insights and recommendation packages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from kpiloom.model import Kpi
from kpiloom.operators import anomaly, drivers, findings, kpi, materiality, narrative
from kpiloom.session import cut_lineage

DISPLAY_SLICES = 12


@dataclass
class MovementReport:
    """Tables of one analysis, all keyed by KPI."""

    trend: DataFrame
    validated: DataFrame
    summary: DataFrame
    anomalies: DataFrame
    anomaly_findings: DataFrame
    slices: DataFrame
    findings: DataFrame
    insights: DataFrame
    packages: DataFrame


def analyse(
    df: DataFrame, kpis: Sequence[Kpi], time_column: str, dimensions: Sequence[str], grain: str = "day",
    quality_score: float | DataFrame | None = None, date_format: str | None = None, dataset_id: str = "",
    source_ids: tuple[str, ...] = (), source_freshness: str = "", display_slices: int = DISPLAY_SLICES,
) -> MovementReport:
    """Analyse the latest movement of every KPI across all dimensions.

    One scan of the fact table serves all trends; their period statistics are written once and shared by every later step. Each
    driver table reads the compared periods only. ``quality_score`` is one score, or a table ``(dataset_id, score)`` such as that of
    ``datasets.weakest_quality``. A finding shows the ``display_slices`` largest slices and counts all of them.
    """
    statistics = cut_lineage(kpi.period_statistics(df, kpis, time_column, grain, date_format=date_format))
    trend = kpi.trend_points(statistics)
    validated = kpi.validate_kpis(statistics, kpis, df.columns)
    summary = materiality.score_materiality(kpi.compute_kpis(trend))
    marked = anomaly.marks(trend)
    flags = anomaly.flags_of(marked)
    scored_anomalies = findings.apply_confidence(anomaly.anomaly_findings(marked, validated, (), dataset_id, source_freshness), quality_score)
    movements = drivers.latest_movements(trend, kpis)
    slices = drivers.decompose(df, movements, dimensions, time_column, grain, date_format)
    built = findings.driver_findings(
        drivers.ranked_dimensions(slices), drivers.top_slices(slices, display_slices), validated, dataset_id, source_ids,
        source_freshness, flags,
    )
    scored = findings.apply_confidence(built, quality_score)
    return MovementReport(
        trend, validated, summary, flags, scored_anomalies, slices, scored,
        narrative.insights(scored), narrative.recommendation_packages(scored),
    )
