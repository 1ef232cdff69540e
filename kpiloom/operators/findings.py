"""Findings: evidence, confidence and abstention.

A finding row has a key, a type, a payload in typed columns and these evidence columns: ``statistic``, ``p_value``,
``effect_size``, ``corroborating_methods`` (array of method and direction), ``kpi_status``, ``period_count`` and
``quality_score``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.functions.exact import half_even
from kpiloom.functions.text import fixed, stable_id
from kpiloom.model import MIN_PERIODS

# Fixed values
QUALITY_WEIGHT = 0.30
STATISTICAL_WEIGHT = 0.30
SAMPLE_WEIGHT = 0.25
AGREEMENT_WEIGHT = 0.15
ABSTAIN_BELOW = 0.50
MEDIUM_FROM = 0.65
HIGH_FROM = 0.80
P_STRONG = 0.05
P_MODERATE = 0.20
EFFECT_STRONG = 0.8
EFFECT_MODERATE = 0.5
WATERFALL = "waterfall decomposition (period-over-period slice deltas)"
DIFF_IN_DIFF = "difference-in-differences (2x2, treatment vs control movement)"
# Columns an abstained finding keeps.
IDENTITY = (
    "finding_id", "kpi", "finding_type", "finding_key", "dataset_id", "evidence", "method_label", "lineage", "confidence",
    "composite",
)
ABSTAIN_MESSAGE = "Insufficient or contradictory evidence — abstaining from a conclusion."


# --- evidence --------------------------------------------------------------------------------------------------------


def default_lineage(finding_type: Column, dataset_id: Column, kpi_id: Column, kpi_name: Column) -> Column:
    """Dataset, KPI and finding, leaving out what is unknown."""
    def step(label: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(label), value))

    return F.array_compact(
        F.array(
            step("canonical dataset ", dataset_id), step("KPI ", kpi_id), step("KPI name: ", kpi_name),
            step("finding: ", finding_type),
        )
    )


def evidence(
    finding_type: Column, method: Column, statistic: Column, source_freshness: Column, lineage: Column,
    p_value: Column | None = None, effect_size: Column | None = None, built_at: Column | None = None,
) -> Column:
    """Evidence record. The build time is an argument, so results never depend on the clock."""
    none = F.lit(None).cast("double")
    return F.struct(
        finding_type.alias("finding_type"), method.alias("method"), statistic.cast("double").alias("statistic"),
        (none if p_value is None else p_value).alias("p_value"),
        (none if effect_size is None else effect_size).alias("effect_size"),
        source_freshness.cast("string").alias("source_freshness"), lineage.alias("lineage"),
        (F.lit(None).cast("timestamp") if built_at is None else built_at).alias("built_at"),
    )


def driver_findings(
    dimensions: DataFrame, top: DataFrame, validated: DataFrame, dataset_id: str = "", source_ids: tuple[str, ...] = (),
    source_freshness: str = "", anomaly_counts: DataFrame | None = None,
) -> DataFrame:
    """One finding per (KPI, dimension) with its displayed top slices and waterfall evidence.

    ``dimensions`` comes from ``drivers.ranked_dimensions`` and ``top`` from ``drivers.top_slices``; the slice array
    holds only those top slices, so it stays bounded however many slices a dimension has; ``slice_count`` tells how many it has.
    """
    display = F.struct(
        "rank", "slice", half_even(F.col("before"), 4).alias("before"), half_even(F.col("after"), 4).alias("after"),
        half_even(F.col("contribution"), 4).alias("contribution"), half_even(F.col("share_pct"), 2).alias("share_pct"), "direction",
    )
    nested = top.groupBy("kpi", "dimension").agg(F.array_sort(F.collect_list(display)).alias("slices"))
    status = validated.select("kpi", F.col("status").alias("kpi_status"), "period_count")
    rows = dimensions.join(nested, ["kpi", "dimension"], "left").join(status, "kpi", "left")
    if anomaly_counts is not None:
        per_kpi = anomaly_counts.groupBy("kpi").agg(
            F.count_if(F.col("method") == "change_points").alias("change_points"),
            F.count_if(F.col("method") == "outliers").alias("outliers"),
        )
        rows = rows.join(per_kpi, "kpi", "left")
    else:
        rows = rows.withColumn("change_points", F.lit(0)).withColumn("outliers", F.lit(0))
    steps = F.array(
        F.lit(f"sources: {', '.join(source_ids)}"), F.lit(f"canonical dataset {dataset_id}"),
        F.concat(F.lit("KPI "), "kpi"),
        F.concat(F.lit("driver decomposition across dimension '"), "dimension", F.lit("'")),
    )
    kind = F.lit("driver_contribution")
    statistic = F.try_element_at("slices", F.lit(1))["contribution"]
    key = F.concat(F.lit("dimension:"), "dimension")
    return rows.select(
        stable_id(F.lit("finding"), F.col("kpi"), kind, key).alias("finding_id"),
        "kpi", F.lit(dataset_id).alias("dataset_id"), kind.alias("finding_type"), key.alias("finding_key"), "dimension", "dimension_rank", "slice_count",
        "before_period", "after_period", "before_value", "after_value", "total_movement", "residual", "slices",
        F.struct(
            F.coalesce("change_points", F.lit(0)).alias("change_points"), F.coalesce("outliers", F.lit(0)).alias("outliers")
        ).alias("anomaly_context"),
        "kpi_status", "period_count", statistic.alias("statistic"),
        F.lit(None).cast("double").alias("p_value"), F.lit(None).cast("double").alias("effect_size"),
        F.array().cast("array<struct<method:string,direction:string>>").alias("corroborating_methods"),
        evidence(kind, F.lit(WATERFALL), statistic, F.lit(source_freshness), steps).alias("evidence"),
    )


def causal_findings(
    tests: DataFrame, kpi: str, kpi_status: str, dataset_id: str = "", source_ids: tuple[str, ...] = (), source_freshness: str = ""
) -> DataFrame:
    """Findings of difference-in-differences rows."""
    kind = F.lit("causal_diff_in_diff")
    key = F.concat(F.lit("did:"), "treatment_dim", F.lit(":"), "treatment_value")
    steps = F.array(
        F.lit(f"sources: {', '.join(source_ids)}"), F.lit(f"canonical dataset {dataset_id}"), F.lit(f"KPI {kpi}"),
        F.concat(F.lit("DiD on treatment '"), "treatment_dim", F.lit("="), "treatment_value", F.lit("'")),
    )
    return tests.select(
        stable_id(F.lit("finding"), F.lit(kpi), kind, key).alias("finding_id"), F.lit(kpi).alias("kpi"),
        F.lit(dataset_id).alias("dataset_id"), kind.alias("finding_type"), key.alias("finding_key"), "*",
        F.col("did_estimate").alias("statistic"), F.lit(kpi_status).alias("kpi_status"),
        F.lit(None).cast("bigint").alias("period_count"),
        F.array().cast("array<struct<method:string,direction:string>>").alias("corroborating_methods"),
        evidence(
            kind, F.lit(DIFF_IN_DIFF), F.col("did_estimate"), F.lit(source_freshness), steps, F.col("p_value"),
            F.col("effect_size"),
        ).alias("evidence"),
    )


# --- confidence ------------------------------------------------------------------------------------------------------


def _part(score: Column | float, reason: Column, missing: Column | None = None) -> Column:
    value = score if isinstance(score, Column) else F.lit(float(score))
    note = F.lit(None).cast("string") if missing is None else missing
    return F.struct(value.alias("score"), reason.alias("reason"), note.alias("missing"))


def evidence_quality(quality_score: Column) -> Column:
    shown = fixed(quality_score, 1)
    scaled = F.greatest(F.least((quality_score - 40.0) / 60.0, F.lit(1.0)), F.lit(0.0))
    missing = F.when(
        quality_score < 60.0, F.concat(F.lit("underlying data quality above 60 (currently "), shown, F.lit(")"))
    )
    return F.when(
        quality_score.isNull(),
        _part(0.0, F.lit("no data-quality report available for underlying source"),
              F.lit("a data-quality report for the underlying source")),
    ).otherwise(_part(scaled, F.concat(F.lit("data-quality score "), shown, F.lit("/100")), missing))


def statistical_strength(p_value: Column, effect_size: Column, statistic: Column) -> Column:
    """Strength from the p-value, else from the absolute effect size, else from having an exact statistic at all."""
    def graded(shown: Column, strong: Column, moderate: Column) -> Column:
        return (
            F.when(strong, _part(1.0, F.concat(F.lit("strong significance (p/effect "), shown, F.lit(")"))))
            .when(moderate, _part(0.6, F.concat(F.lit("moderate significance (p/effect "), shown, F.lit(")"))))
            .otherwise(
                _part(0.2, F.concat(F.lit("weak significance (p/effect "), shown, F.lit(")")),
                      F.lit("stronger statistical significance"))
            )
        )

    effect = F.abs(effect_size)
    return (
        F.when(p_value.isNotNull(), graded(fixed(p_value, 4), p_value <= P_STRONG, p_value <= P_MODERATE))
        .when(
            effect_size.isNotNull(),
            graded(fixed(effect_size, 4), effect >= EFFECT_STRONG, effect >= EFFECT_MODERATE),
        )
        .when(statistic.isNotNull(), _part(0.55, F.lit("deterministic method, no inferential p-value")))
        .otherwise(_part(0.0, F.lit("no statistical evidence attached"), F.lit("a significance test or effect size")))
    )


def sample_size(kpi_status: Column, period_count: Column) -> Column:
    n = F.coalesce(period_count, F.lit(MIN_PERIODS - 1)).cast("string")
    more = F.concat(F.lit(f"more time periods (at least {MIN_PERIODS} required, have "), n, F.lit(")"))
    return (
        F.when(
            F.coalesce(kpi_status == "invalid", F.lit(False)) | (kpi_status.isNull() & period_count.isNull()),
            _part(0.0, F.lit("underlying KPI is invalid")),
        )
        .when(kpi_status == "low-data", _part(0.4, F.concat(F.lit("low-data KPI ("), n, F.lit(" periods)")), more))
        .when(period_count.isNull(), _part(1.0, F.lit("KPI validation passed")))
        .when(period_count >= MIN_PERIODS, _part(1.0, F.concat(F.lit("sufficient sample ("), n, F.lit(" periods)"))))
        .otherwise(_part(0.4, F.concat(F.lit("only "), n, F.lit(" periods")), more))
    )


def _directions(methods: Column) -> Column:
    words = F.transform(methods, lambda m: F.lower(F.coalesce(m["direction"], F.lit(""))))
    return F.array_sort(F.array_distinct(F.filter(words, lambda d: d != "")))


def contradictory(methods: Column) -> Column:
    return F.coalesce(F.size(_directions(methods)) > 1, F.lit(False))


def method_agreement(methods: Column) -> Column:
    count = F.coalesce(F.size(methods), F.lit(0))
    listed = F.concat(F.lit("['"), F.array_join(_directions(methods), "', '"), F.lit("']"))
    return (
        F.when(
            count <= 0,
            _part(0.7, F.lit("single method, uncorroborated"), F.lit("corroboration from a second detection method")),
        )
        .when(contradictory(methods), _part(0.0, F.concat(F.lit("contradictory signals across methods ("), listed, F.lit(")"))))
        .otherwise(
            _part(1.0, F.concat(F.lit("corroborated by "), count.cast("string"), F.lit(" methods (consistent direction)")))
        )
    )


def score_confidence(findings: DataFrame, p_or_effect: bool = False) -> DataFrame:
    """Add ``composite`` and ``confidence`` (level, reasons, missing evidence) to findings.

    ``p_or_effect`` reads the p-value, or the effect size where there is none, as one number against the p limits.
    """
    p, effect = F.col("p_value"), F.col("effect_size")
    if p_or_effect:
        p, effect = F.coalesce(p, effect), F.lit(None).cast("double")
    rows = (
        findings.withColumn("_q", evidence_quality(F.col("quality_score").cast("double")))
        .withColumn("_s", statistical_strength(p, effect, F.col("statistic")))
        .withColumn("_n", sample_size(F.col("kpi_status"), F.col("period_count")))
        .withColumn("_a", method_agreement(F.col("corroborating_methods")))
    )
    composite = (
        F.col("_q.score") * QUALITY_WEIGHT + F.col("_s.score") * STATISTICAL_WEIGHT
        + F.col("_n.score") * SAMPLE_WEIGHT + F.col("_a.score") * AGREEMENT_WEIGHT
    )
    conflict = contradictory(F.col("corroborating_methods"))
    level = (
        F.when(conflict | (F.col("composite") < ABSTAIN_BELOW), "abstain")
        .when(F.col("composite") >= HIGH_FROM, "high")
        .when(F.col("composite") >= MEDIUM_FROM, "medium")
        .otherwise("low")
    )
    shown = F.concat(F.lit("composite evidence score "), fixed(F.col("composite"), 2))
    closing = (
        F.when(conflict, F.lit("methods disagree on direction — cannot conclude"))
        .when(F.col("composite") < ABSTAIN_BELOW, F.concat(shown, F.lit(f" below {ABSTAIN_BELOW}")))
        .otherwise(shown)
    )
    parts = ("_q", "_s", "_n", "_a")
    noted = F.array_compact(F.array(*[F.col(f"{x}.missing") for x in parts]))
    missing = (
        F.when(conflict, F.array(F.lit("resolution of the contradictory detector signals")))
        .when(
            (F.col("composite") < ABSTAIN_BELOW) & (F.size(noted) == 0),
            F.array(F.lit("sufficient evidence to support a conclusion")),
        )
        .otherwise(noted)
    )
    reasons = F.array(*[F.col(f"{x}.reason") for x in parts], closing)
    scored = rows.withColumn("composite", composite).withColumn(
        "confidence", F.struct(level.alias("level"), reasons.alias("reasons"), missing.alias("missing_evidence"))
    )
    return scored.drop(*parts)


def abstain(scored: DataFrame, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """Blank the payload of abstained findings, keep identity and evidence, and say why.

    The columns keep their types, so abstained and concluded findings stay in one table.
    """
    out = F.col("confidence.level") == "abstain"
    columns = [F.col(c) if c in identity else F.when(~out, F.col(c)).alias(c) for c in scored.columns]
    return scored.select(
        *columns, out.alias("abstained"), F.when(out, F.lit(ABSTAIN_MESSAGE)).alias("message")
    )


def apply_confidence(findings: DataFrame, quality: DataFrame | float | None = None, p_or_effect: bool = False) -> DataFrame:
    """Score findings against the weakest source's quality and abstain where evidence is weak or contradictory.

    ``quality`` is one score for all findings, or a table ``(dataset_id, score)`` when findings carry ``dataset_id``.
    """
    if isinstance(quality, DataFrame):
        scores = quality.select("dataset_id", F.col("score").alias("quality_score"))
        rows = findings.join(scores, "dataset_id", "left")
    else:
        rows = findings.withColumn("quality_score", F.lit(quality).cast("double"))
    return abstain(score_confidence(rows, p_or_effect))
