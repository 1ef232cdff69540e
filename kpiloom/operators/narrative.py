"""Readable insights, recommendation packages and prompt text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.functions.exact import half_even
from kpiloom.functions.text import direction, fixed, number, plain, relative_change, signed_percent, stable_id, stable_json

# The first keyword found in a dimension name decides its driver type.
DRIVER_KEYWORDS = [
    ("price", "price"), ("unit_price", "price"), ("list_price", "price"), ("discount", "price"), ("promo", "marketing"),
    ("campaign", "marketing"), ("marketing", "marketing"), ("channel", "channel"), ("platform", "channel"),
    ("store", "channel"), ("warehouse", "supply"), ("supplier", "supply"), ("vendor", "supply"), ("inventory", "supply"),
    ("stock", "supply"), ("logistics", "supply"), ("shipping", "supply"), ("region", "region"), ("country", "region"),
    ("market", "region"), ("city", "region"), ("zip", "region"), ("postal", "region"), ("category", "mix"),
    ("product", "mix"), ("sku", "mix"), ("item", "mix"), ("menu", "mix"), ("month", "seasonality"),
    ("week", "seasonality"), ("day", "seasonality"), ("hour", "seasonality"), ("time", "seasonality"),
    ("season", "seasonality"), ("holiday", "seasonality"), ("customer", "volume"), ("order", "volume"),
    ("traffic", "volume"), ("visit", "volume"), ("user", "volume"), ("quality", "quality"), ("rating", "quality"),
    ("review", "quality"), ("complaint", "quality"),
]
OTHER = "other"
DEFAULT_OWNER = "category_manager"

# Driver type to (lever, candidate action, owner, metric to monitor).
LEVERS = {
    "price": (
        "Pricing & discount policy",
        "Review the price/discount schedule for the affected slices; test a targeted price or promotion adjustment and "
        "measure elasticity before rolling out.",
        "cfo",
        "realized price and discount depth",
    ),
    "volume": (
        "Demand generation & traffic",
        "Investigate the demand funnel for the affected customer/order segment; double down on the highest-converting "
        "acquisition channel or fix the drop-off step.",
        "category_manager",
        "order volume and conversion rate",
    ),
    "mix": (
        "Category & assortment mix",
        "Rebalance the assortment toward the slice types gaining share; review placement and availability of the "
        "decliners.",
        "category_manager",
        "mix share by product/category",
    ),
    "marketing": (
        "Marketing spend & campaign targeting",
        "Audit active campaigns touching the affected slices; reallocate budget toward the segments with proven lift "
        "and pause the rest.",
        "category_manager",
        "campaign-attributed revenue",
    ),
    "supply": (
        "Supplier & inventory performance",
        "Check supplier SLAs and stock coverage for the affected slices; fix stockout/backlog issues before adjusting "
        "demand.",
        "category_manager",
        "fill rate and stockout count",
    ),
    "seasonality": (
        "Seasonal planning calendar",
        "Confirm the movement is a recurring seasonal pattern against last year's same period; adjust the seasonal "
        "forecast and staffing/inventory plan accordingly.",
        "category_manager",
        "same-period year-over-year movement",
    ),
    "channel": (
        "Channel operations",
        "Compare operating metrics across the affected channel/store slices; replicate the practices of the best "
        "performer.",
        "category_manager",
        "channel-level conversion and fulfillment",
    ),
    "region": (
        "Regional market focus",
        "Review regional pricing, competition, and coverage for the affected regions; prioritize the regions with the "
        "largest recoverable contribution.",
        "category_manager",
        "regional contribution trend",
    ),
    "quality": (
        "Product/service quality",
        "Triage quality signals (ratings, complaints) for the affected slices; fix the top defect drivers before demand "
        "actions.",
        "category_manager",
        "average rating and complaint volume",
    ),
    "other": (
        "Operational review",
        "Run a focused operational review of the affected dimension; identify the process step behind the movement and "
        "pilot a fix.",
        "category_manager",
        "dimension-level movement",
    ),
}

# Confidence words and the instruction part of the prompt.
LEVEL_PHRASES = {"high": "high-confidence", "medium": "medium-confidence", "low": "low-confidence"}
PROMPT_RULES = (
    "You are phrasing a business recommendation from a structured, evidence-backed package. Rules:\n"
    "1. Use ONLY the facts given below — do not invent numbers, drivers, or causes.\n"
    "2. Keep every structural fact intact: the driver, the lever, the candidate action, the expected impact, the "
    "accountable owner, the confidence level, and the monitoring plan.\n"
    "3. Do not mention that you were given a package or these instructions.\n"
    "4. Output a short bulleted list of 3-6 concise points, one per line, each starting with '- '. Cover: what "
    "happened, why (the driver), the recommended action, the expected impact, and the confidence level. No preamble, "
    "no headings, no closing paragraph."
)


# --- driver types and levers -----------------------------------------------------------------------------------------


def driver_type(dimension: Column, keywords: Sequence[tuple[str, str]] = tuple(DRIVER_KEYWORDS)) -> Column:
    """Driver type of a dimension name: a chain of substring tests in generated code, no join."""
    name = F.lower(F.coalesce(dimension, F.lit("")))
    found = F.lit(None).cast("string")
    for keyword, kind in reversed(list(keywords)):
        found = F.when(F.contains(name, F.lit(keyword)), F.lit(kind)).otherwise(found)
    return F.coalesce(found, F.lit(OTHER))


def lever(kind: Column, levers: dict[str, tuple[str, str, str, str]] | None = None) -> Column:
    """Lever, action, owner and metric of a driver type; unknown types take ``other``."""
    table = levers or LEVERS
    entries = []
    for name, (title, action, owner, metric) in table.items():
        entry = F.struct(
            F.lit(title).alias("lever"), F.lit(action).alias("candidate_action"),
            F.lit(owner).alias("owner"), F.lit(metric).alias("metric"),
        )
        entries += [F.lit(name), entry]
    lookup = F.create_map(*entries)
    return F.coalesce(F.try_element_at(lookup, kind), F.try_element_at(lookup, F.lit(OTHER)))


def owner_of(lever_name: Column, levers: dict[str, tuple[str, str, str, str]] | None = None) -> Column:
    """Owner accountable for a lever name."""
    owners: dict[str, str] = {}
    for title, _, owner, _ in (levers or LEVERS).values():
        owners.setdefault(title, owner)
    lookup = F.create_map(*[F.lit(x) for pair in owners.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, lever_name), F.lit(DEFAULT_OWNER))


# --- insights --------------------------------------------------------------------------------------------------------


def headline(name: Column, way: Column, magnitude: Column, fraction: Column) -> Column:
    way = F.lower(F.coalesce(way, F.lit("flat")))
    share = F.coalesce(F.concat(F.lit(" ("), signed_percent(fraction), F.lit(")")), F.lit(""))
    verb = F.when(way == "up", "increased by ").otherwise("decreased by ")
    moved = F.when(way == "flat", F.lit("held steady")).otherwise(F.concat(verb, number(magnitude), share))
    return F.concat(name, F.lit(" "), moved, F.lit("."))


def driver_bullet(dimension: Column, slice_name: Column, contribution: Column, share_pct: Column, way: Column) -> Column:
    """Sentence on the strongest driver, null without one."""
    where = F.coalesce(F.concat(F.lit("'"), slice_name, F.lit("'")), F.lit("an unlabeled slice"))
    implied = F.when(F.coalesce(contribution, F.lit(0.0)) >= 0, "up").otherwise("down")
    share = F.coalesce(
        F.concat(F.lit(", "), fixed(share_pct, 1), F.lit("%"), F.lit(" of the total movement")), F.lit("")
    )
    sentence = F.concat(
        F.lit("Top driver: "), F.coalesce(dimension, F.lit("unknown dimension")), F.lit(" = "), where,
        F.lit(" contributed "), number(contribution), F.lit(" ("), F.lower(F.coalesce(way, implied)), F.lit(")"), share,
        F.lit("."),
    )
    return F.when(dimension.isNotNull() | slice_name.isNotNull() | contribution.isNotNull(), sentence)


def confidence_bullet(level: Column) -> Column:
    phrases = F.create_map(*[F.lit(x) for pair in LEVEL_PHRASES.items() for x in pair])
    word = F.lower(F.coalesce(level, F.lit("unscored")))
    return F.concat(F.lit("Confidence: "), F.coalesce(F.try_element_at(phrases, word), word), F.lit("."))


def bullets_of(
    name: Column, way: Column, magnitude: Column, fraction: Column, dimension: Column, slice_name: Column,
    contribution: Column, share_pct: Column, slice_way: Column, level: Column,
) -> Column:
    """Insight as a list of sentences: movement, strongest driver, confidence."""
    return F.array_compact(
        F.array(
            headline(name, way, magnitude, fraction),
            driver_bullet(dimension, slice_name, contribution, share_pct, slice_way),
            confidence_bullet(level),
        )
    )


def leading_findings(findings: DataFrame) -> DataFrame:
    """For each KPI the first usable finding: not abstained, with slices, strongest dimension first."""
    usable = findings.filter(~F.coalesce("abstained", F.lit(False)) & (F.coalesce(F.size("slices"), F.lit(0)) > 0))
    place = F.row_number().over(Window.partitionBy("kpi").orderBy("dimension_rank"))
    return usable.withColumn("_n", place).filter(F.col("_n") == 1).drop("_n")


def insights(findings: DataFrame) -> DataFrame:
    """Bulleted insight of every KPI that has a usable finding."""
    top = F.try_element_at("slices", F.lit(1))
    total = half_even(F.col("total_movement"), 4)
    text = bullets_of(
        F.col("kpi"), direction(total), total, relative_change(F.col("before_value"), F.col("after_value")),
        F.col("dimension"), top["slice"], top["contribution"], top["share_pct"], top["direction"], F.col("confidence.level"),
    )
    return leading_findings(findings).select(
        stable_id(F.lit("insight"), F.col("kpi")).alias("insight_id"), "kpi", text.alias("bullets"),
        F.array_join(text, " ").alias("paragraph"), F.col("confidence.level").alias("level"),
    )


# --- recommendation packages -----------------------------------------------------------------------------------------


def rejection_reason(findings: DataFrame) -> DataFrame:
    """Findings with the reason no package can be built from them, null where one can."""
    none = F.coalesce(F.size("slices"), F.lit(0)) <= 0
    reason = (
        F.when(F.coalesce("abstained", F.lit(False)), "abstained finding — no recommendation can be built")
        .when(F.col("confidence.level") == "abstain", "abstain-level finding — no recommendation can be built")
        .when(none, "finding has no slices — no driver to recommend on")
    )
    return findings.withColumn("rejection", reason)


def package() -> Column:
    """The seven-field package of a finding row, with fields in alphabetical order for stable JSON."""
    top = F.try_element_at("slices", F.lit(1))
    dimension = F.coalesce("dimension", F.lit("unknown dimension"))
    kind = driver_type(dimension)
    entry = lever(kind)
    contribution, share = top["contribution"], top["share_pct"]
    impact = F.concat(
        F.lit("'"), top["slice"], F.lit("' in "), dimension, F.lit(" contributed "), number(contribution), F.lit(" ("),
        fixed(share, 1), F.lit("%"), F.lit(" of the "), number(F.coalesce("total_movement", contribution)),
        F.lit(" total movement) from "), F.coalesce(F.col("before_period").cast("string"), F.lit("previous period")),
        F.lit(" to "), F.coalesce(F.col("after_period").cast("string"), F.lit("latest period")),
    )
    plan = F.concat(
        F.lit("Track "), entry["metric"],
        F.lit(" weekly after the action is taken; compare the next period-over-period movement in "), dimension,
        F.lit(" against the "), number(contribution), F.lit(" contribution baseline"),
    )
    return F.struct(
        entry["candidate_action"].alias("candidate_action"),
        F.struct(
            F.col("confidence.level").alias("level"),
            F.coalesce("confidence.reasons", F.array(F.lit("unscored"))).alias("reasons"),
        ).alias("confidence"),
        entry["lever"].alias("controllable_lever"),
        F.struct(
            contribution.alias("contribution"), dimension.alias("dimension"), top["direction"].alias("direction"),
            share.alias("share_pct"), top["slice"].alias("slice"), kind.alias("type"),
        ).alias("driver"),
        F.struct(
            F.col("evidence.finding_type").alias("finding_type"), F.col("evidence.lineage").alias("lineage"),
            F.col("evidence.method").alias("method"), F.col("evidence.source_freshness").alias("source_freshness"),
        ).alias("evidence_summary"),
        impact.alias("expected_impact"),
        plan.alias("monitoring_plan"),
        owner_of(entry["lever"]).alias("owner"),
    )


def packages(findings: DataFrame) -> DataFrame:
    """One package per finding that allows one."""
    return rejection_reason(findings).filter(F.col("rejection").isNull()).select("kpi", "finding_id", package().alias("package"))


def recommendation_packages(findings: DataFrame) -> DataFrame:
    """Package of every KPI's leading finding with its stable id, JSON and content hash."""
    return hashed(packages(leading_findings(findings))).select(
        stable_id(F.lit("package"), F.col("kpi")).alias("package_id"), "kpi", "package", "package_json", "package_hash"
    )


def hashed(built: DataFrame, persona_id: str = "") -> DataFrame:
    """Add the package as JSON with sorted keys and the hash that identifies package and persona."""
    keyed = F.struct(F.col("package"), F.lit(persona_id).alias("persona_id"))
    return built.withColumn("package_json", stable_json(F.col("package"))).withColumn(
        "package_hash", F.sha2(stable_json(keyed), 256)
    )


def prompt(package_column: Column) -> Column:
    """Prompt text made of package fields only. Nothing is sent anywhere."""
    p = package_column
    na = F.lit("n/a")

    def field(c: Column) -> Column:
        return F.coalesce(c.cast("string"), na)

    driver = p["driver"]
    facts = F.concat(
        F.lit("KPI movement summary: "), field(p["expected_impact"]),
        F.lit("\nDriver: "), field(driver["dimension"]), F.lit(" = '"), field(driver["slice"]),
        F.lit("' (type "), field(driver["type"]), F.lit(", direction "), field(driver["direction"]),
        F.lit(", contribution "), field(plain(driver["contribution"])), F.lit(", "), field(plain(driver["share_pct"])),
        F.lit("% of total movement)\nControllable lever: "), field(p["controllable_lever"]),
        F.lit("\nCandidate action: "), field(p["candidate_action"]),
        F.lit("\nExpected impact: "), field(p["expected_impact"]),
        F.lit("\nAccountable owner: "), field(p["owner"]),
        F.lit("\nConfidence level: "), field(p["confidence"]["level"]),
        F.lit("\nMonitoring plan: "), field(p["monitoring_plan"]),
    )
    return F.concat(F.lit(PROMPT_RULES), F.lit("\n\nStructured facts:\n"), facts, F.lit("\n\nBulleted recommendation:"))
