"""Radix selection against numpy, with few and many survivors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiloom.functions import selection
from kpiloom.functions.exact import doubles
from kpiloom.operators import quality


def frame(spark, columns):
    names = list(columns)
    rows = list(zip(*(columns[c] for c in names), strict=True))
    return spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in rows], ", ".join(f"`{c}` double" for c in names)).repartition(5)


def samples():
    rng = np.random.default_rng(3)
    n = 4000
    return {
        "wide": rng.lognormal(0, 6, n) * rng.choice([-1, 1], n), "close": 1e9 + rng.random(n), "a.b": rng.normal(50, 1, n).round(1),
        "hot": np.where(rng.random(n) < 0.5, 0.0, rng.normal(0, 1e-300, n)), "signed": rng.integers(-3, 4, n).astype(float), "same": np.full(n, -7.5),
    }


@pytest.mark.parametrize("limit", [1_000_000, 50, 3])
def test_quantiles_and_fences_equal_numpy(spark, limit):
    columns = samples()
    df = frame(spark, columns)
    chosen = selection.Selection(df, doubles(df, list(columns)), {"rows": F.lit(True), "odd": F.col("signed") % 2 != 0}, limit)
    fences = chosen.fences(1.5)
    for c, v in columns.items():
        q1, q3 = np.quantile(v, [0.25, 0.75])
        if q1 == q3:
            assert c not in fences
            continue
        low, high, outside = fences[c]
        assert (low, high) == pytest.approx((q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)), rel=1e-12)
        assert outside == ((v < low) | (v > high)).sum()
        assert chosen.below_zero(c) == (v < 0).sum()
    wanted = [0.0, 0.1, 0.5, 0.9, 1.0]
    found = chosen.quantiles(wanted)
    for c, v in columns.items():
        assert [found[c][p] for p in wanted] == pytest.approx(np.quantile(v, wanted), rel=1e-12, abs=1e-320), c
    assert chosen.counts == {"rows": 4000, "odd": int((columns["signed"] % 2 != 0).sum())}


def test_extremes_nulls_and_nothing(spark):
    values = [float("-inf"), -1.7e308, -5e-324, -0.0, 0.0, 5e-324, 1.7e308, float("inf"), float("nan"), None]
    df = frame(spark, {"x": values, "none": [None] * 10})
    found = selection.Selection(df, doubles(df, ["x", "none"]), direct_limit=1)
    assert found.buckets["x"].total == 8 and found.below_zero("x") == 3
    assert found.quantiles([0.0, 0.5, 1.0])["x"] == {0.0: float("-inf"), 0.5: 0.0, 1.0: float("inf")}
    assert found.quantiles([0.5])["none"] == {0.5: None} and found.fences(1.5).get("none") is None
    empty = selection.Selection(df.limit(0), doubles(df, ["x"]))
    assert empty.quantiles([0.5]) == {"x": {0.5: None}} and quality.quality_issues(df.limit(0)).count() == 0


def test_all_issues_take_few_actions(spark):
    columns = samples()
    df = frame(spark, columns)
    context = spark.sparkContext
    context.setJobGroup("issues", "quality issues")
    rows = quality.quality_issues(df).collect()
    jobs = context.statusTracker().getJobIdsForGroup("issues")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert {r.column for r in rows if r.issue_type == "outlier"} >= {"wide", "a.b"}
    assert len(jobs) <= 10  # three actions; adaptive execution runs each shuffle as a job of its own
