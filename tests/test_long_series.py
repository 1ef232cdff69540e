"""Range-cut series equal the whole-series windows."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiloom.functions import ranges
from kpiloom.operators import anomaly, grain, long_series


@pytest.fixture(scope="module")
def trend(spark):
    rng = np.random.default_rng(11)
    rows = []
    for kpi, part, n in (("long", "a", 503), ("long", None, 60), ("flat", "a", 40), ("short", "a", 3)):
        values = rng.normal(100, 5, n) if kpi != "flat" else np.full(n, 2.0)
        values[n // 2] += 80 if kpi == "long" else 0
        rows += [(kpi, part, i, datetime(2024, 1, 1) + timedelta(seconds=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "kpi string, part string, idx bigint, period timestamp, value double").repartition(7)


def ordered(df):
    return [tuple(r) for r in df.select(*sorted(df.columns)).orderBy("kpi", "part", "idx").collect()]


@pytest.mark.parametrize("range_rows", [8, 50, 100_000])
def test_ranges_equal_whole_series(trend, range_rows):
    by = ["part"]
    assert ordered(long_series.control_limits(trend, by, range_rows)) == ordered(anomaly.control_limits(trend, by))
    assert ordered(long_series.local_direction(trend, by, range_rows)) == ordered(anomaly.local_direction(trend, by))
    whole = ordered(anomaly.marks(trend, by, change_points=False))
    assert ordered(long_series.marks(trend, by, range_rows)) == whole and any(r[0] or r[2] for r in whole)


def test_scores_and_numbers_equal_whole_series(trend):
    assert ordered(long_series.robust_scores(trend, ["part"])) == ordered(anomaly.robust_scores(trend, ["part"]))
    again = long_series.trend_points(trend.drop("idx"), ["part"], ranges=5)
    assert ordered(again) == ordered(trend)
    assert long_series.marks(trend.limit(0)).count() == 0


def test_ranges_must_be_longer_than_halos(trend):
    with pytest.raises(ValueError, match="longer"):
        ranges.with_halo(trend, 7, 3, range_rows=7)


def test_upsampling_without_dimensions_has_no_global_window(spark):
    days = spark.range(60).select(F.expr("date_add(DATE '2024-01-01', cast(id * 7 as int))").alias("day"), (F.col("id") * 1.5).alias("v")).repartition(5)
    out = grain.upsample(days, "day", "weekly")
    plan = out._jdf.queryExecution().executedPlan().toString()
    rows = out.orderBy("day").collect()
    assert len(rows) == 420 and [r.v for r in rows] == [1.5 * (i // 7) for i in range(420)]
    assert "Window [lag(day" not in plan or "hashpartitioning(_range" in plan
