import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions import dates, exact, series, text


def sums(df, data_type, scale=6):
    return df.agg(exact.exact_sum(F.col("v"), data_type, scale).alias("s")).first()["s"]


def test_sum_does_not_depend_on_partitioning_and_is_exact(spark):
    rng = random.Random(3)
    values = [round(rng.uniform(-1e9, 1e9), 4) for _ in range(5000)] + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {sums(df.repartition(n), T.DoubleType(), 4) for n in (1, 3, 17)}
    whole = sum(round(v * 10_000) for v in values if v is not None and v == v)
    assert got == {whole / 10_000}


def test_sum_beyond_one_long_and_of_nothing(spark):
    df = spark.range(1000).select(F.lit(9_000_000_000_000.0).alias("v"))
    assert sums(df, T.DoubleType(), 6) == 9e15
    assert sums(df.limit(0), T.DoubleType()) is None
    longs = spark.range(5).select(F.lit(9_000_000_000_000_000_000).alias("v"))
    assert sums(longs, T.LongType()) == 4.5e19


@pytest.mark.parametrize("limit", [100_000, 10, 2])
def test_quantiles_equal_numpy(spark, limit):
    rng = np.random.default_rng(5)
    columns = {
        "spread": rng.lognormal(0, 3, 3000), "hot": np.where(rng.random(3000) < 0.4, 7.0, rng.normal(size=3000)),
        "few": rng.integers(0, 4, 3000).astype(float), "same": np.full(3000, 2.5),
    }
    rows = [tuple(float(v[i]) for v in columns.values()) for i in range(3000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(6)
    wanted = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact.exact_quantiles(df, list(columns), wanted, limit)
    for c, v in columns.items():
        for p in wanted:
            assert got[c][p] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12), (c, p)


def test_quantiles_of_few_and_no_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, None)], "a double, b double")
    assert exact.exact_quantiles(df, ["a", "b"], [0.25]) == {"a": {0.25: 1.25}, "b": {0.25: None}}


@pytest.mark.parametrize("name,good,bad", [
    ("Y-m-d", ["2024-01-05", "2024-1-5"], ["24-01-05", "2024-01-05x", "2024-13-01", "05-01-2024"]),
    ("d/m/Y", ["05/01/2024", "5/1/2024"], ["2024/01/05", "32/01/2024"]),
    ("Y-m-dTH:M:S", ["2024-01-05T00:00:00"], ["2024-01-05"]),
    ("Ymd", ["20240105"], ["2024105", "20241305"]),
    ("b d, Y", ["Jan 5, 2024", "Jan 05, 2024"], ["January 5, 2024", "Foo 5, 2024"]),
    ("d-b-Y", ["5-Jan-2024", "05-Jan-2024"], ["5-01-2024"]),
])
def test_date_texts(spark, name, good, bad):
    df = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", dates.parse_text(F.col("t"), name).alias("d"))
    for r in df.collect():
        assert r["d"] == (datetime(2024, 1, 5) if r["t"] in good else None), r


def test_periods_and_cadences(spark):
    day = F.lit("2024-02-01 13:30:00").cast("timestamp_ntz")
    row = spark.range(1).select(*[dates.period_of(day, g).cast("string").alias(g) for g in ("day", "week", "month")]).first()
    assert tuple(row) == ("2024-02-01", "2024-01-29", "2024-02-01")
    assert dates.Cadence.parse("real-time") < dates.Cadence.parse("Weekly")
    with pytest.raises(ValueError, match="unknown cadence"):
        dates.Cadence.parse("Nightly batch")


def test_numbers_percents_and_bullets(spark):
    row = spark.range(1).select(
        text.number(F.lit(-1234.5)), text.number(F.lit(None).cast("double")), text.signed_percent(F.lit(0.084)),
        text.bullets(F.lit("- one\n* two\n\n3. three\n4) four\n  \nplain")), text.bullets(F.lit(" - ")),
        text.relative_change(F.lit(0.0), F.lit(5.0)), text.relative_change(F.lit(-10.0), F.lit(5.0)),
    ).first()
    assert tuple(row) == ("-1,234.50", "n/a", "+8.4%", ["one", "two", "three", "four", "plain"], ["-"], None, 1.5)


def brute_force_segments(values):
    n = len(values)
    gaps = (values[:, None] - values[None, :]) ** 2
    median = np.median(gaps[np.triu_indices(n, 1)])
    kernel = np.exp(-np.clip(gaps * (1 / median if median else 1.0), 1e-2, 1e2))
    np.fill_diagonal(kernel, 1.0)
    best, before = {0: 0.0}, {}
    for end in [*range(5, n, 5), n]:
        options = [
            (best[s] + (end - s) - kernel[s:end, s:end].sum() / (end - s) + 3 * math.log(n), s) for s in best if end - s >= 2
        ]
        best[end], before[end] = min(options)
    points, at = [], n
    while at > 0:
        at = before[at]
        points += [at] if at else []
    return sorted(points)


def test_change_points_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(25):
        n = int(rng.integers(8, 130))
        values = rng.normal(size=n)
        values[n // 2 :] += rng.choice([0, 2, 6])
        values[n // 4 :] += rng.choice([0, 4])
        assert series.change_points(values) == brute_force_segments(values)


def test_median_gap_and_bootstrap_equal_plain_numpy():
    rng = np.random.default_rng(8)
    for n in (2, 3, 9, 60):
        values = np.round(rng.normal(size=n), 1)
        gaps = [(a - b) ** 2 for i, a in enumerate(values) for b in values[:i]]
        assert series.median_squared_gap(values) == pytest.approx(np.median(gaps), rel=1e-12)
    values = rng.normal(size=41)
    means = np.random.default_rng(42).choice(values, size=(1000, 41), replace=True).mean(axis=1)
    low, high = np.quantile(means, (1 - 0.95) / 2), np.quantile(means, 1 - (1 - 0.95) / 2)
    assert series.bootstrap_interval(values) == (low, high) == series.bootstrap_interval(values, chunk=100)
    assert series.bootstrap_interval(values[:2]) == (None, None)


def test_welch_against_tabulated_points():
    assert series.regularized_beta(2.5, 0.5, 5 / (5 + 2.570581835636314**2)) == pytest.approx(0.05, abs=1e-12)
    assert series.regularized_beta(5, 0.5, 10 / (10 + 2.2281388519862747**2)) == pytest.approx(0.05, abs=1e-12)
    assert series.welch_p_value(4, 2.0, 0.0, 4, 1.0, 0.0) is None
    assert series.welch_p_value(1, 2.0, 1.0, 4, 1.0, 1.0) is None


def test_sum_keeps_tiny_and_huge_values(spark):
    tiny = [3.2e-8, 1.25e-9, 7e-13] * 50
    df = spark.createDataFrame([(v,) for v in tiny], "v double")
    assert sums(df.repartition(5), T.DoubleType()) == pytest.approx(math.fsum(tiny), rel=1e-12)
    huge = spark.createDataFrame([(3e200,), (-1e15,), (2.5,)], "v double")
    assert sums(huge, T.DoubleType()) == 3e200
    assert sums(spark.createDataFrame([(float("inf"),), (1.0,)], "v double"), T.DoubleType()) == math.inf
    small = df.agg(exact.small_total(F.col("v")).alias("s")).first()["s"]
    assert small == pytest.approx(math.fsum(tiny), rel=1e-12)
    assert huge.agg(exact.small_total(F.col("v")).alias("s")).first()["s"] == 3e200
    assert huge.limit(0).agg(exact.small_total(F.col("v")).alias("s")).first()["s"] is None


@pytest.mark.parametrize("scale", [0, 1, 2, 9])
def test_sum_scales(spark, scale):
    values = [round(i * 0.37 - 40, scale) for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    assert sums(df, T.DoubleType(), scale) == pytest.approx(math.fsum(values), abs=1e-12)


def test_rounding_follows_the_exact_binary_value(spark):
    values = [2.675, 35.05, 0.00015, 3 / 60000, 2.5, -1234567.891, 0.125, -0.04, 1.005, -2.675, 0.00025, 1e300]
    values += [i / 2000 for i in range(-300, 300, 7)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 4):
        got = [tuple(r) for r in df.select(exact.half_even(F.col("v"), digits), text.fixed(F.col("v"), digits)).collect()]
        assert [g[0] for g in got] == [round(v, digits) for v in values]
        if digits:  # texts of huge numbers show their 17 significant digits and then zeros
            shown = [(g[1], f"{v:.{digits}f}") for g, v in zip(got, values) if abs(v) < 1e15]
            assert [a for a, _ in shown] == [b for _, b in shown]
    assert spark.range(1).select(text.signed_percent(F.lit(-0.083))).first()[0] == "-8.3%"


def test_exact_sum_of_large_longs_passes_the_range_of_a_long(spark):
    rows = spark.range(3_000_000).select(F.lit(4 * 10**18).alias("v"))
    assert rows.agg(exact.exact_sum(F.col("v"), T.LongType()).alias("s")).first().s == 1.2e25
    mixed = spark.createDataFrame([(2**62,), (-(2**62),), (-5,), (7,)], "v bigint")
    assert mixed.agg(exact.exact_sum(F.col("v"), T.LongType()).alias("s")).first().s == 2.0
