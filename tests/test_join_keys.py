import random
from datetime import date, timedelta

import pytest
from conftest import records

from kpiloom.operators import grain, join_keys


def found(frames):
    return [(p.left, p.left_column, p.right, p.right_column, p.unique) for p in join_keys.infer_join_keys(frames)]


def shops(spark, n=40):
    visits = spark.createDataFrame([(i, 100 + i % n, i % 5) for i in range(400)], "visit long, shop int, clerk int")
    shop = spark.createDataFrame([(100 + i, f"town {i % 7}") for i in range(n)], "code long, town string")
    towns = spark.createDataFrame([(f"town {i}", i * 10) for i in range(7)], "name string, people long")
    return visits, shop, towns


def test_chain_of_unique_keys(spark):
    visits, shop, towns = shops(spark)
    assert found([visits, shop, towns]) == [(0, "shop", 1, "code", True), (1, "town", 2, "name", True)]
    joined = grain.reconcile([grain.Source(f) for f in (visits, shop, towns)])
    rows = records(joined)
    assert len(rows) == 400 and all(r["people"] == (r["shop"] - 100) % 7 * 10 for r in rows)


def test_whole_numbers_join_texts_that_write_them(spark):
    left = spark.createDataFrame([(str(500 + i % 30), i) for i in range(90)], "ref string, amount long")
    right = spark.createDataFrame([(500 + i, i * 2.0) for i in range(30)], "id long, price double")
    assert found([left, right]) == [(0, "ref", 1, "id", True)]
    rows = records(grain.reconcile([grain.Source(left), grain.Source(right)]))
    assert len(rows) == 90 and all(r["price"] == (int(r["ref"]) - 500) * 2.0 for r in rows)


def test_small_numbers_that_overlap_by_chance_are_no_key(spark):
    left = spark.createDataFrame([(i % 4, f"a{i}") for i in range(50)], "rank int, who string")
    right = spark.createDataFrame([(i % 4, f"b{i}") for i in range(50)], "stars int, what string")
    assert found([left, right]) == []
    with pytest.raises(ValueError):
        grain.reconcile([grain.Source(left), grain.Source(right)])


def test_dates_of_different_formats_and_cadence(spark):
    start = date(2023, 1, 2)
    daily = [((start + timedelta(days=i)).strftime("%d/%m/%Y"), s, 1.0 + i) for i in range(28) for s in ("east", "west")]
    weekly = [(start + timedelta(weeks=i), s, 10 * i) for i in range(4) for s in ("east", "west")]
    day = spark.createDataFrame(daily, "bought string, side string, spent double")
    week = spark.createDataFrame(weekly, "since date, half string, staff long")
    assert sorted(found([day, week])) == [(0, "bought", 1, "since", False), (0, "side", 1, "half", False)]
    rows = records(grain.reconcile([grain.Source(day, "Daily"), grain.Source(week, "Weekly")]))
    assert len(rows) == 56
    assert all(r["staff"] == 10 * ((r["bought"].date() - start).days // 7) for r in rows)


def test_weeks_join_days_that_never_name_their_first_day(spark):
    monday = date(2023, 1, 2)
    day = spark.createDataFrame([((monday + timedelta(days=i)).strftime("%d.%m.%Y"), i) for i in range(35) if i % 7], "d string, n long")
    week = spark.createDataFrame([(monday + timedelta(weeks=i), i) for i in range(5)], "w date, week long")
    assert found([day, week]) == []
    rows = records(grain.reconcile([grain.Source(day, "Daily"), grain.Source(week, "Weekly")]))
    assert len(rows) == 30 and all(r["week"] == r["n"] // 7 for r in rows)


def test_given_keys_find_their_date_format(spark):
    a = spark.createDataFrame([("2024/03/01", 1), ("2024/03/02", 2)], "d string, x long")
    b = spark.createDataFrame([("01.03.2024", 5), ("02.03.2024", 6)], "e string, y long")
    rows = records(grain.reconcile([grain.Source(a), grain.Source(b, time_column="e")], {"day": {0: "d", 1: "e"}}))
    assert sorted((r["day"].date().isoformat(), r["x"], r["y"]) for r in rows) == [("2024-03-01", 1, 5), ("2024-03-02", 2, 6)]
    with pytest.raises(ValueError, match="no date format"):
        grain.reconcile([grain.Source(a, time_column="d"), grain.Source(b.withColumn("e", b.y.cast("string")), time_column="e")], {"day": {0: "d", 1: "e"}})


def test_nulls_empty_sources_and_hot_values(spark):
    visits, shop, _ = shops(spark)
    hot = visits.unionByName(spark.createDataFrame([(1000 + i, 100 if i % 2 else None, 1) for i in range(3000)], visits.schema))
    assert found([hot, shop]) == [(0, "shop", 1, "code", True)]
    assert found([visits, shop.limit(0)]) == [] and found([visits.limit(0), shop]) == [] and found([visits]) == []
    assert found([visits, spark.createDataFrame([(None, 1.5)], "code long, v double")]) == []


def test_names_that_clash_or_hold_dots_and_backticks(spark):
    left = spark.createDataFrame([(200 + i % 20, "l", 7) for i in range(60)], "`a.b` long, note string, k long")
    right = spark.createDataFrame([(200 + i, "r", i) for i in range(20)], "k long, `note` string, `v``w` long")
    pairs = join_keys.infer_join_keys([left, right])
    assert [(p.left_column, p.right_column) for p in pairs] == [("a.b", "k")]
    clash = spark.createDataFrame([(300 + i % 20, 300 + i % 3) for i in range(60)], "k long, other long")
    more = spark.createDataFrame([(300 + i, -i) for i in range(20)], "id long, k long")
    frames = [clash, more]
    mapping = join_keys.as_mapping(join_keys.infer_join_keys(frames), frames)
    assert mapping == {"k_0": {0: "k", 1: "id"}}
    assert grain.reconcile([grain.Source(f) for f in frames]).count() == 60


@pytest.mark.parametrize("small", [300, 9000])
def test_sketches_beyond_their_size_agree_with_sets(spark, small):
    draw = random.Random(5)
    codes = draw.sample(range(10**9), 60_000)
    inside = codes[:small]
    mostly = codes[: int(small * 0.75)] + draw.sample(range(10**9, 2 * 10**9), small - int(small * 0.75))
    left = spark.createDataFrame(list(zip(inside, mostly, strict=True)), "inside long, mostly long").repartition(4)
    right = spark.createDataFrame([(c,) for c in codes], "code long").repartition(4)
    (pair,) = join_keys.infer_join_keys([left, right])
    assert (pair.left_column, pair.shared, pair.left_distinct, pair.right_distinct) == ("inside", small, small, 60_000)


def test_whole_number_totals_beyond_64_bits_are_null(spark):
    df = spark.createDataFrame([(date(2024, 1, 1 + i), 4 * 10**18, 2, None) for i in range(4)], "d date, big long, small long, none long")
    row = records(grain.downsample(df, "d", "Monthly"))[0]
    assert (row["big"], row["small"], row["none"]) == (None, 8, 0)
