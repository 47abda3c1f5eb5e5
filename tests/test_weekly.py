from datetime import date

import pytest
from helpers import as_dict, monday, weekly

from marketweek.operators import profile, wide
from marketweek.operators import weekly as w


def test_weekly_agg_price_guard(spark):
    rows = [
        ("a", date(2024, 1, 1), 2.0, 10.0),
        ("a", date(2024, 1, 7), 2.0, 14.0),
        ("b", date(2024, 1, 1), 0.0, 5.0),
        ("c", date(2024, 1, 1), -1.0, 5.0),
    ]
    tx = spark.createDataFrame(rows, "item string, date date, qty_in double, amount double")
    for decimals in (None, 2):
        assert as_dict(w.weekly_agg(tx, decimals), "item", "unit_price_week") == {
            "a": 6.0,
            "b": None,
            "c": None,
        }


def test_exact_sums_do_not_depend_on_order(spark):
    values = [0.1 * i for i in range(1, 400)]
    rows = [("a", date(2024, 1, 1), 1.0, round(v, 2)) for v in values]
    schema = "item string, date date, qty_in double, amount double"
    totals = {
        w.weekly_agg(spark.createDataFrame(r, schema).repartition(n), 2).first().amount_week
        for r, n in ((rows, 3), (rows[::-1], 7))
    }
    assert totals == {7980.0}


PANEL = "`품목명` string, `연도` string, `주차` string, `금액_합` string, `반입량_합` string"


def test_panel_base_cleans_and_averages(spark):
    rows = [
        ("a", "2024", "1", "10", "2"),
        ("a", "2024", "1", "14", "2"),
        ("a", "2024", "54", "14", "2"),
        ("a", "2024", "2", "x", "2"),
        ("a", "2024", "3", "5", "0"),
        ("a", "2024", "4", "5", "-1"),
        (None, "2024", "4", "5", "1"),
    ]
    base = w.panel_base(spark.createDataFrame(rows, PANEL))
    assert as_dict(base, "week", "target") == {date(2024, 1, 1): 6.0, date(2024, 1, 22): -5.0}


def test_panel_base_prefers_the_given_price(spark):
    rows = [("a", 2024, 1, " 12 "), ("a", 2024, 2, "n/a")]
    df = spark.createDataFrame(rows, "`품목명` string, `연도` int, `주차` int, `주간_평균단가` string")
    assert [r.target for r in w.panel_base(df).collect()] == [12.0]
    with pytest.raises(ValueError):
        w.panel_base(df.drop("주차"))


def test_fill_weeks_and_runs(spark):
    df = weekly(spark, [("a", 0, 1.0, 2.0), ("a", 3, 1.0, None), ("a", 4, 2.0, 8.0), ("b", 7, 1.0, 1.0)])
    filled = {
        (r.item, r.week): (r.unit_price_week, r.is_filled)
        for r in w.fill_weeks(df, ("unit_price_week",)).collect()
    }
    assert filled == {
        ("a", monday(0)): (2.0, False),
        ("a", monday(1)): (2.0, True),
        ("a", monday(2)): (2.0, True),
        ("a", monday(3)): (2.0, False),
        ("a", monday(4)): (4.0, False),
        ("b", monday(7)): (1.0, False),
    }
    runs = {r.item: (r.longest_run, r.runs) for r in w.week_runs(df).collect()}
    assert runs == {"a": (2, 2), "b": (1, 1)}


def test_aliases_add_up(spark):
    df = weekly(spark, [("onion", 0, 1.0, 4.0), ("onions", 0, 3.0, 4.0), ("leek", 0, 1.0, 1.0)])
    aliases = spark.createDataFrame([("onions", "onion")], "alias string, canonical string")
    assert as_dict(w.apply_aliases(df, aliases), "item", "unit_price_week") == {"onion": 2.0, "leek": 1.0}


def test_weather_keys_meet_sales_keys(spark):
    days = [(date(2024, 1, d), float(d), 1.0) for d in range(1, 9)]
    weather = w.weather_weekly(spark.createDataFrame(days, "date date, tmax double, precip double"))
    got = {r.week: (r.tmax, r.precip) for r in weather.collect()}
    assert got == {date(2024, 1, 1): (4.0, 7.0), date(2024, 1, 8): (8.0, 1.0)}
    sales = spark.createDataFrame([("a", date(2024, 1, 8)), ("a", date(2024, 1, 15))], "item string, week date")
    assert as_dict(w.join_weather(sales, weather), "week", "tmax") == {
        date(2024, 1, 8): 8.0,
        date(2024, 1, 15): None,
    }


def test_cluster_series(spark):
    rows = [(date(2024, 1, 6), 1.0, 0.0, 5.0), (date(2024, 1, 7), 2.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "date date, a double, b double, c double")
    clusters = spark.createDataFrame([("a", 0), ("b", 1)], "item string, cluster int")
    got = {(r.cluster, r.item, r.price) for r in wide.cluster_series(df, clusters).collect()}
    assert got == {(0, "a", 1.0), (1, "b", None)}
    assert {r.item for r in wide.wide_to_long(df, ["a", "zz"]).collect()} == {"a"}


def test_clean_series_and_first_items(spark):
    rows = [(2, "b", "2024", "1", "5"), (1, "a", "2024", "x", "5"), (3, "a", "2024", "2", "6"), (4, "c", "2024", "2", "6")]
    df = spark.createDataFrame(rows, "pos int, item string, y string, wk string, p string")
    args = ("item", "y", "wk", "p")
    assert [r.item for r in profile.first_items(df, 2, ["pos"]).collect()] == ["a", "b"]
    assert [tuple(r) for r in wide.clean_series(df, ["a"], *args).collect()] == [("a", 2024, 2, 6.0)]
    first = profile.first_items(df, 2, ["pos"])
    assert {r.item for r in wide.clean_series(df, first, *args).collect()} == {"a", "b"}


def test_coverage_grid_marks_missing_weeks(spark):
    df = weekly(spark, [("a", 0, 1.0, 1.0), ("a", 1, 1.0, 1.0), ("b", 1, 1.0, 5.0)])
    grid = {(r.item, r.week): r.traded for r in profile.coverage_grid(df, profile.top_items(df, 2)).collect()}
    assert grid == {("a", monday(0)): 1, ("a", monday(1)): 1, ("b", monday(0)): 0, ("b", monday(1)): 1}
    assert as_dict(profile.coverage(df), "item", "coverage") == {"a": 1.0, "b": 0.5}


def test_repeated_alias_counts_once(spark):
    sums = spark.createDataFrame([("x", date(2024, 1, 1), 2.0, 10.0)], "item string, week date, qty_in_week double, amount_week double")
    aliases = spark.createDataFrame([("x", "b"), ("x", "b"), ("x", "a")], "alias string, canonical string")
    got = w.apply_aliases(sums, aliases).collect()
    assert [(r.item, r.amount_week) for r in got] == [("a", 10.0)]
