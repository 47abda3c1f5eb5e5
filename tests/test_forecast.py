from datetime import timedelta

import numpy as np
import pytest
from helpers import monday, panel
from pyspark.sql import functions as F

from marketweek.operators import baselines as b
from marketweek.operators import forecast as fc
from marketweek.operators.folds import folds, future_weeks, series
from marketweek.params import ForecastParams

P = ForecastParams()
LENGTHS = {51: 0, 52: 0, 55: 0, 56: 1, 59: 1, 60: 2, 63: 2, 64: 3, 150: 3}


def test_fold_counts(spark):
    rng = np.random.default_rng(0)
    df = panel(spark, {f"n{n}": list(rng.uniform(1, 5, n)) for n in LENGTHS})
    got = {r.item: r.c for r in folds(series(df), P).where("fold > 0").groupBy("item").agg(F.count("*").alias("c")).collect()}
    assert got == {f"n{n}": k for n, k in LENGTHS.items() if k}
    live = folds(series(df), P).where("fold = 0")
    assert {r.item for r in live.collect()} == set(got)
    row = live.where("item = 'n64'").first()
    assert row.target_weeks == [monday(63 + h) for h in range(1, 5)] and row.actual is None


def apply(spark, values, make):
    df = spark.createDataFrame([([float(v) for v in values],)], "y array<double>")
    return df.select(make(F.col("y")).alias("f")).first().f


@pytest.mark.parametrize("n, expected", [(51, [51] * 4), (52, [1, 2, 3, 4]), (53, [2, 3, 4, 5])])
def test_seasonal_naive(spark, n, expected):
    assert apply(spark, range(1, n + 1), lambda y: b.seasonal_naive(y, 4, 52)) == expected


def test_seasonal_naive_repeats_past_one_season(spark):
    assert apply(spark, [1, 2, 3], lambda y: b.seasonal_naive(y, 5, 3)) == [1, 2, 3, 1, 2]


def test_rolling_mean_of_short_series(spark):
    assert apply(spark, [1, 2, 6], lambda y: b.rolling_mean(y, 4, 8)) == [3.0] * 4


def test_week_mean_uses_mean_of_means_for_unseen_weeks(spark):
    # Weeks 1, 2 of 2018 and week 1 of 2019; week 53 was never seen.
    rows = [(monday(0), 1.0), (monday(1), 10.0), (monday(52), 3.0)]
    df = spark.createDataFrame([([r[0] for r in rows], [r[1] for r in rows])], "weeks array<date>, y array<double>")
    df = df.withColumn("p", b.week_pairs(F.col("weeks"), F.col("y")))
    targets = F.array(F.lit("2019-12-30").cast("date"), F.lit("2020-12-28").cast("date"))
    assert df.select(b.week_mean(F.col("p"), targets).alias("f")).first().f == [2.0, 6.0]


def test_holt_follows_a_line(spark):
    values = [5 + 2 * t for t in range(1, 31)]
    df = spark.createDataFrame([([float(v) for v in values],)], "y array<double>")
    df = df.withColumn("s", b.holt_start(F.col("y"))).withColumn("fit", b.holt(F.col("y"), F.col("s")))
    got = df.select(b.line_ahead(F.col("fit"), 4).alias("f")).first().f
    assert np.allclose(got, [5 + 2 * t for t in range(31, 35)])


def board_of(spark, rows):
    schema = "item string, fold int, train_n int, target_weeks array<date>, actual array<double>, model string, yhat array<double>"
    return spark.createDataFrame(rows, schema)


def test_ties_go_to_the_model_name(spark):
    weeks = [monday(1), monday(2)]
    rows = []
    for model in ("WeekMean", "HW-Add", "SeasonalNaive"):
        rows.append(("a", 1, 60, weeks, [1.0, 2.0], model, [2.0, 3.0]))
        rows.append(("a", 0, 64, weeks, None, model, [-5.0, 3.0]))
    board = fc.scoreboard(board_of(spark, rows))
    assert [r.model for r in fc.leaderboard(board).orderBy("rank").collect()] == ["HW-Add", "SeasonalNaive", "WeekMean"]
    wide = fc.leaderboard_wide(board).first()
    assert wide.selected_model == wide.rank1_model == "HW-Add" and wide.rank3_mae == 1.0
    picked = fc.forecast_selected(board, P).orderBy("forecast_week_start").collect()
    assert [r.y_hat for r in picked] == [0.0, 3.0]  # clipped at zero when emitted


def test_metrics_formulas(spark):
    weeks = [monday(1), monday(2)]
    rows = board_of(spark, [("a", 1, 60, weeks, [0.0, 4.0], "m", [1.0, 2.0])])
    got = fc.fold_metrics(rows).first()
    assert got.rmse == pytest.approx(np.sqrt(2.5)) and got.mae == pytest.approx(1.5)
    assert got.mape == pytest.approx((1 / 1e-9 + 0.5) / 2 * 100)
    assert got.smape == pytest.approx((2 / (1 + 1e-9) + 4 / (6 + 1e-9)) / 2 * 100)


def test_priority_skips_models_that_are_not_finite(spark):
    weeks = [monday(1)]
    rows = [("a", 0, 60, weeks, None, m, [y]) for m, y in
            (("HW-Mul", float("nan")), ("HW-Add", float("inf")), ("SeasonalNaive", 7.0), ("RollMean(8w)", 8.0))]
    rows += [("b", 0, 60, weeks, None, m, [float("nan")]) for m in ("HW-Mul", "RollMean(8w)")]
    got = {r.item: r.model_used for r in fc.forecast_priority(board_of(spark, rows), P).collect()}
    assert got == {"a": "SeasonalNaive", "b": "RollMean(8w)"}


def test_unknown_model_means_seasonal_naive(spark):
    rows = [("a", 0, 60, [monday(1)], None, m, [y]) for m, y in (("SeasonalNaive", 7.0), ("WeekMean", 8.0))]
    choice = spark.createDataFrame([("a", "Other")], "item string, model string")
    assert fc.forecast_by_name(board_of(spark, rows), choice, P).first().y_hat == 7.0


@pytest.fixture(scope="module")
def all_models(spark):
    rng = np.random.default_rng(3)
    t = np.arange(130)
    season = 20 * np.sin(2 * np.pi * t / 52)
    made = {
        "long": list(100 + season + rng.normal(0, 1, 130)),
        "short": list(50 + 0.5 * t[:70] + rng.normal(0, 1, 70)),
        "zero": list(np.where(t == 5, 0.0, 60 + season)),
    }
    df = panel(spark, made).unionByName(panel(spark, {"stale": made["long"][:80]}, start=-40))
    return df, fc.model_rows(df, P).cache()


def test_guards_of_the_seasonal_models(spark, all_models):
    _, rows = all_models
    live = {(r.item, r.model): r.yhat for r in rows.where("fold = 0").collect()}
    assert live["short", "HW-Add"] == live["short", "HW-Mul"]  # trend only below two seasons
    assert live["zero", "HW-Add"] == live["zero", "HW-Mul"]  # no multiplicative season
    assert live["long", "HW-Add"] != live["long", "HW-Mul"]
    assert all(np.isfinite(v).all() for v in live.values())


def test_forecast_invariants(spark, all_models):
    df, rows = all_models
    got = fc.forecast_selected(fc.scoreboard(rows), P)
    selected = {r.item: r.selected_model for r in fc.leaderboard_wide(fc.scoreboard(rows)).collect()}
    last = {r.item: r.w for r in df.groupBy("item").agg(F.max("week").alias("w")).collect()}
    by_item = {}
    for r in got.collect():
        by_item.setdefault(r.item, []).append(r)
        assert r.model_used == selected[r.item] and r.y_hat >= 0
    for item, rs in by_item.items():
        weeks = sorted(r.forecast_week_start for r in rs)
        # Every item starts after its own last week, stale ones too.
        assert weeks == [last[item] + timedelta(days=7 * h) for h in range(1, 5)]
    wide = fc.leaderboard_wide(fc.scoreboard(rows)).collect()
    assert all(r.rank1_smape <= r.rank2_smape <= r.rank3_smape for r in wide)


def test_last_fold_details_are_unclipped_and_aligned(spark, all_models):
    df, rows = all_models
    got = fc.last_fold_details(rows).where("item = 'long' and model = 'SeasonalNaive'").orderBy("week").collect()
    values = {r.week: r.target for r in df.where("item = 'long'").collect()}
    assert [r.y_true for r in got] == [values[monday(i)] for i in range(126, 130)]
    assert [r.y_hat for r in got] == [values[monday(i)] for i in range(74, 78)]
    assert {r.fold_end_idx for r in got} == {126}


def test_calendar_naive_needs_the_exact_week(spark):
    df = panel(spark, {"a": list(range(60))}).where(F.col("week") != monday(3))
    got = {r.week: r.y_hat for r in b.calendar_naive(df).collect()}
    assert got == {monday(i): float(i - 52) for i in range(52, 60) if i != 55}


def test_future_weeks(spark):
    row = spark.range(1).select(future_weeks(F.lit("2024-12-30").cast("date"), 2).alias("f")).first()
    assert [str(d) for d in row.f] == ["2025-01-06", "2025-01-13"]


def test_item_without_a_choice_keeps_the_seasonal_naive(spark):
    rows = [(i, 0, 60, [monday(1)], None, m, [y]) for i in "ab" for m, y in (("SeasonalNaive", 7.0), ("WeekMean", 8.0))]
    choice = spark.createDataFrame([("a", "WeekMean")], "item string, model string")
    got = {r.item: r.y_hat for r in fc.forecast_by_name(board_of(spark, rows), choice, P).collect()}
    assert got == {"a": 8.0, "b": 7.0}


def test_item_board_equals_scoreboard(spark):
    rng = np.random.default_rng(11)
    df = panel(spark, {f"n{n}": [None if v < 1.2 and n == 80 else v for v in rng.uniform(1, 5, n)] for n in (56, 63, 80, 120)} | {"same": [2.0] * 90})
    params = ForecastParams(smoothing="grid")
    wide = fc.item_board(df, params)
    long = fc.scoreboard(fc.model_rows(df, params))
    assert wide.columns == long.columns
    key = lambda r: (r.item, r.rank)
    for a, b_ in zip(sorted(wide.collect(), key=key), sorted(long.collect(), key=key), strict=True):
        assert a == b_
    assert fc.item_board(df.limit(0), params).count() == 0


def test_item_board_ships_histories_once(spark):
    """One exchange of the panel by item, and one of the scored folds (a Python step hides the first)."""
    df = panel(spark, {"a": [float(k) for k in range(1, 121)]})
    plan = fc.leaderboard_wide(fc.item_board(df, ForecastParams(smoothing="grid")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(item") == plan.count("Exchange ") == 2
    assert plan.count("REPARTITION_BY_NUM") == 1 and "Window" not in plan and "Expand" not in plan
