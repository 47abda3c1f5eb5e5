"""Series as arrays, and rolling-origin folds as rows.

A series is one row: the item, its weeks and its targets in week order. The panel holds one
row per item and week, so an array grows with the calendar only (52 entries a year). Fold 0
is the whole history, fold k the history without the last ``k`` horizons; production
forecasts and backtests are then the same computation on different rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweek.params import ForecastParams


def series(panel: DataFrame) -> DataFrame:
    """``item, n, last_week, weeks, y, any_nonpositive`` from ``item, week, target``."""
    ordered = F.array_sort(F.collect_list(F.struct("week", "target")))
    rows = panel.groupBy("item").agg(
        ordered.alias("_s"),
        F.count("*").cast("int").alias("n"),
        F.max("week").alias("last_week"),
    )
    return rows.select(
        "item", "n", "last_week", F.col("_s.week").alias("weeks"), F.col("_s.target").alias("y")
    )


def min_train(n: Column, params: ForecastParams) -> Column:
    """Shortest history a model is trained on."""
    share = F.floor(n * F.lit(params.min_train_ratio)).cast("int")
    return F.greatest(F.lit(params.period), share)


def future_weeks(last_week: Column, horizon: int) -> Column:
    """The ``horizon`` Mondays after the last week of a series."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.date_add(last_week, h * 7)
    )


def long_enough(rows: DataFrame, params: ForecastParams) -> DataFrame:
    """Leave out items too short for one backtest fold."""
    return rows.where(F.col("n") >= min_train(F.col("n"), params) + params.horizon)


def folds(rows: DataFrame, params: ForecastParams = ForecastParams()) -> DataFrame:
    """One row per item and fold: training arrays, target weeks and actual values.

    ``actual`` is NULL in fold 0, whose weeks lie in the future.
    """
    n, horizon = F.col("n"), params.horizon
    shortest = min_train(n, params)
    valid = F.filter(
        F.sequence(F.lit(0), F.lit(params.folds)),
        lambda k: (k == 0) | (n - k * horizon >= shortest),
    )
    train_n = n - F.col("fold") * horizon
    backtest = F.col("fold") > 0
    return (
        long_enough(rows, params)
        .withColumn("fold", F.explode(valid))
        .select(
            "item",
            "fold",
            train_n.alias("train_n"),
            F.slice("weeks", F.lit(1), train_n).alias("weeks"),
            F.slice("y", F.lit(1), train_n).alias("y"),
            F.when(backtest, F.slice("weeks", train_n + 1, F.lit(horizon)))
            .otherwise(future_weeks(F.col("last_week"), horizon))
            .alias("target_weeks"),
            F.when(backtest, F.slice("y", train_n + 1, F.lit(horizon))).alias("actual"),
        )
    )
