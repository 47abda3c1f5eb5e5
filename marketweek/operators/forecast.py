"""Run all per-item models over folds, score them, select one, and emit forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweek.functions.estimation import estimated
from marketweek.functions.metrics import window_metrics
from marketweek.functions.scalar import all_finite, array_mean, clip_low
from marketweek.functions.smoothing import holt_winters
from marketweek.operators.baselines import (
    holt,
    holt_start,
    line_ahead,
    rolling_mean,
    seasonal_naive,
    week_mean,
    week_pairs,
)
from marketweek.operators.folds import folds, series
from marketweek.params import ForecastParams
from marketweek.session import spread

# Model names and the order of the rule-based choice.
SEASONAL_NAIVE = "SeasonalNaive"
WEEK_MEAN = "WeekMean"
ROLL_MEAN = "RollMean({window}w)"
HW_ADD = "HW-Add"
HW_MUL = "HW-Mul"
PRIORITY = (HW_MUL, HW_ADD, SEASONAL_NAIVE, ROLL_MEAN, WEEK_MEAN)
CLOSED_FORM = (SEASONAL_NAIVE, WEEK_MEAN, ROLL_MEAN)
ALL_MODELS = (SEASONAL_NAIVE, WEEK_MEAN, ROLL_MEAN, HW_ADD, HW_MUL)
RANKED_COLUMNS = 3
# end of fixed values

FOLD_KEYS = ("item", "fold", "train_n", "target_weeks", "actual")
METRICS = ("rmse", "mae", "mape", "smape")


def model_name(template: str, params: ForecastParams) -> str:
    return template.format(window=params.window)


def with_model_columns(
    fold_rows: DataFrame,
    params: ForecastParams = ForecastParams(),
    models: tuple[str, ...] = ALL_MODELS,
    spread_rows: bool = True,
) -> DataFrame:
    """Replace the training arrays by one forecast array per model, named after it.

    ``spread_rows=False`` leaves the rows where they are, for callers that spread the items.

    Seasonal smoothing needs two seasons; shorter histories use the trend-only form, and a
    failed fit falls back to the last season, or to the rolling mean below one season.
    Intermediate results that several models use are columns of their own, so that they are
    evaluated once per series.
    """
    y, n, h = F.col("y"), F.col("train_n"), params.horizon
    seasonal = HW_ADD in models or HW_MUL in models
    rows = fold_rows
    if seasonal:
        # Few rows, much arithmetic per row: give every task its share.
        rows = spread(rows, "item", "fold") if spread_rows else rows
        two_seasons = n >= 2 * params.period
        if params.smoothing == "estimated":
            rows = rows.withColumn("_hw", estimated(y, h, params.period))
        elif params.smoothing == "grid":
            rows = rows.withColumns(
                {
                    "_hw": holt_winters(F.when(two_seasons, y), h, params.period),
                    "_start": F.when(~two_seasons, holt_start(y)),
                }
            ).withColumn("_fit", F.when(~two_seasons, holt(y, F.col("_start"))))
        else:
            raise ValueError(f"unknown smoothing: {params.smoothing}")
    shared = {
        "_pairs": week_pairs(F.col("weeks"), y),
        "_naive": seasonal_naive(y, h, params.period),
        "_rolled": rolling_mean(y, h, params.window),
    }
    rows = rows.withColumns(shared)
    fallback = F.when(n >= params.period, F.col("_naive")).otherwise(F.col("_rolled"))

    def smoothed(name: str) -> Column:
        if params.smoothing == "estimated":
            return F.coalesce(F.col(f"_hw.{name}.ahead"), fallback)
        trend_only = F.when(n < 2 * params.period, line_ahead(F.col("_fit"), h))
        return F.coalesce(trend_only, F.col(f"_hw.{name}"), fallback)

    columns = {
        SEASONAL_NAIVE: lambda: F.col("_naive"),
        WEEK_MEAN: lambda: week_mean(F.col("_pairs"), F.col("target_weeks")),
        ROLL_MEAN: lambda: F.col("_rolled"),
        HW_ADD: lambda: smoothed("hw_add"),
        HW_MUL: lambda: smoothed("hw_mul"),
    }
    return rows.select(
        *FOLD_KEYS, *[columns[m]().alias(model_name(m, params)) for m in models]
    )


def by_model(forecast_rows: DataFrame) -> DataFrame:
    """One row per item, fold and model, still with arrays over the horizon."""
    models = [c for c in forecast_rows.columns if c not in FOLD_KEYS]
    keys = [F.col(c) for c in FOLD_KEYS]
    return forecast_rows.unpivot(keys, [F.col(f"`{m}`") for m in models], "model", "yhat")


def model_rows(
    panel: DataFrame,
    params: ForecastParams = ForecastParams(),
    models: tuple[str, ...] = ALL_MODELS,
) -> DataFrame:
    """``item, week, target`` to one row per item, fold and model."""
    return by_model(with_model_columns(folds(series(panel), params), params, models))


def fold_metrics(rows: DataFrame) -> DataFrame:
    """Error measures of every backtest fold; predictions enter unclipped."""
    scored = rows.where("fold > 0")
    return scored.select(
        "item",
        "fold",
        F.col("train_n").alias("fold_end_idx"),
        "model",
        *[c.alias(m) for m, c in window_metrics(F.col("actual"), F.col("yhat")).items()],
    )


def scoreboard(rows: DataFrame) -> DataFrame:
    """One row per item and model: mean fold metrics, rank, and the fold-0 forecast.

    Backtest and production forecasts sit in the same rows, so ranking and forecasting are
    one aggregation by item and model and need no join.
    """
    metrics = window_metrics(F.col("actual"), F.col("yhat"))
    live = F.col("fold") == 0
    scored = F.struct((-F.col("fold")).alias("k"), *[c.alias(m) for m, c in metrics.items()])
    board = rows.groupBy("item", "model").agg(
        # At most one entry per fold. Averaging them oldest first, not in arrival order, keeps
        # models with equal errors exactly equal, so that their tie is decided by name.
        F.array_sort(F.collect_list(F.when(~live, scored))).alias("_folds"),
        F.max(F.when(live, F.struct("target_weeks", "yhat"))).alias("_live"),
    )
    board = board.select(
        "item",
        "model",
        *[array_mean(F.col(f"_folds.{m}")).alias(m) for m in METRICS],
        F.size("_folds").cast("long").alias("n_folds"),
        "_live",
    )
    best_first = Window.partitionBy("item").orderBy(
        F.asc_nulls_last("smape"), F.asc_nulls_last("mae"), "model"
    )
    return board.select(
        "item",
        "model",
        *METRICS,
        "n_folds",
        F.row_number().over(best_first).alias("rank"),
        F.col("_live.target_weeks").alias("target_weeks"),
        F.col("_live.yhat").alias("yhat"),
    )


def item_board(
    panel: DataFrame,
    params: ForecastParams = ForecastParams(),
    models: tuple[str, ...] = ALL_MODELS,
) -> DataFrame:
    """The :func:`scoreboard` of a panel, its histories shuffled once.

    Items are spread before their series are built; folds and forecasts are made where the
    series are. Forecasts and actual values of an item's folds, a few numbers each, then meet in
    one array; scores and ranks are expressions on it, so nothing is unpivoted, grouped by
    model or windowed.
    """
    rows = with_model_columns(folds(series(spread(panel, "item")), params), params, models, spread_rows=False)
    names = [c for c in rows.columns if c not in FOLD_KEYS]
    entry = F.struct((-F.col("fold")).alias("k"), "target_weeks", "actual", *[F.col(f"`{m}`").alias(f"m{i}") for i, m in enumerate(names)])
    # Oldest fold first; fold 0, the future, comes last.
    items = rows.groupBy("item").agg(F.array_sort(F.collect_list(entry)).alias("_f"))
    past, live = F.filter("_f", lambda r: r["k"] < 0), F.filter("_f", lambda r: r["k"] == 0)
    items = items.withColumns({"_past": past, "_live": live})

    def scored(i: int) -> Column:
        return F.transform(
            "_past", lambda r: F.struct(*[c.alias(m) for m, c in window_metrics(r["actual"], r[f"m{i}"]).items()])
        )

    items = items.withColumns({f"_s{i}": scored(i) for i in range(len(names))})
    items = items.withColumns(
        {f"_v{i}_{m}": array_mean(F.col(f"_s{i}.{m}")) for i in range(len(names)) for m in METRICS}
    )

    def ranked(i: int, name: str) -> Column:
        value = {m: F.col(f"_v{i}_{m}") for m in METRICS}
        return F.struct(
            value["smape"].isNull().alias("_a"), value["smape"].alias("_b"), value["mae"].isNull().alias("_c"),
            value["mae"].alias("_d"), F.lit(name).alias("model"), *[value[m].alias(m) for m in METRICS],
            F.get("_live", F.lit(0))[f"m{i}"].alias("yhat"),
        )

    order = F.array_sort(F.array(*[ranked(i, name) for i, name in enumerate(names)]))
    return items.select(
        "item", F.size("_past").cast("long").alias("n_folds"), F.get("_live", F.lit(0))["target_weeks"].alias("target_weeks"),
        F.posexplode_outer(order).alias("_p", "_m"),
    ).select(
        "item", "_m.model", *[f"_m.{m}" for m in METRICS], "n_folds", (F.col("_p") + 1).alias("rank"), "target_weeks", "_m.yhat",
    )


def leaderboard(board: DataFrame) -> DataFrame:
    """Ranked models per item, long form."""
    return board.select("item", "rank", "model", *METRICS, "n_folds")


def leaderboard_wide(board: DataFrame, ranks: int = RANKED_COLUMNS) -> DataFrame:
    """One row per item: the selected model and the best ``ranks`` with their metrics."""

    def at(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(column)))

    return board.groupBy("item").agg(
        at(1, "model").alias("selected_model"),
        *[
            at(r, c).alias(f"rank{r}_{c}")
            for r in range(1, ranks + 1)
            for c in ("model", "smape", "mae", "rmse", "mape")
        ],
    )


def emitted(rows: DataFrame, params: ForecastParams) -> DataFrame:
    """Array forecasts to one row per item and week, clipped.

    Horizon arrays are never empty. The outer form of the generator is used throughout:
    for the inner one Spark adds a filter on the array's size, which would evaluate the
    forecasts a second time.
    """
    steps = F.arrays_zip(F.col("target_weeks").alias("week"), F.col("yhat").alias("y"))
    return rows.select("item", "model", F.inline_outer(steps)).select(
        "item",
        F.col("week").alias("forecast_week_start"),
        F.col("model").alias("model_used"),
        clip_low(F.col("y"), params.clip_min).alias("y_hat"),
    )


def forecast_selected(board: DataFrame, params: ForecastParams = ForecastParams()) -> DataFrame:
    """Forecast of the best-ranked model per item."""
    return emitted(board.where("rank = 1"), params)


def forecast_by_name(
    rows: DataFrame, choice: DataFrame, params: ForecastParams = ForecastParams()
) -> DataFrame:
    """Forecast with a model named per item (``item, model``); an unknown name or an item
    without one means the seasonal naive."""
    live = rows.where("fold = 0").groupBy("item").agg(
        F.map_from_entries(F.collect_list(F.struct("model", F.struct("target_weeks", "yhat")))).alias("_m")
    )
    named = live.join(choice.select("item", F.col("model").alias("_name")), "item", "left")
    wanted = F.coalesce("_name", F.lit(SEASONAL_NAIVE))
    forecast = F.coalesce(F.col("_m")[wanted], F.col("_m")[SEASONAL_NAIVE])
    picked = named.select("item", wanted.alias("model"), forecast.alias("_p"))
    return emitted(picked.select("item", "model", "_p.target_weeks", "_p.yhat"), params)


def forecast_priority(
    rows: DataFrame,
    params: ForecastParams = ForecastParams(),
    priority: tuple[str, ...] = PRIORITY,
) -> DataFrame:
    """Forecast of the first model in the fixed order whose values are all finite; the
    rolling mean if none qualifies."""
    names = [model_name(m, params) for m in priority]
    order = F.array_position(F.array(*[F.lit(m) for m in names]), F.col("model"))
    usable = F.when(all_finite(F.col("yhat")), order)
    last_resort = F.when(F.col("model") == model_name(ROLL_MEAN, params), F.lit(len(names) + 1))
    choice = F.struct("model", "target_weeks", "yhat")
    picked = (
        rows.where("fold = 0")
        .groupBy("item")
        .agg(F.min_by(choice, F.coalesce(usable, last_resort)).alias("_c"))
        .select("item", "_c.*")
    )
    return emitted(picked, params)


def forecast_details(forecast_rows: DataFrame) -> DataFrame:
    """Unclipped forecasts, one row per item and week, one column per model."""
    models = [c for c in forecast_rows.columns if c not in FOLD_KEYS]
    weeks = F.col("target_weeks").alias("forecast_week_start")
    steps = F.arrays_zip(weeks, *[F.col(f"`{m}`").alias(m) for m in models])
    return forecast_rows.where("fold = 0").select("item", F.inline_outer(steps))


def last_fold_details(rows: DataFrame) -> DataFrame:
    """Actual and predicted values of the latest fold, unclipped."""
    steps = F.arrays_zip(
        F.col("target_weeks").alias("week"),
        F.col("actual").alias("y_true"),
        F.col("yhat").alias("y_hat"),
    )
    return rows.where("fold = 1").select(
        "item", F.col("train_n").alias("fold_end_idx"), "model", F.inline_outer(steps)
    ).select("item", "fold_end_idx", "week", "model", "y_true", "y_hat")


def forecast_all(
    panel: DataFrame,
    params: ForecastParams = ForecastParams(),
    auto_selection: bool = True,
    models: tuple[str, ...] = ALL_MODELS,
) -> DataFrame:
    """Next weeks of every item: backtested selection, or the rule-based choice."""
    if auto_selection:
        return forecast_selected(item_board(panel, params, models), params)
    return forecast_priority(model_rows(panel, params, models), params)
