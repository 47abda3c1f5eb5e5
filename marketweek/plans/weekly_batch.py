"""The weekly batch, stage by stage; every stage is a table the next one reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweek.functions.scalar import require_rows
from marketweek.operators import evaluation, gbm
from marketweek.operators.baselines import calendar_naive
from marketweek.operators.features import weekly_features
from marketweek.operators.forecast import (
    forecast_selected,
    last_fold_details,
    leaderboard_wide,
    model_rows,
    scoreboard,
)
from marketweek.operators.substitutes import grouped_state, item_state, rule_params, substitutes
from marketweek.operators.weekly import (
    apply_aliases,
    join_weather,
    target_panel,
    weather_weekly,
    weekly_agg,
)
from marketweek.params import FeatureParams, ForecastParams, GbmParams, SubstituteParams
from marketweek.session import materialise
from marketweek.sources.readers import read_rules, read_stage, read_transactions, read_weather
from marketweek.sources.sinks import save_model, write_report, write_stage


@dataclass(frozen=True)
class Sources:
    """Where a run reads from: transaction sources, daily weather, and the three rule tables."""

    transactions: tuple[str, ...]
    rule_params: str
    aliases: str
    groups: str
    weather: str | None = None


@dataclass(frozen=True)
class Reports:
    """Which result files a run writes."""

    predictions: bool = True
    details: bool = True
    leaderboard: bool = True


def build_weekly(transactions: DataFrame, path: str, aliases: DataFrame | None = None) -> DataFrame:
    """Transactions to the stored weekly aggregate."""
    weekly = weekly_agg(transactions)
    if aliases is not None:
        weekly = apply_aliases(weekly, aliases)
    write_stage(weekly, path, partition_by_year=True)
    return read_stage(transactions.sparkSession, path)


def build_features(
    weekly: DataFrame,
    path: str,
    weather: DataFrame | None = None,
    features: FeatureParams = FeatureParams(),
) -> DataFrame:
    """Stored feature table, with the weekly weather if there is one."""
    table = weekly_features(weekly, features)
    if weather is not None:
        table = join_weather(table, weather_weekly(weather))
    write_stage(table, path)
    return read_stage(weekly.sparkSession, path)


def forecast_items(
    spark: SparkSession,
    weekly: DataFrame,
    out: str,
    params: ForecastParams = ForecastParams(),
    reports: Reports = Reports(),
) -> DataFrame:
    """Per-item backtest, selection and forecast, with the optional reports."""
    write_stage(model_rows(target_panel(weekly), params), f"{out}/model_rows")
    rows = read_stage(spark, f"{out}/model_rows")
    board = scoreboard(rows)
    forecasts = forecast_selected(board, params)
    write_report(forecasts.orderBy("item", "forecast_week_start"), f"{out}/forecasts", reports.predictions)
    write_report(leaderboard_wide(board).orderBy("item"), f"{out}/leaderboard", reports.leaderboard)
    write_report(
        last_fold_details(rows).orderBy("item", "week", "model"), f"{out}/last_fold", reports.details
    )
    return forecasts


def train_and_recommend(
    features: DataFrame,
    weekly: DataFrame,
    groups: DataFrame,
    out: str,
    train_until: str,
    validate: tuple[str, str],
    model_params: GbmParams = GbmParams(),
    rules: SubstituteParams = SubstituteParams(),
    feature_params: FeatureParams = FeatureParams(),
) -> DataFrame:
    """Global model with holdout reports, next week's prices, and substitutes."""
    prepared = gbm.training_table(features, feature_params, model_params.extra_features)
    model = gbm.fit(evaluation.until(prepared, train_until), model_params, feature_params)
    held = materialise(
        gbm.validation_predictions(model, evaluation.between(prepared, *validate))
    )
    metrics = evaluation.metrics_overall_and_by_item(held)
    naive = materialise(evaluation.between(calendar_naive(target_panel(weekly)), *validate))
    base = evaluation.metrics_overall_and_by_item(naive)
    write_report(held, f"{out}/val_predictions")
    write_report(metrics, f"{out}/val_metrics")
    write_report(naive, f"{out}/baseline_predictions")
    write_report(base, f"{out}/baseline_metrics")
    write_report(evaluation.improvement(held, naive.withColumnRenamed("week", "forecast_week")), f"{out}/improvement")
    write_report(model.importances(), f"{out}/importances")
    save_model(model.pipeline, f"{out}/model")
    latest = weekly.select(F.max("week")).scalar()
    next_week = materialise(gbm.score_next_week(model, prepared, latest))
    write_report(next_week, f"{out}/next_week")
    state = materialise(grouped_state(item_state(weekly), next_week, groups))
    suggestions = materialise(substitutes(state, rules))
    write_report(suggestions.orderBy("item", "rank"), f"{out}/suggestions")
    return suggestions


def run_from_files(
    spark: SparkSession,
    sources: Sources,
    out: str,
    train_until: str,
    validate: tuple[str, str],
    params: ForecastParams = ForecastParams(),
    model_params: GbmParams = GbmParams(),
    reports: Reports = Reports(),
) -> DataFrame:
    """The whole batch: source files to forecasts, model and suggestions under ``out``.

    Aliases apply to the weekly table, groups and rule parameters to the suggestions. No
    transaction at all is an error, before anything is trained. With a weather file, the
    variables named in ``model_params.extra_features`` enter the model.
    """
    rules, aliases, groups = read_rules(spark, sources.rule_params, sources.aliases, sources.groups)
    raw = require_rows(read_transactions(spark, sources.transactions), "the transactions")
    weekly = build_weekly(raw, f"{out}/weekly", aliases)
    weather = read_weather(spark, sources.weather) if sources.weather else None
    features = build_features(weekly, f"{out}/features", weather)
    forecast_items(spark, weekly, out, params, reports)
    return train_and_recommend(
        features, weekly, groups, out, train_until, validate, model_params, rule_params(rules)
    )
