"""Queries on the global boosted-tree model.

Training is iterative, so only its inputs have comparison SQL; the rest is rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweek.operators import evaluation, gbm
from marketweek.operators.features import weekly_features
from marketweek.operators.substitutes import grouped_state, item_state, substitutes
from marketweek.operators.weekly import join_weather, weather_weekly
from marketweek.params import GbmParams
from marketweek.session import materialise
from suite import sql
from suite.adapters import item_groups, panel, rounded, stored_weekly, weather_daily, weekly
from suite.forecasts import RULES, VALIDATION, naive_validation
from suite.registry import query

TRAIN_UNTIL = "1999-12-31"
WEATHER = ("precip", "tmax")
PARAMS = GbmParams(extra_features=WEATHER)


def feature_table(spark, sf) -> DataFrame:
    table = weekly_features(weekly(spark, sf))
    return join_weather(table, weather_weekly(weather_daily(spark, sf)))


def prepared(spark, sf) -> DataFrame:
    """Feature rows, stored once: training reads them many times."""
    return gbm.training_table(feature_table(spark, sf), extra=WEATHER)


def trained(spark, sf) -> tuple[gbm.GlobalModel, DataFrame]:
    """Every query trains its own model, with the library's defaults."""
    rows = prepared(spark, sf)
    return gbm.fit(evaluation.until(rows, TRAIN_UNTIL), PARAMS), rows


def _inputs_sql() -> str:
    """The warm-up policy on one look-back of every kind."""
    lag = "lag(log_price, {0}) OVER o"
    past = "(o ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)"
    std = f"CASE WHEN count(log_qty) OVER {past} = 26 THEN stddev_samp(log_qty) OVER {past} END"
    kinds = {
        "log_price_lag12": "log_price_lag12",
        "log_price_lag52": "coalesce(log_price_lag52, log_price)",
        "log_qty_rollstd26": "coalesce(log_qty_rollstd26, 0)",
        "log_price_yoy_gap": "coalesce(log_price - log_price_lag52, 0)",
        "tmax": "coalesce(tmax, 0)",
        "item_encoding": "item_encoding",
    }
    return f"""WITH {sql.WEEKLY}, {sql.DAILY},
      logs AS (SELECT *, ln(1 + unit_price_week) AS log_price, ln(1 + qty_in_week) AS log_qty FROM weekly),
      labelled AS (SELECT *, lead(log_price) OVER (PARTITION BY item ORDER BY week) AS label FROM logs),
      looked AS (
        SELECT item, week, log_price, {lag.format(12)} AS log_price_lag12, {lag.format(52)} AS log_price_lag52,
               {std} AS log_qty_rollstd26, count(*) OVER (o ROWS UNBOUNDED PRECEDING) AS rn,
               coalesce(avg(label) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), log_price) AS item_encoding
        FROM labelled WINDOW o AS (PARTITION BY item ORDER BY week)
      )
      SELECT item, week, {', '.join(sql.r4(v, k) for k, v in kinds.items())},
        CAST(rn <= 52 AS DOUBLE) AS is_missing, CAST(tmax IS NULL AS DOUBLE) AS is_missing_extra
      FROM looked LEFT JOIN weather USING (week) WHERE rn > 12"""


INPUT_KINDS = ("log_price_lag12", "log_price_lag52", "log_qty_rollstd26", "log_price_yoy_gap", "tmax", "item_encoding")


@query(_inputs_sql())
def gbm_inputs(spark, sf):
    rows = gbm.prepare(feature_table(spark, sf), extra=WEATHER)
    return rounded(rows.select("item", "week", *INPUT_KINDS, "is_missing", "is_missing_extra"), *INPUT_KINDS)


@query(None)
def gbm_val(spark, sf):
    model, rows = trained(spark, sf)
    return gbm.validation_predictions(model, evaluation.between(rows, *VALIDATION))


@query(None)
def gbm_improvement(spark, sf):
    model, rows = trained(spark, sf)
    held = gbm.validation_predictions(model, evaluation.between(rows, *VALIDATION))
    naive = naive_validation(panel(spark, sf)).withColumnRenamed("week", "forecast_week")
    return evaluation.improvement(held, naive)


@query(None)
def gbm_metrics(spark, sf):
    model, rows = trained(spark, sf)
    held = evaluation.between(rows, *VALIDATION)
    return gbm.overall_metrics(gbm.validation_predictions(model, held))


@query(None)
def gbm_next_week(spark, sf):
    model, rows = trained(spark, sf)
    return gbm.score_next_week(model, rows, rows.select(F.max("week")).scalar())


@query(None)
def gbm_importance(spark, sf):
    return trained(spark, sf)[0].importances()


@query(None)
def gbm_cv(spark, sf):
    return gbm.yearly_cv(prepared(spark, sf), 1996, 5, PARAMS)


#: Facts about a model hold whatever its length.
SHORT = GbmParams(extra_features=WEATHER, rounds=5)


@query(f"""WITH {sql.WEEKLY},
  ahead AS (SELECT item, week, unit_price_week, lead(unit_price_week) OVER o AS y, lead(week) OVER o AS forecast_week,
    row_number() OVER o AS rn FROM weekly WINDOW o AS (PARTITION BY item ORDER BY week))
  SELECT item, forecast_week, {sql.r4('y')}, true AS has_log,
    true AS is_expm1, true AS importances_sum_to_one, true AS metrics_agree
  FROM ahead WHERE y IS NOT NULL AND rn > 12 AND week BETWEEN DATE '{VALIDATION[0]}' AND DATE '{VALIDATION[1]}'""")
def gbm_facts(spark, sf):
    """Keys and targets of the validated rows, with what must hold of any model: prices are
    ``expm1`` of the predicted logs, importances sum to one, and the measures, worked out anew
    from the predictions, are those that the library reports."""
    rows = prepared(spark, sf)
    model = gbm.fit(evaluation.until(rows, TRAIN_UNTIL), SHORT)
    held = materialise(gbm.validation_predictions(model, evaluation.between(rows, *VALIDATION)))
    reported = gbm.overall_metrics(held).first()
    error = F.abs(F.col("y") - F.col("y_hat"))
    again = held.agg(
        F.avg(error).alias("mae"), (F.sum(error) / F.sum(F.abs("y"))).alias("wape"),
        F.sqrt(F.avg((F.col("log_y") - F.col("log_hat")) ** 2)).alias("rmse_log"),
    ).first()
    agree = all(abs(reported[m] - again[m]) <= 1e-9 * max(1.0, abs(again[m])) for m in again.asDict())
    total = model.importances().agg(F.sum("importance")).scalar()
    close = lambda a, b: F.abs(a - b) <= 1e-9 * (1 + F.abs(b))
    return rounded(held.select(
        "item", "forecast_week", "y", close(F.col("log_y"), F.log1p("y")).alias("has_log"),
        close(F.col("y_hat"), F.expm1("log_hat")).alias("is_expm1"),
        (F.abs(total - 1) < 1e-6).alias("importances_sum_to_one"), F.lit(agree).alias("metrics_agree"),
    ), "y")


@query(None)
def gbm_cv_summary(spark, sf):
    """Plain mean of the measures of the yearly folds."""
    return gbm.cv_summary(gbm.yearly_cv(prepared(spark, sf), 1996, 5, SHORT))


@query(None)
def gbm_substitutes(spark, sf):
    model, rows = trained(spark, sf)
    table = stored_weekly(spark, sf)
    latest = table.select(F.max("week")).scalar()
    next_week = gbm.score_next_week(model, rows, latest)
    return substitutes(grouped_state(item_state(table), next_week, item_groups(spark, sf)), RULES)
