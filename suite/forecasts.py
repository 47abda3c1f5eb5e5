"""Queries on folds, forecasters, backtests, selection and holdout evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweek.functions.estimation import estimated
from marketweek.functions.smoothing import holt_winters
from marketweek.operators import evaluation, forecast, profile
from marketweek.operators.baselines import (
    calendar_naive,
    holt,
    holt_fit,
    holt_start,
    line_ahead,
    rolling_mean,
    seasonal_naive,
    week_mean,
    week_pairs,
)
from marketweek.operators.folds import folds, series
from marketweek.operators.substitutes import (
    grouped_state,
    group_thresholds as thresholds_of,
    item_state,
    recommendation_kpis,
    substitutes as substitutes_of,
)
from marketweek.params import ForecastParams, SubstituteParams
from marketweek.operators.weekly import target_panel
from marketweek.session import materialise, spread
from suite import smoothing_sql, sql
from suite.adapters import item_groups, panel, r4, rounded, stored_weekly
from suite.registry import query

#: The grid search is what the comparison SQL can repeat; the library estimates by default.
P = ForecastParams(smoothing="grid")
ESTIMATED = ForecastParams()
VALIDATION = ("2000-01-01", "2000-12-31")
THRESHOLD = 0.01
"""Prices of the test tables differ little between items; the rule's default of 0.15 would
recommend nothing."""
METRICS = ("rmse", "mae", "mape", "smape")


# All five models, with the parameter search of the smoothing models written as recursion.
_EVERY = smoothing_sql.all_models()
_ALL_SCORES = smoothing_sql.all_scores()


def five_models(spark, sf) -> DataFrame:
    return forecast.model_rows(panel(spark, sf), P)


def steps(rows: DataFrame, value) -> DataFrame:
    """Arrays over the horizon to rows."""
    zipped = F.arrays_zip(F.col("target_weeks").alias("week"), value.alias("y_hat"))
    return rounded(rows.select("item", "fold", F.inline_outer(zipped)), "y_hat")


@query(f"""WITH {sql.FOLDS} SELECT item, week FROM horizon WHERE fold = 0""")
def future_weeks(spark, sf):
    live = folds(series(panel(spark, sf)), P).where("fold = 0")
    return live.select("item", F.explode("target_weeks").alias("week"))


@query(f"""WITH {sql.FOLDS} SELECT item, fold, CAST(train_n AS INTEGER) AS train_n,
  min(week) AS first_week, {sql.r4('sum(actual)', 'actual_sum')} FROM horizon GROUP BY 1, 2, 3""")
def fold_table(spark, sf):
    rows = folds(series(panel(spark, sf)), P)
    total = F.aggregate("actual", F.lit(0.0), lambda a, v: a + v)
    return rows.select(
        "item", "fold", "train_n", F.col("target_weeks")[0].alias("first_week"), r4(total).alias("actual_sum")
    )


def _model_sql(name: str) -> str:
    return f"""WITH {sql.MODELS} SELECT item, fold, week, {sql.r4('yhat', 'y_hat')}
      FROM preds WHERE model = '{name}'"""


@query(_model_sql("SeasonalNaive"))
def snaive_pos(spark, sf):
    rows = folds(series(panel(spark, sf)), P)
    return steps(rows, seasonal_naive(F.col("y"), P.horizon, P.period))


@query(_model_sql("WeekMean"))
def weekmean(spark, sf):
    rows = folds(series(panel(spark, sf)), P)
    rows = rows.withColumn("pairs", week_pairs(F.col("weeks"), F.col("y")))
    return steps(rows, week_mean(F.col("pairs"), F.col("target_weeks")))


@query(_model_sql("RollMean(8w)"))
def rollmean(spark, sf):
    rows = folds(series(panel(spark, sf)), P)
    return steps(rows, rolling_mean(F.col("y"), P.horizon, P.window))


def _holt_sql(points: str, tail: str) -> str:
    """Recursion over the weeks of every item, once per parameter point."""
    return f"""WITH RECURSIVE {sql.SERIES}, points AS ({points}),
    start AS (
      SELECT item, max(n) AS n, regr_intercept(target, rn) AS level, regr_slope(target, rn) AS trend
      FROM ser WHERE rn <= 10 GROUP BY 1 HAVING count(*) > 1
    ),
    walk AS (
      SELECT item, alpha, beta, n, CAST(0 AS BIGINT) AS rn, CAST(0 AS DOUBLE) AS sse, level, trend
      FROM start CROSS JOIN points
      UNION ALL
      SELECT item, alpha, beta, n, rn, sse + e * e, level + trend + alpha * e, trend + alpha * beta * e
      FROM (
        SELECT w.*, s.target - w.level - w.trend AS e, s.rn AS rn2 FROM (
          SELECT item, alpha, beta, n, rn + 1 AS rn, sse, level, trend FROM walk WHERE rn < n
        ) w JOIN ser s ON s.item = w.item AND s.rn = w.rn
      )
    )
    {tail}"""


@query(_holt_sql(
    "SELECT 0.3::DOUBLE AS alpha, 0.1::DOUBLE AS beta",
    f"""SELECT item, CAST(n AS INTEGER) AS n, {sql.r4('sse / n', 'mse')}, {sql.r4('level')},
    {sql.r4('trend')} FROM walk WHERE rn = n""",
))
def holt_fixed(spark, sf):
    rows = series(panel(spark, sf)).where("n > 1")
    rows = rows.withColumn("start", holt_start(F.col("y")))
    fit = rows.withColumn("s", holt_fit(F.col("y"), F.col("start"), F.lit(0.3), F.lit(0.1)))
    return fit.select("item", "n", r4(F.col("s.sse") / F.col("n")).alias("mse"),
                      r4("s.level").alias("level"), r4("s.trend").alias("trend"))


_GRID = """SELECT a AS alpha, b AS beta
  FROM (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS a)
  CROSS JOIN (SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.4]::DOUBLE[]) AS b)"""


@query(_holt_sql(
    _GRID,
    f""", best AS (
      SELECT *, row_number() OVER (PARTITION BY item ORDER BY sse, alpha, beta) AS r FROM walk WHERE rn = n)
    SELECT item, CAST(h AS INTEGER) AS h, {sql.r4('level + h * trend', 'y_hat')}
    FROM best CROSS JOIN range(1, 5) AS g(h) WHERE r = 1""",
))
def holt_forecast(spark, sf):
    rows = spread(series(panel(spark, sf)).where("n > 1"), "item")
    rows = rows.withColumn("start", holt_start(F.col("y")))
    fit = rows.withColumn("fit", holt(F.col("y"), F.col("start")))
    ahead = fit.select("item", F.posexplode_outer(line_ahead(F.col("fit"), P.horizon)).alias("pos", "y"))
    return ahead.select("item", (F.col("pos") + 1).alias("h"), r4("y").alias("y_hat"))


def _seasonal_sql(multiplicative: bool) -> str:
    """The full parameter search on every whole series of at least two seasons."""
    name = "hwmul" if multiplicative else "hwadd"
    ahead = "(level + h * trend) * season[h]" if multiplicative else "level + h * trend + season[h]"
    return f"""WITH RECURSIVE {sql.SERIES},
    train AS (SELECT item, 0 AS fold, n AS train_n, rn, target FROM ser),
    {smoothing_sql.searched(multiplicative, name)}
    SELECT item, CAST(h AS INTEGER) AS h, {sql.r4(ahead, 'y_hat')}
    FROM {name}_best{smoothing_sql.REFINEMENTS} CROSS JOIN range(1, 5) AS g(h)"""


def _seasonal(spark, sf, column: str) -> DataFrame:
    rows = spread(series(panel(spark, sf)).where(F.col("n") >= 2 * P.period), "item")
    fit = holt_winters(F.col("y"), P.horizon, P.period)
    ahead = rows.withColumn("f", fit).select("item", F.posexplode_outer(f"f.{column}").alias("pos", "y"))
    return ahead.select("item", (F.col("pos") + 1).alias("h"), r4("y").alias("y_hat"))


@query(_seasonal_sql(False))
def hw_add_grid(spark, sf):
    return _seasonal(spark, sf, "hw_add")


@query(_seasonal_sql(True))
def hw_mul_grid(spark, sf):
    return _seasonal(spark, sf, "hw_mul")


def _estimated_sql() -> str:
    """Per series and form the error of the grid search, which an estimate may not exceed."""
    parts = [
        f"""SELECT item, '{form}' AS form, CAST(train_n AS INTEGER) AS n, {sql.r4('sqrt(sse / train_n)', 'grid_rmse')},
        true AS not_worse, true AS in_bounds FROM {name}_best{smoothing_sql.REFINEMENTS}"""
        for form, name in (("hw_add", "hwadd"), ("hw_mul", "hwmul"))
    ]
    return f"""WITH RECURSIVE {sql.SERIES},
    train AS (SELECT item, 0 AS fold, n AS train_n, rn, target FROM ser),
    {smoothing_sql.searched(False, 'hwadd')}, {smoothing_sql.searched(True, 'hwmul')}
    {' UNION ALL '.join(parts)}"""


@query(_estimated_sql())
def hw_estimated(spark, sf):
    """Seasonal fits with estimated start states beside the grid's error on the same series."""
    rows = spread(series(panel(spark, sf)).where(F.col("n") >= 2 * P.period), "item")
    rows = rows.withColumn("fit", estimated(F.col("y"), P.horizon, P.period))
    positive = F.forall("y", lambda v: v > 0)
    forms = F.array(
        F.struct(F.lit("hw_add").alias("form"), F.col("fit.hw_add").alias("f")),
        F.when(positive, F.struct(F.lit("hw_mul").alias("form"), F.col("fit.hw_mul").alias("f"))),
    )
    found = rows.select("item", "n", F.inline_outer(F.array_compact(forms)))
    return found.select(
        "item", "form", "n", r4(F.sqrt(F.col("f.grid_sse") / F.col("n"))).alias("grid_rmse"),
        (F.col("f.sse") <= F.col("f.grid_sse")).alias("not_worse"),
        (F.col("f.alpha").between(1e-4, 0.9999) & F.col("f.beta").between(0, 1) & F.col("f.share").between(0, 1)).alias("in_bounds"),
    )


@query(f"""WITH {sql.FOLDS}, models AS (SELECT unnest(['SeasonalNaive', 'WeekMean', 'RollMean(8w)', 'HW-Add', 'HW-Mul']) AS model)
  SELECT item, CAST(max(n) AS BIGINT) AS ranks, 1 AS best, true AS finite FROM (
    SELECT item, (SELECT count(*) FROM models) AS n FROM horizon WHERE fold = 0) GROUP BY 1""")
def leaderboard_estimated(spark, sf):
    """The board with estimated smoothing, as facts that hold whatever the fits: five ranked
    models an item, the best one's error the least, all errors finite."""
    board = forecast.item_board(panel(spark, sf), ESTIMATED)
    return board.groupBy("item").agg(
        F.count("*").alias("ranks"),
        F.min_by("rank", F.struct(F.coalesce("smape", F.lit(1e9)), F.coalesce("mae", F.lit(1e9)), "model")).alias("best"),
        F.min(~F.isnan("smape") & (F.abs("smape") < float("inf"))).alias("finite"),
    )


@query(f"""WITH {_ALL_SCORES} SELECT item, fold, CAST(train_n AS INTEGER) AS fold_end_idx, model,
  {', '.join(sql.r4(m) for m in METRICS)} FROM fold_scores""")
def fold_metrics(spark, sf):
    return rounded(forecast.fold_metrics(five_models(spark, sf)), *METRICS)


@query(f"""WITH {_ALL_SCORES} SELECT item, CAST(rank AS INTEGER) AS rank, model,
  {', '.join(sql.r4(m) for m in METRICS)}, n_folds FROM board""")
def leaderboard(spark, sf):
    board = forecast.item_board(panel(spark, sf), P)
    return rounded(forecast.leaderboard(board), *METRICS)


def _wide_sql() -> str:
    cells = ["max(model) FILTER (rank = 1) AS selected_model"]
    for r in (1, 2, 3):
        cells.append(f"max(model) FILTER (rank = {r}) AS rank{r}_model")
        cells += [sql.r4(f"max({m}) FILTER (rank = {r})", f"rank{r}_{m}") for m in METRICS]
    return f"WITH {_ALL_SCORES} SELECT item, {', '.join(cells)} FROM board GROUP BY 1"


@query(_wide_sql())
def leaderboard_wide(spark, sf):
    wide = forecast.leaderboard_wide(forecast.item_board(panel(spark, sf), P))
    return rounded(wide, *[f"rank{r}_{m}" for r in (1, 2, 3) for m in METRICS])


@query(f"""WITH {_ALL_SCORES} SELECT p.item, p.week AS forecast_week_start, p.model AS model_used,
  {sql.r4('greatest(p.yhat, 0)', 'y_hat')} FROM every p JOIN board b
  ON b.item = p.item AND b.model = p.model AND b.rank = 1 WHERE p.fold = 0""")
def forecast_selected(spark, sf):
    board = forecast.item_board(panel(spark, sf), P)
    return rounded(forecast.forecast_selected(board, P), "y_hat")


@query(f"""WITH {_ALL_SCORES} SELECT p.item, p.week AS forecast_week_start, p.model AS model_used,
  {sql.r4('greatest(p.yhat, 0)', 'y_hat')} FROM every p JOIN board b
  ON b.item = p.item AND b.model = p.model AND b.rank = 1 WHERE p.fold = 0 ORDER BY 1, 2 LIMIT 20""")
def forecast_preview(spark, sf):
    board = forecast.item_board(panel(spark, sf), P)
    first = profile.preview(forecast.forecast_selected(board, P), ["item", "forecast_week_start"])
    return rounded(first, "y_hat")


@query(f"""WITH {_EVERY}, choice AS (
    SELECT item, CASE WHEN item LIKE 'hot %' THEN 'WeekMean' WHEN item LIKE 'large %' THEN 'Unheard' WHEN item LIKE 'small %' THEN 'HW-Add' WHEN item LIKE 'red %' THEN NULL ELSE 'RollMean(8w)' END AS model
    FROM items)
  SELECT p.item, p.week AS forecast_week_start, coalesce(c.model, 'SeasonalNaive') AS model_used, {sql.r4('greatest(p.yhat, 0)', 'y_hat')}
  FROM choice c JOIN every p ON p.item = c.item AND p.fold = 0
   AND p.model = CASE WHEN c.model = 'Unheard' OR c.model IS NULL THEN 'SeasonalNaive' ELSE c.model END""")
def forecast_by_name(spark, sf):
    item = F.col("item")
    name = F.when(item.like("hot %"), "WeekMean").when(item.like("large %"), "Unheard")
    name = name.when(item.like("small %"), "HW-Add").otherwise("RollMean(8w)")
    rows = five_models(spark, sf)
    # Some items have no named model: they get the default.
    choice = item_groups(spark, sf).where(~item.like("red %")).select("item", name.alias("model"))
    return rounded(forecast.forecast_by_name(rows, choice, P), "y_hat")


@query(f"""WITH {_EVERY}, ordered AS (
    SELECT *, CASE model WHEN 'HW-Mul' THEN 1 WHEN 'HW-Add' THEN 2 WHEN 'SeasonalNaive' THEN 3
      WHEN 'RollMean(8w)' THEN 4 ELSE 5 END AS priority
    FROM every WHERE fold = 0),
  usable AS (SELECT item, min(priority) AS priority FROM (
    SELECT item, priority FROM ordered GROUP BY ALL HAVING bool_and(isfinite(yhat))) GROUP BY 1)
  SELECT item, week AS forecast_week_start, model AS model_used, {sql.r4('greatest(yhat, 0)', 'y_hat')}
  FROM ordered JOIN usable USING (item, priority)""")
def forecast_priority(spark, sf):
    return rounded(forecast.forecast_priority(five_models(spark, sf), P), "y_hat")


@query(f"""WITH {_EVERY} SELECT item, week AS forecast_week_start,
  {sql.r4("max(yhat) FILTER (model = 'SeasonalNaive')", '"SeasonalNaive"')},
  {sql.r4("max(yhat) FILTER (model = 'WeekMean')", '"WeekMean"')},
  {sql.r4("max(yhat) FILTER (model = 'RollMean(8w)')", '"RollMean(8w)"')},
  {sql.r4("max(yhat) FILTER (model = 'HW-Add')", '"HW-Add"')},
  {sql.r4("max(yhat) FILTER (model = 'HW-Mul')", '"HW-Mul"')}
  FROM every WHERE fold = 0 GROUP BY 1, 2""")
def forecast_details_wide(spark, sf):
    rows = forecast.with_model_columns(folds(series(panel(spark, sf)), P), P)
    wide = forecast.forecast_details(rows)
    return wide.select("item", "forecast_week_start", *[r4(f"`{m}`").alias(m) for m in wide.columns[2:]])


@query(f"""WITH {_EVERY} SELECT item, CAST(train_n AS INTEGER) AS fold_end_idx, week, model,
  {sql.r4('actual', 'y_true')}, {sql.r4('yhat', 'y_hat')} FROM every WHERE fold = 1""")
def lastfold_details(spark, sf):
    return rounded(forecast.last_fold_details(five_models(spark, sf)), "y_true", "y_hat")


@query(f"""WITH {sql.FOLDS} SELECT (SELECT count(*) FROM items) AS items,
  (SELECT count(*) FROM folds) AS folds, (SELECT count(*) FROM horizon WHERE fold = 0) AS forecasts""")
def result_shapes(spark, sf):
    rows = folds(series(panel(spark, sf)), P)
    live = F.col("fold") == 0
    return rows.agg(
        F.count_if(live).alias("items"),
        F.count("*").alias("folds"),
        F.sum(F.when(live, F.size("target_weeks"))).alias("forecasts"),
    )


@query(f"""WITH {_EVERY} SELECT item, fold, week, model, {sql.r4('yhat', 'y_hat')} FROM every
  WHERE model LIKE 'HW-%'""")
def hw_forecast(spark, sf):
    rows = forecast.model_rows(panel(spark, sf), P, (forecast.HW_ADD, forecast.HW_MUL))
    zipped = F.arrays_zip(F.col("target_weeks").alias("week"), F.col("yhat").alias("y_hat"))
    return rounded(rows.select("item", "fold", "model", F.inline_outer(zipped)), "y_hat")


@query(_wide_sql())
def leaderboard_all_models(spark, sf):
    wide = forecast.leaderboard_wide(forecast.item_board(panel(spark, sf), P))
    return rounded(wide, *[f"rank{r}_{m}" for r in (1, 2, 3) for m in METRICS])


@query(f"""WITH {_ALL_SCORES} SELECT p.item, p.week AS forecast_week_start, p.model AS model_used,
  {sql.r4('greatest(p.yhat, 0)', 'y_hat')} FROM every p JOIN board b
  ON b.item = p.item AND b.model = p.model AND b.rank = 1 WHERE p.fold = 0""")
def forecast_all_models(spark, sf):
    return rounded(forecast.forecast_all(panel(spark, sf), P), "y_hat")


@query(f"""WITH {_EVERY} SELECT item, week AS forecast_week_start, model AS model_used,
  {sql.r4('greatest(yhat, 0)', 'y_hat')} FROM every WHERE fold = 0 AND model = 'HW-Mul'""")
def forecast_priority_all_models(spark, sf):
    return rounded(forecast.forecast_all(panel(spark, sf), P, auto_selection=False), "y_hat")


_NAIVE = """naive AS (
  SELECT a.item, a.week, a.target AS y, b.target AS y_hat
  FROM base a JOIN base b ON a.item = b.item AND a.week = b.week + 364
  WHERE a.week BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
),
rolled AS (
  SELECT * FROM (
    SELECT item, week, target AS y, avg(target) OVER (
      PARTITION BY item ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS y_hat FROM base
  ) WHERE y_hat IS NOT NULL AND week BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
)"""


def _measures(table: str) -> str:
    return f"""SELECT item, sum(abs(y - y_hat)) / sum(abs(y)) AS wape,
      avg(2 * abs(y - y_hat) / (abs(y) + abs(y_hat) + 1e-9)) AS smape,
      avg(abs(y - y_hat)) AS mae, count(*) AS n, CAST(grouping(item) AS INTEGER) AS is_total
      FROM {table} GROUP BY GROUPING SETS ((item), ())"""


def naive_validation(base: DataFrame) -> DataFrame:
    return evaluation.between(calendar_naive(base), *VALIDATION)


def rolled_validation(base: DataFrame) -> DataFrame:
    """One step ahead by the mean of the eight weeks before."""
    past = Window.partitionBy("item").orderBy("week").rowsBetween(-P.window, -1)
    rows = base.select(
        "item", "week", F.col("target").alias("y"), F.avg("target").over(past).alias("y_hat")
    )
    return evaluation.between(rows.where("y_hat is not null"), *VALIDATION)


@query(f"""WITH {sql.SERIES}, {_NAIVE}, m AS ({_measures('naive')})
  SELECT item, {sql.r4('wape')}, {sql.r4('smape')}, {sql.r4('mae')}, n, is_total FROM m""")
def val_metrics_gs(spark, sf):
    metrics = evaluation.metrics_overall_and_by_item(naive_validation(panel(spark, sf)))
    return rounded(metrics, "wape", "smape", "mae")


def _gains_sql() -> str:
    """Both sides on the (item, predicted week) rows they share, and how many each has."""
    cells = {
        "wape": "sum(abs(y - {0}) ) FILTER (ok) / sum(abs(y)) FILTER (ok)",
        "smape": "avg(2 * abs(y - {0}) / (abs(y) + abs({0}) + 1e-9)) FILTER (ok)",
        "mae": "avg(abs(y - {0})) FILTER (ok)",
    }
    both = ", ".join(f"{e.format(c)} AS {k}_{side}" for k, e in cells.items() for side, c in (("model", "m"), ("base", "b")))
    out = ", ".join(
        f"{sql.r4(f'{k}_model')}, {sql.r4(f'{k}_base')}, {sql.r4(f'({k}_base - {k}_model) / {k}_base', f'{k}_gain')}"
        for k in cells
    )
    return f"""WITH {sql.SERIES}, {_NAIVE}, joined AS (
      SELECT item, week, r.y, r.y_hat AS m, n.y_hat AS b, r.y_hat IS NOT NULL AND n.y_hat IS NOT NULL AS ok
      FROM rolled r FULL JOIN naive n USING (item, week)),
    scores AS (SELECT item, CAST(grouping(item) AS INTEGER) AS is_total, {both}, count(m) AS n_model,
      count(b) AS n_base, count(*) FILTER (ok) AS n_common FROM joined GROUP BY GROUPING SETS ((item), ()))
    SELECT item, is_total, n_model, n_base, n_common, {out} FROM scores"""


@query(_gains_sql())
def improvement(spark, sf):
    targets = target_panel(stored_weekly(spark, sf))
    model, base = (
        held(targets).withColumnRenamed("week", "forecast_week") for held in (rolled_validation, naive_validation)
    )
    gains = evaluation.improvement(model, base)
    return rounded(gains, *[f"{c}_{k}" for c in evaluation.COMPARED for k in ("model", "base", "gain")])


@query(f"""WITH {sql.SERIES}, {_NAIVE}, m AS (SELECT * FROM ({_measures('naive')}) WHERE is_total = 0)
  (SELECT item, {sql.r4('wape')}, 'best' AS side FROM m ORDER BY m.wape, item LIMIT 5) UNION ALL
  (SELECT item, {sql.r4('wape')}, 'worst' AS side FROM m ORDER BY m.wape DESC, item LIMIT 5)""")
def best_worst(spark, sf):
    metrics = evaluation.metrics_overall_and_by_item(naive_validation(panel(spark, sf)))
    return rounded(evaluation.best_and_worst(materialise(metrics)), "wape")


def recommendation_inputs(spark, sf, groups: DataFrame | None = None) -> DataFrame:
    """Reference-week state with the rolling mean as next week's price."""
    table = stored_weekly(spark, sf)
    rows = forecast.model_rows(target_panel(table), P, (forecast.ROLL_MEAN,)).where("fold = 0")
    predictions = rows.select("item", F.col("yhat")[0].alias("pred_price"))
    groups = item_groups(spark, sf) if groups is None else groups
    return materialise(grouped_state(item_state(table), predictions, groups))


RULES = SubstituteParams(price_discount_threshold=THRESHOLD)
_STATE = sql.STATE.format(threshold=THRESHOLD)


@query(f"""WITH {_STATE} SELECT grp, item, {sql.r4('unit_price_week')}, {sql.r4('qty_rollmean4')},
  {sql.r4('price_vol_8')}, {sql.r4('pred_price')} FROM state""")
def reference_week_state(spark, sf):
    state = recommendation_inputs(spark, sf)
    cols = ("unit_price_week", "qty_rollmean4", "price_vol_8", "pred_price")
    return rounded(state.select("grp", "item", *cols), *cols)


@query(f"""WITH {_STATE} SELECT grp, {sql.r4('supply_median')}, {sql.r4('vol_q3')} FROM limits""")
def group_thresholds(spark, sf):
    return rounded(thresholds_of(recommendation_inputs(spark, sf), RULES), "supply_median", "vol_q3")


@query(f"""WITH {_STATE} SELECT grp, item, CAST(rank AS INTEGER) AS rank, substitute, {sql.r4('saving_rate')},
  {sql.r4('price_vol_8')}, {sql.r4('own_vol_8')} FROM suggestions""")
def substitutes(spark, sf):
    found = substitutes_of(recommendation_inputs(spark, sf), RULES)
    return rounded(found, "saving_rate", "price_vol_8", "own_vol_8")


_OVERLAP = _STATE.replace(
    "split_part(s.item, ' ', 2) AS grp", "unnest(['all', split_part(s.item, ' ', 2)]) AS grp"
)


@query(f"""WITH {_OVERLAP}, pairs AS (
    SELECT item, substitute, min(grp) AS grp, min(saving_rate) AS saving_rate, min(price_vol_8) AS price_vol_8,
           min(own_vol_8) AS own_vol_8 FROM ranked GROUP BY 1, 2),
  best AS (SELECT *, row_number() OVER (
    PARTITION BY item ORDER BY saving_rate DESC, price_vol_8, substitute) AS rank FROM pairs)
  SELECT grp, item, CAST(rank AS INTEGER) AS rank, substitute, {sql.r4('saving_rate')}, {sql.r4('price_vol_8')},
  {sql.r4('own_vol_8')} FROM best WHERE rank <= 5""")
def substitutes_overlapping(spark, sf):
    """Every item in its own group and in one of all items."""
    state = recommendation_inputs(spark, sf)
    both = state.unionByName(state.withColumn("grp", F.lit("all")))
    return rounded(substitutes_of(both, RULES), "saving_rate", "price_vol_8", "own_vol_8")


@query(f"""WITH {_STATE} SELECT
  {sql.r4('100.0 * count(DISTINCT item) / (SELECT count(*) FROM state)', 'coverage_pct')},
  {sql.r4('100 * sum(saving_rate) / count(*)', 'mean_saving_pct')},
  {sql.r4('100.0 * count(*) FILTER (price_vol_8 <= own_vol_8) / count(*)', 'stability_pct')},
  {sql.r4('100.0 * count(*) FILTER (accepted) / count(*)', 'acceptance_pct')} FROM suggestions""")
def substitute_kpis(spark, sf):
    grouped = recommendation_inputs(spark, sf)
    found = materialise(substitutes_of(grouped, RULES))
    # Stand-in for user feedback: accepted if the substitute is cheaper already this week.
    price = grouped.select("item", "unit_price_week")
    feedback = (
        found.select("item", "substitute")
        .join(price.withColumnRenamed("unit_price_week", "own"), "item")
        .join(price.select(F.col("item").alias("substitute"), F.col("unit_price_week").alias("new")), "substitute")
        .select("item", "substitute", (F.col("new") < F.col("own")).alias("accepted"))
    )
    kpis = recommendation_kpis(grouped, found, feedback)
    return rounded(kpis, *kpis.columns)
