import numpy as np
import pytest
from helpers import monday, weekly
from pyspark.sql import functions as F

from marketweek.operators import evaluation, gbm
from marketweek.operators.baselines import calendar_naive
from marketweek.operators.features import weekly_features
from marketweek.operators.weekly import target_panel
from marketweek.params import GbmParams
from marketweek.sources.sinks import load_model, save_model

PARAMS = GbmParams(rounds=5, min_child_samples=5)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(4):
        drift = np.cumsum(rng.normal(0, 0.03, 260))
        for i in range(260):
            price = 100 * (k + 1) * np.exp(0.2 * np.sin(2 * np.pi * i / 52) + drift[i])
            qty = float(rng.integers(5, 50))
            rows.append((f"item{k}", i, qty, float(price * qty)))
    return weekly(spark, rows).cache()


@pytest.fixture(scope="module")
def prepared(spark, table):
    return gbm.training_table(weekly_features(table))


def test_beats_the_seasonal_naive(spark, table, prepared, tmp_path):
    split, end = str(monday(208)), str(monday(258))
    model = gbm.fit(evaluation.until(prepared, split), PARAMS)
    held = gbm.validation_predictions(model, evaluation.between(prepared, str(monday(209)), end))
    mine = evaluation.metrics_overall_and_by_item(held)
    naive = evaluation.between(calendar_naive(target_panel(table)), str(monday(208)), str(monday(259)))
    gains = evaluation.improvement(held, naive.withColumnRenamed("week", "forecast_week"))
    total = gains.where("is_total = 1").first()
    assert total.item is None and total.wape_gain > 0 and total.mae_gain > 0
    # The baseline has two more predicted weeks of each of the four items.
    assert (total.n_model, total.n_base, total.n_common) == (200, 208, 200)
    assert gains.count() == 5

    weights = [r.importance for r in model.importances().collect()]
    assert sum(weights) == pytest.approx(1) and weights == sorted(weights, reverse=True)

    save_model(model.pipeline, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m"))
    sample = prepared.where(F.col("week") == monday(220))
    one = {r.item: r.prediction for r in again.transform(sample).collect()}
    two = {r.item: r.log_pred for r in model.predict(sample).collect()}
    assert one == two
    next_week = gbm.score_next_week(model, prepared, F.lit(monday(259)))
    assert {(r.forecast_week_start, r.pred_price > 0) for r in next_week.collect()} == {(monday(260), True)}


def test_item_encoding_sees_only_the_past(spark, table):
    rows = gbm.encode_items(weekly_features(table)).where("item = 'item1'").orderBy("week").collect()
    prices = [r.log_price for r in rows]
    assert rows[0][gbm.ITEM_ENCODING] == prices[0]
    for i in (1, 2, 50):
        assert rows[i][gbm.ITEM_ENCODING] == pytest.approx(np.mean(prices[1 : i + 1]))


def test_a_thousand_items_score_alike_after_loading(spark, tmp_path):
    shape = weekly(spark, [("x", i, 10.0, 1000.0 + 50 * (i % 7)) for i in range(20)]).drop("item")
    many = spark.range(1000).select(F.concat(F.lit("item"), "id").alias("item"), (F.col("id") % 9 + 1).alias("_k"))
    rows = many.crossJoin(shape).withColumn("unit_price_week", F.col("unit_price_week") * F.col("_k")).drop("_k")
    prepared = gbm.training_table(weekly_features(rows))
    model = gbm.fit(prepared, GbmParams(rounds=2, min_child_samples=5))
    assert model.inputs[-1] == gbm.ITEM_ENCODING
    save_model(model.pipeline, str(tmp_path / "m"))
    again = gbm.GlobalModel(load_model(str(tmp_path / "m")), model.inputs)
    one, two = (m.predict(prepared).select("item", "week", "log_pred") for m in (model, again))
    assert one.count() > 1000 and one.exceptAll(two).isEmpty()
    stranger = prepared.limit(1).withColumn("item", F.lit("new"))
    assert again.predict(stranger).first().pred_price > 0


def test_warm_up_policy(spark, table):
    rows = gbm.prepare(weekly_features(table))
    assert rows.agg(F.min("week")).first()[0] == monday(12)
    assert rows.where("log_price_lag52 is null or log_qty_rollstd52 is null").isEmpty()
    flagged = rows.where("is_missing = 1").agg(F.max("week")).first()[0]
    assert flagged == monday(51)


def test_yearly_folds(spark, prepared):
    folds = gbm.yearly_cv(prepared, 2019, 2, GbmParams(rounds=2, min_child_samples=5))
    got = {r.fold_year: r for r in folds.collect()}
    assert set(got) == {2020, 2021} and all(r.n > 0 and r.rmse_log > 0 for r in got.values())
    summary = gbm.cv_summary(folds).first()
    assert summary.folds == 2
    assert summary.wape == pytest.approx((got[2020].wape + got[2021].wape) / 2)
