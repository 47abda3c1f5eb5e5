"""Holdout evaluation: splits, metrics overall and per item, comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweek.functions.metrics import prediction_metrics

COMPARED = ("wape", "smape", "mae")


def until(df: DataFrame, last_day: str) -> DataFrame:
    """Training side of a split, on ``week``.

    The target of the last training week lies after the split; the split is on the week of
    the features, as documented.
    """
    return df.where(F.col("week") <= F.lit(last_day).cast("date"))


def between(df: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Validation side of a split."""
    return df.where(F.col("week").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))


def metrics_overall_and_by_item(predictions: DataFrame) -> DataFrame:
    """Metrics of ``item, y, y_hat``: one row per item and one in total (``is_total = 1``)."""
    measures = prediction_metrics(F.col("y"), F.col("y_hat"))
    return predictions.groupingSets([["item"], []], "item").agg(
        *[c.alias(m) for m, c in measures.items()],
        F.grouping("item").cast("int").alias("is_total"),
    )


def improvement(model: DataFrame, baseline: DataFrame) -> DataFrame:
    """Relative gain of a model's metrics over a baseline's, overall and per item.

    Both sides have ``item, forecast_week, y, y_hat``, one row per item and predicted week, and
    are scored on the rows they share; ``n_model`` and ``n_base`` count what each side
    predicted, ``n_common`` what was compared. One join, one aggregation.
    """
    m = model.select("item", "forecast_week", "y", F.col("y_hat").alias("_m"))
    b = baseline.select("item", "forecast_week", F.col("y_hat").alias("_b"))
    shared = F.col("_m").isNotNull() & F.col("_b").isNotNull()
    y = F.when(shared, F.col("y"))
    mine, other = (prediction_metrics(y, F.col(c)) for c in ("_m", "_b"))
    scores = m.join(b, ["item", "forecast_week"], "full").groupingSets([["item"], []], "item").agg(
        F.grouping("item").cast("int").alias("is_total"),
        *[c.alias(f"{k}_model") for k, c in mine.items() if k in COMPARED],
        *[c.alias(f"{k}_base") for k, c in other.items() if k in COMPARED],
        F.count("_m").alias("n_model"),
        F.count("_b").alias("n_base"),
        mine["n"].alias("n_common"),
    )
    gains = {
        f"{k}_gain": F.try_divide(F.col(f"{k}_base") - F.col(f"{k}_model"), F.col(f"{k}_base")) for k in COMPARED
    }
    return scores.withColumns(gains)


def best_and_worst(metrics: DataFrame, n: int = 5) -> DataFrame:
    """Items with the lowest and the highest WAPE."""
    items = metrics.where("is_total = 0 and wape is not null").select("item", "wape")
    best = items.orderBy("wape", "item").limit(n).withColumn("side", F.lit("best"))
    worst = items.orderBy(F.desc("wape"), "item").limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)
