"""One boosted-tree model over all items, on next week's log price.

Spark ML trains on the distributed feature table: per tree level the executors send
histograms of fixed size, never rows. Trees here take no missing values, so warm-up rows
follow the policy in :func:`impute`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketweek.functions.metrics import log_rmse, prediction_metrics
from marketweek.operators.evaluation import between, until
from marketweek.params import FeatureParams, GbmParams
from marketweek.session import ensure_checkpoint_dir, materialise

LABEL = "next_week_log_price"
ITEM_ENCODING = "item_encoding"
BINS = 64
SHORT_LAG = 12
RAW_FEATURES = ("log_price", "log_qty", "qty_in_week", "year", "month", "weekofyear")


def feature_names(features: FeatureParams = FeatureParams(), extra: tuple[str, ...] = ()) -> list[str]:
    """Numeric model inputs, in a fixed order."""
    names = list(RAW_FEATURES)
    for c in ("log_price", "log_qty"):
        names += [f"{c}_lag{k}" for k in features.lags]
        names += [f"{c}_{s}{w}" for w in features.windows for s in ("rollmean", "rollstd")]
        names.append(f"{c}_yoy_gap")
    names += [f"price_vol_{w}" for w in features.vol_windows]
    return [*names, *extra]


def encode_items(table: DataFrame) -> DataFrame:
    """Item as a number, the same way for any number of items: the mean target of its earlier rows.

    The target of an earlier row is the price of a week up to the current one, so the row's own
    target never enters. An item's first row has the current price. The window is that of the
    look-backs and needs no further shuffle; an item never seen in training is no special case.
    """
    earlier = Window.partitionBy("item").orderBy("week").rowsBetween(Window.unboundedPreceding, -1)
    mean = F.coalesce(F.avg(LABEL).over(earlier), F.col("log_price"))
    return table.withColumn(ITEM_ENCODING, mean)


def drop_warm_up(table: DataFrame, features: FeatureParams = FeatureParams()) -> DataFrame:
    """Require the short look-backs."""
    short = [f"log_price_lag{k}" for k in features.lags if k <= SHORT_LAG]
    return table.dropna(subset=["log_price", "log_qty", *short])


def impute(
    table: DataFrame, features: FeatureParams = FeatureParams(), extra: tuple[str, ...] = ()
) -> DataFrame:
    """Fill the long look-backs: levels with the current level, spreads and gaps with 0,
    outside variables with 0; ``is_missing`` and ``is_missing_extra`` mark such rows."""

    def filled(name: str) -> Column:
        level = "log_price" if name.startswith("log_price") else "log_qty"
        is_level = "_lag" in name or "_rollmean" in name
        return F.coalesce(F.col(name), F.col(level) if is_level else F.lit(0.0))

    back = [n for n in feature_names(features) if n not in RAW_FEATURES]
    any_missing = F.lit(False)
    for name in back:
        any_missing = any_missing | F.col(name).isNull()
    no_extra = F.lit(False)
    for name in extra:
        no_extra = no_extra | F.col(name).isNull()
    flags = {"is_missing": any_missing.cast("double"), "is_missing_extra": no_extra.cast("double")}
    fills = {n: filled(n) for n in back} | {n: F.coalesce(F.col(n), F.lit(0.0)) for n in extra}
    return table.withColumns(flags).withColumns(fills)


def prepare(
    table: DataFrame, features: FeatureParams = FeatureParams(), extra: tuple[str, ...] = ()
) -> DataFrame:
    """Feature rows ready for training or scoring. The label may be NULL in the last week."""
    return impute(drop_warm_up(encode_items(table), features), features, extra)


def training_table(
    table: DataFrame, features: FeatureParams = FeatureParams(), extra: tuple[str, ...] = ()
) -> DataFrame:
    """Prepared rows, stored once and spread evenly.

    Training passes over the rows once per tree level, so they are cut from their lineage,
    and every task gets a share in a fixed order, on which the seeded row sample depends. The
    number of shares is left to Spark, which goes by the size of the table: every level runs
    one task per share, so idle ones would cost as much as the training itself.
    """
    even = prepare(table, features, extra).repartition("item", "week")
    return materialise(even.sortWithinPartitions("item", "week"))


@dataclass(frozen=True)
class GlobalModel:
    """A fitted model; its pipeline alone scores prepared rows, also after saving and loading."""

    pipeline: PipelineModel
    inputs: tuple[str, ...]

    def predict(self, prepared: DataFrame) -> DataFrame:
        """Adds ``log_pred`` and ``pred_price``."""
        scored = self.pipeline.transform(prepared).withColumnRenamed("prediction", "log_pred")
        return scored.withColumn("pred_price", F.expm1("log_pred"))

    def importances(self) -> DataFrame:
        """Split-gain share of every model input, largest first."""
        weights = self.pipeline.stages[-1].featureImportances.toArray()
        rows = [(n, float(w)) for n, w in zip(self.inputs, weights)]
        spark = SparkSession.active()
        table = spark.createDataFrame(rows, "feature string, importance double")
        return table.orderBy(F.desc("importance"), "feature")


def fit(
    train: DataFrame,
    params: GbmParams = GbmParams(),
    features: FeatureParams = FeatureParams(),
) -> GlobalModel:
    """Fit on prepared rows with a label; the item enters by :func:`encode_items`."""
    ensure_checkpoint_dir(train.sparkSession)
    rows = train.where(F.col(LABEL).isNotNull())
    inputs = [
        *feature_names(features, params.extra_features),
        "is_missing",
        *(["is_missing_extra"] if params.extra_features else []),
        ITEM_ENCODING,
    ]
    stages = [
        VectorAssembler(inputCols=inputs, outputCol="features"),
        GBTRegressor(
            labelCol=LABEL,
            featuresCol="features",
            maxIter=params.rounds,
            stepSize=params.learning_rate,
            maxDepth=params.max_depth,
            minInstancesPerNode=params.min_child_samples,
            featureSubsetStrategy=str(params.feature_fraction),
            subsamplingRate=params.subsample,
            maxBins=BINS,
            checkpointInterval=10,
            seed=params.seed,
        ),
    ]
    return GlobalModel(Pipeline(stages=stages).fit(rows), tuple(inputs))


def validation_predictions(model: GlobalModel, prepared: DataFrame) -> DataFrame:
    """``item, week, forecast_week, y, y_hat`` with the log values, where the target is known."""
    return model.predict(prepared.where(F.col(LABEL).isNotNull())).select(
        "item",
        "week",
        F.col("target_week").alias("forecast_week"),
        F.col("next_week_unit_price").alias("y"),
        F.col("pred_price").alias("y_hat"),
        F.col(LABEL).alias("log_y"),
        F.col("log_pred").alias("log_hat"),
    )


def score_next_week(model: GlobalModel, prepared: DataFrame, reference_week: Column) -> DataFrame:
    """Predicted price of the week after the reference week."""
    return model.predict(prepared.where(F.col("week") == reference_week)).select(
        "item", F.date_add("week", 7).alias("forecast_week_start"), "pred_price"
    )


def overall_metrics(predictions: DataFrame) -> DataFrame:
    measures = prediction_metrics(F.col("y"), F.col("y_hat"))
    measures["rmse_log"] = log_rmse(F.col("log_y"), F.col("log_hat"))
    return predictions.agg(*[c.alias(m) for m, c in measures.items()])


def yearly_cv(
    prepared: DataFrame,
    first_train_year: int,
    folds: int = 5,
    params: GbmParams = GbmParams(),
    features: FeatureParams = FeatureParams(),
    parallelism: int = 5,
) -> DataFrame:
    """Expanding yearly folds: train through year Y, validate on year Y + 1.

    ``prepared`` feeds every fold, see :func:`training_table`. The fits are independent Spark
    ML jobs; up to ``parallelism`` are submitted side by side, as Spark's own cross-validator
    does, so that the many short jobs of one fit leave no executor idle.
    """

    def train(year: int) -> GlobalModel:
        return fit(until(prepared, f"{year}-12-31"), params, features)

    years = range(first_train_year, first_train_year + folds)
    with ThreadPool(parallelism) as pool:
        models = pool.map(inheritable_thread_target(prepared.sparkSession)(train), years)
    parts = []
    for year, model in zip(years, models):
        held = between(prepared, f"{year + 1}-01-01", f"{year + 1}-12-31")
        metrics = overall_metrics(validation_predictions(model, held))
        parts.append(metrics.select(F.lit(year + 1).alias("fold_year"), "*"))
    return reduce(DataFrame.unionByName, parts)


def cv_summary(fold_metrics: DataFrame) -> DataFrame:
    """Plain mean of the fold metrics."""
    return fold_metrics.agg(
        F.count("*").alias("folds"),
        *[F.avg(m).alias(m) for m in ("wape", "smape", "mae", "rmse_log")],
    )
