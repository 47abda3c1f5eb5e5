"""Outputs: parquet stages, CSV reports, fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str, partition_by_year: bool = False) -> None:
    """Overwrite a stage table; by year it allows pruning on later reads."""
    if not partition_by_year:
        df.write.mode("overwrite").parquet(path)
        return
    # The rebalance hint sizes the files by data volume: large years are split over several
    # tasks, small ones are merged, instead of one small file per task and year.
    by_year = df.withColumn("week_year", F.year("week")).hint("rebalance", "week_year")
    by_year.write.mode("overwrite").partitionBy("week_year").parquet(path)


def write_report(df: DataFrame, path: str, enabled: bool = True) -> bool:
    """CSV with a header, behind a flag; returns whether it was written."""
    if enabled:
        df.write.mode("overwrite").option("header", True).csv(path)
    return enabled


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
