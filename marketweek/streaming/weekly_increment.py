"""Incremental form of the weekly batch: only transaction files that arrived since the last
run are read, and the weekly sums absorb them.

Sums add up across runs, so each run stores its own partial sums under its batch number.
A run that is repeated after a failure overwrites its own part and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from marketweek.operators.weekly import weekly_agg, with_unit_price
from marketweek.sources.readers import standardise_transactions


def absorb_new_files(
    spark: SparkSession, source: str, schema: StructType, parts: str, checkpoint: str
) -> StreamingQuery:
    """Process all files not seen before, then stop. ``checkpoint`` remembers them."""

    def store(batch: DataFrame, batch_id: int) -> None:
        sums = weekly_agg(batch).drop("unit_price_week")
        sums.write.mode("overwrite").parquet(f"{parts}/batch={batch_id}")

    arrived = spark.readStream.schema(schema).option("header", True).csv(source)
    return (
        standardise_transactions(arrived)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def weekly_from_parts(spark: SparkSession, parts: str) -> DataFrame:
    """The weekly aggregate over everything absorbed so far."""
    sums = spark.read.parquet(parts)
    return with_unit_price(
        sums.groupBy("item", "week").agg(
            F.sum("qty_in_week").alias("qty_in_week"), F.sum("amount_week").alias("amount_week")
        )
    )
