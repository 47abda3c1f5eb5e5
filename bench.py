"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from marketweek.session import configured  # noqa: E402
from suite import catalog  # noqa: E402

HEADLINES = [
    "weekly_agg",
    "price_box",
    "coverage",
    "weather_join",
    "rolling",
    "price_vol",
    "spine_fill",
    "leaderboard",
    "forecast_selected",
    "hw_forecast",
    "leaderboard_all_models",
    "forecast_all_models",
    "val_metrics_gs",
    "improvement",
    "substitutes",
    "gbm_val",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = configured(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
    spark = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        # The panels are small here: keep several tasks instead of merging them into one.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and the Python workers' one-time work outside the measurement.
    catalog.QUERIES["hw_forecast"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    only = sys.argv[1:] or HEADLINES
    seconds = {}
    for name in only:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(Path(sf_dir).name.removeprefix("sf")),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
