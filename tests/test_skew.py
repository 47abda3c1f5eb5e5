"""Hot keys: one key holds a large share of the rows, results stay whole."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from marketweek.functions.skew import salted_join
from suite import adapters


@contextmanager
def conf(spark, **values):
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot_tables(spark, tmp_path_factory):
    """Line items of which a third belong to one part."""
    folder = str(tmp_path_factory.mktemp("hot"))
    row = F.col("id")
    lines = spark.range(0, 300_000, numPartitions=8).select(
        F.when(row % 3 == 0, 0).otherwise(row % 5000).alias("l_partkey"),
        (row % 50 + 1).cast("double").alias("l_quantity"),
        (row % 977 + 0.25).alias("l_extendedprice"),
        F.timestamp_add("DAY", (row % 700).cast("int"), F.lit("1996-01-01").cast("timestamp_ntz")).alias("l_shipdate"),
    )
    lines.write.parquet(f"{folder}/lineitem.parquet")
    spark.range(5000).select(
        row.alias("p_partkey"), F.concat(F.lit("word item"), row % 100).alias("p_name")
    ).write.parquet(f"{folder}/part.parquet")
    return folder


def test_shuffled_transaction_join_is_split_at_run_time(spark, hot_tables):
    with conf(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20k",
        spark__sql__shuffle__partitions="16",
    ):
        shuffled = adapters.weekly(spark, hot_tables)
        one = sorted(shuffled.collect())
        assert "SortMergeJoin(skew=true)" in shuffled._jdf.queryExecution().executedPlan().toString()
    broadcast = adapters.weekly(spark, hot_tables)
    two = sorted(broadcast.collect())
    assert "BroadcastHashJoin" in broadcast._jdf.queryExecution().executedPlan().toString()
    assert one == two


def test_salted_join_keeps_all_rows_and_spreads_them(spark):
    left = spark.range(50_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise("cold").alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("cold", 2), ("none", 3)], "k string, v int")
    with conf(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__shuffle__partitions="16",
              spark__sql__adaptive__coalescePartitions__enabled="false"):
        joined = salted_join(left, right, ["k"], ["id"])
        assert joined.columns == ["k", "id", "v"]
        sizes = [r.n for r in joined.where("k = 'hot'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 25_000 and max(sizes) < 25_000 / 3
        assert joined.where("k = 'cold' and v = 2").count() == 25_000
