"""The star-schema tables in the roles of the pipeline's inputs.

Transactions are line items (item: part name, group: its second word), daily outside
variables come from orders, ingredient attributes from parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweek.operators.weekly import target_panel, weekly_agg
from marketweek.session import materialise

# The second words of the part names, for the comparison SQL and the made-up cluster file; the
# wide file takes its columns from the data, so a further group would show.
GROUPS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
CENTS = 2


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def second_word(name: str) -> Column:
    return F.split_part(F.col(name), F.lit(" "), F.lit(2))


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    """``item, date, qty_in, amount``.

    The join carries no hint: Spark broadcasts ``part`` only while its measured size is
    under the threshold, and otherwise shuffles with skewed partitions split at run time.
    """
    lines = table(spark, sf, "lineitem").select(
        "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_name").alias("item"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_quantity").alias("qty_in"),
        F.col("l_extendedprice").alias("amount"),
    )


def weekly(spark: SparkSession, sf: str) -> DataFrame:
    return weekly_agg(transactions(spark, sf), decimals=CENTS)


def stored_weekly(spark: SparkSession, sf: str) -> DataFrame:
    """The weekly aggregate as a stage table, for plans that read it several times: the
    transactions are then scanned once."""
    return materialise(weekly(spark, sf))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return target_panel(weekly(spark, sf))


def weather_daily(spark: SparkSession, sf: str) -> DataFrame:
    """``date, precip, tmax``: a summed and an averaged variable per day."""
    cents = F.sum(F.floor(F.col("o_totalprice") * 100 + 0.5)).cast("double") / 100.0
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("date"))
        .agg(cents.alias("precip"), (cents / F.count("*")).alias("tmax"))
    )


def wide_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Daily mean price, one column per group."""
    rows = transactions(spark, sf).select(
        "date", second_word("item").alias("grp"), (F.col("amount") / F.col("qty_in")).alias("p")
    )
    return rows.groupBy("date").pivot("grp").agg(F.avg("p"))


def item_groups(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "part")
        .select(F.col("p_name").alias("item"), second_word("p_name").alias("grp"))
        .distinct()
    )


def ingredients(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as ingredients: quantity, category, colour, three flags, cluster."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("item"),
        F.log1p("p_retailprice").alias("log_qty"),
        F.col("p_size").cast("double").alias("size"),
        F.col("p_type").alias("category"),
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("colour"),
        (F.col("p_size") > 25).cast("int").alias("starchy"),
        F.col("p_type").contains("BRASS").cast("int").alias("eaten_raw"),
        F.col("p_name").contains("hot").cast("int").alias("spice"),
        F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).cast("int").alias("cluster"),
    )


def r4(column: Column | str) -> Column:
    """Four decimals, by a rule every engine evaluates alike.

    Averages of cents often end in an exact half of the last digit, where the order of a
    sum decides; the boundary therefore lies slightly beside the half.
    """
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c * 1e4 + 0.5013) / F.lit(1e4)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r4(c) for c in columns})
