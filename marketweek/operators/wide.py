"""Wide daily price files and cleaned series per cluster or item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweek.functions.scalar import (
    coerce_numeric,
    not_sunday,
    positive_or_null,
    present_columns,
    require_columns,
)


def wide_to_long(wide: DataFrame, products: list[str] | None = None) -> DataFrame:
    """``date, item, price``; listed products the file lacks are left out."""
    names = [c for c in wide.columns if c != "date"]
    if products is not None:
        names = [c for c in present_columns(wide, products) if c != "date"]
    return wide.unpivot(["date"], names, "item", "price")


def drop_sundays(df: DataFrame) -> DataFrame:
    return df.where(not_sunday(F.col("date")))


def cluster_series(wide: DataFrame, clusters: DataFrame) -> DataFrame:
    """Daily prices of every cluster's members: no Sundays, non-positive prices NULL.

    Items without a cluster drop out. Filter and projection run before the join.
    """
    long = wide_to_long(drop_sundays(wide)).withColumn("price", positive_or_null(F.col("price")))
    return long.join(clusters.select("item", "cluster"), "item")


def clean_series(
    df: DataFrame,
    items: list[str] | DataFrame | None = None,
    item_col: str = "품목명",
    year_col: str = "연도",
    week_col: str = "주차",
    price_col: str = "주간_평균단가",
) -> DataFrame:
    """Typed rows without NULLs, of the named items, of a table of items, or of all."""
    require_columns(df, [item_col, year_col, week_col, price_col])
    rows = coerce_numeric(
        df.select(item_col, year_col, week_col, price_col), [year_col, week_col, price_col]
    ).select(
        F.col(item_col).alias("item"),
        F.col(year_col).cast("int").alias("year"),
        F.col(week_col).cast("int").alias("week_no"),
        F.col(price_col).alias("price"),
    )
    rows = rows.dropna()
    if isinstance(items, DataFrame):
        return rows.join(items.select("item"), "item", "left_semi")
    return rows if items is None else rows.where(F.col("item").isin(items))
