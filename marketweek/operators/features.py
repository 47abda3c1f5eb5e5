"""Leakage-safe weekly features.

All window expressions share one partition and order, so Spark plans one exchange and one
sort for the lags, rolling statistics, volatility and targets together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweek.functions.scalar import calendar, relative_change
from marketweek.operators.weekly import item_order
from marketweek.params import FeatureParams


def with_logs(weekly: DataFrame) -> DataFrame:
    return weekly.withColumns(
        {"log_price": F.log1p("unit_price_week"), "log_qty": F.log1p("qty_in_week")}
    )


def lag_columns(column: str, lags: tuple[int, ...]) -> dict[str, Column]:
    return {f"{column}_lag{k}": F.lag(column, k).over(item_order()) for k in lags}


def rolling_columns(column: str, windows: tuple[int, ...]) -> dict[str, Column]:
    """Mean and sample deviation of the ``w`` rows before the current one, full windows only."""
    out = {}
    for w in windows:
        past = item_order().rowsBetween(-w, -1)
        full = F.count(column).over(past) == w
        out[f"{column}_rollmean{w}"] = F.when(full, F.avg(column).over(past))
        out[f"{column}_rollstd{w}"] = F.when(full, F.stddev_samp(column).over(past))
    return out


def yoy_columns(column: str) -> dict[str, Column]:
    return {f"{column}_yoy_gap": F.col(column) - F.lag(column, 52).over(item_order())}


def with_price_change(weekly: DataFrame) -> DataFrame:
    """Week-over-week change of the price; a missing price gives NULL on both sides."""
    price = F.col("unit_price_week")
    return weekly.withColumn(
        "price_change", relative_change(price, F.lag(price, 1).over(item_order()))
    )


def volatility_columns(windows: tuple[int, ...]) -> dict[str, Column]:
    out = {}
    for w in windows:
        past = item_order().rowsBetween(-w, -1)
        full = F.count("price_change").over(past) == w
        out[f"price_vol_{w}"] = F.when(full, F.stddev_samp("price_change").over(past))
    return out


def target_columns() -> dict[str, Column]:
    return {
        "next_week_unit_price": F.lead("unit_price_week", 1).over(item_order()),
        "next_week_log_price": F.lead("log_price", 1).over(item_order()),
    }


def weekly_features(weekly: DataFrame, params: FeatureParams = FeatureParams()) -> DataFrame:
    """The full feature table: logs, lags, rolling, gaps, volatility, calendar, targets."""
    columns: dict[str, Column] = {}
    for name in ("log_price", "log_qty"):
        columns |= lag_columns(name, params.lags)
        columns |= rolling_columns(name, params.windows)
        columns |= yoy_columns(name)
    columns |= volatility_columns(params.vol_windows)
    columns |= target_columns()
    columns["target_week"] = F.lead("week", 1).over(item_order())
    return calendar(with_price_change(with_logs(weekly)).withColumns(columns))


def recent_supply(weekly: DataFrame, weeks: int = 4) -> DataFrame:
    """Mean quantity of the current and the preceding weeks, as many as there are."""
    near = item_order().rowsBetween(-(weeks - 1), 0)
    return weekly.withColumn(f"qty_rollmean{weeks}", F.avg("qty_in_week").over(near))
