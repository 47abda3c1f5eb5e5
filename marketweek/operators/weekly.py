"""Weekly aggregation of transactions and weather, and the panel of targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketweek.functions.scalar import (
    coerce_numeric,
    guarded_unit_price,
    iso_week_start,
    plain_unit_price,
    require_columns,
    week_of,
)


def item_order() -> WindowSpec:
    """One item's weeks in order. The weekly tables hold one row per item and week, so a
    partition of this window grows with the calendar (52 rows a year), never with the
    transactions."""
    return Window.partitionBy("item").orderBy("week")


def _total(column: str, decimals: int | None) -> Column:
    """Sum; with ``decimals`` as integers of the smallest unit, so that any order of
    addition gives the same double."""
    if decimals is None:
        return F.sum(column)
    unit = 10**decimals
    whole = F.floor(F.col(column) * unit + 0.5)
    return F.sum(whole).cast("double") / F.lit(float(unit))


def weekly_agg(transactions: DataFrame, decimals: int | None = None) -> DataFrame:
    """``item, week, qty_in_week, amount_week, unit_price_week``.

    Sums combine inside the scan tasks, so a hot item leaves each task as one row per week.
    """
    sums = transactions.groupBy("item", week_of(F.col("date")).alias("week")).agg(
        _total("qty_in", decimals).alias("qty_in_week"),
        _total("amount", decimals).alias("amount_week"),
    )
    return with_unit_price(sums)


def with_unit_price(sums: DataFrame) -> DataFrame:
    return sums.withColumn(
        "unit_price_week", guarded_unit_price(F.col("amount_week"), F.col("qty_in_week"))
    )


def apply_aliases(weekly: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rename items to their canonical names and add their weeks up.

    Works on the weekly sums, not on transactions: a hot item is already one row per week
    when it meets the alias table. An alias listed more than once counts once, with the first
    of its canonical names in order.
    """
    aliases = aliases.groupBy("alias").agg(F.min("canonical").alias("canonical"))
    named = weekly.join(aliases, F.col("item") == F.col("alias"), "left").select(
        F.coalesce("canonical", "item").alias("item"), "week", "qty_in_week", "amount_week"
    )
    return with_unit_price(
        named.groupBy("item", "week").agg(
            F.sum("qty_in_week").alias("qty_in_week"), F.sum("amount_week").alias("amount_week")
        )
    )


# Weather variables that are summed over a week; all others are averaged.
SUMMED_WEATHER = ("precip", "sunshine", "radiation")
# end of fixed values


def weather_weekly(weather: DataFrame, summed: tuple[str, ...] = SUMMED_WEATHER) -> DataFrame:
    """Daily weather to ISO weeks, with the same Monday key as the sales."""
    variables = [c for c in weather.columns if c != "date"]
    return weather.groupBy(week_of(F.col("date")).alias("week")).agg(
        *[(F.sum(v) if v in summed else F.avg(v)).alias(v) for v in variables]
    )


def join_weather(panel: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather of the week on every item-week; unmatched weeks stay NULL.

    ``weather`` has one row per week; Spark broadcasts it while its measured size allows.
    """
    return panel.join(weather, "week", "left")


@dataclass(frozen=True)
class PanelColumns:
    """Column names of a weekly input file."""

    # Names used by the weekly files.
    item: str = "품목명"
    year: str = "연도"
    week: str = "주차"
    price: str = "주간_평균단가"
    amount: str = "금액_합"
    qty: str = "반입량_합"
    other_numeric: tuple[str, ...] = ("금액", "반입량")
    # end of fixed values


def panel_base(df: DataFrame, cols: PanelColumns = PanelColumns()) -> DataFrame:
    """Weekly file to ``item, week, target``: one averaged row per item and ISO week.

    The target is the given weekly price if the file has one, else amount over quantity.
    """
    require_columns(df, [cols.item, cols.year, cols.week])
    numeric = (cols.price, cols.amount, cols.qty, cols.year, cols.week, *cols.other_numeric)
    clean = coerce_numeric(df, numeric)
    if cols.price in df.columns:
        target = F.col(cols.price)
    else:
        require_columns(df, [cols.amount, cols.qty])
        target = plain_unit_price(F.col(cols.amount), F.col(cols.qty))
    rows = clean.select(
        F.col(cols.item).alias("item"),
        iso_week_start(F.col(cols.year), F.col(cols.week)).alias("week"),
        target.alias("target"),
    )
    return (
        rows.dropna(subset=["item", "week", "target"])
        .groupBy("item", "week")
        .agg(F.avg("target").alias("target"))
    )


def target_panel(weekly: DataFrame) -> DataFrame:
    """``item, week, target`` from a weekly aggregate, which is already unique by key."""
    return weekly.select("item", "week", F.col("unit_price_week").alias("target")).dropna()


def fill_weeks(weekly: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Gap-free weeks per item, carrying the last known values forward.

    Each row emits itself and the missing weeks up to its successor, so no calendar table
    and no join is needed; ``is_filled`` marks the added rows.
    """
    following = F.coalesce(F.lead("week").over(item_order()), F.date_add("week", 7))
    carried = {c: F.last(c, ignorenulls=True).over(item_order()) for c in columns}
    spans = weekly.select(
        "item",
        "week",
        *[carried[c].alias(c) for c in columns],
        F.sequence(
            "week", F.date_sub(following, 7), F.expr("interval 7 days")
        ).alias("_weeks"),
    )
    return spans.select(
        "item",
        F.explode("_weeks").alias("_w"),
        *columns,
        F.col("week").alias("_own"),
    ).select(
        "item", F.col("_w").alias("week"), *columns, (F.col("_w") != F.col("_own")).alias("is_filled")
    )


def week_runs(weekly: DataFrame) -> DataFrame:
    """Longest run of consecutive weeks per item."""
    island = F.date_sub("week", (F.row_number().over(item_order()) * 7).cast("int"))
    runs = (
        weekly.select("item", island.alias("island"))
        .groupBy("item", "island")
        .agg(F.count("*").alias("weeks"))
    )
    return runs.groupBy("item").agg(
        F.max("weeks").alias("longest_run"), F.count("*").alias("runs")
    )
