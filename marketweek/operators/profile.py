"""Profiles of the weekly table: coverage, price spread, supply effect, quality."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def preview(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """The first rows of a result in its report order."""
    return df.orderBy(*order).limit(n)


def top_items(weekly: DataFrame, n: int) -> DataFrame:
    """Items with the largest total amount; names break ties."""
    return (
        weekly.groupBy("item")
        .agg(F.sum("amount_week").alias("total_amount"))
        .orderBy(F.desc("total_amount"), "item")
        .limit(n)
    )


def restrict(df: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of the listed items."""
    return df.join(items.select("item"), "item", "left_semi")


def first_items(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` items in order of appearance, given the source order columns."""
    return (
        df.groupBy("item")
        .agg(F.min(F.struct(*order)).alias("first_seen"))
        .orderBy("first_seen", "item")
        .limit(n)
    )


def coverage(weekly: DataFrame) -> DataFrame:
    """Share of all traded weeks in which the item was traded.

    The number of weeks is one scalar, so the item-by-week grid never exists.
    """
    all_weeks = weekly.select(F.count_distinct("week").alias("weeks_total")).scalar()
    return (
        weekly.groupBy("item")
        .agg(F.count("qty_in_week").alias("weeks_traded"))
        .withColumn("weeks_total", all_weeks)
        .withColumn("coverage", F.col("weeks_traded") / F.col("weeks_total"))
    )


def coverage_grid(weekly: DataFrame, items: DataFrame) -> DataFrame:
    """0/1 trade flag for every listed item and every week, for a heat map.

    One item's traded weeks and the list of all weeks are both bounded by the calendar;
    the grid grows only with the listed items.
    """
    all_weeks = weekly.select(F.array_sort(F.collect_set("week"))).scalar()
    traded = (
        restrict(weekly, items)
        .groupBy("item")
        .agg(F.collect_set(F.when(F.col("qty_in_week").isNotNull(), F.col("week"))).alias("_w"))
    )
    return traded.select("item", "_w", F.explode(all_weeks).alias("week")).select(
        "item", "week", F.array_contains("_w", F.col("week")).cast("int").alias("traded")
    )


def price_box(weekly: DataFrame) -> DataFrame:
    """Box statistics of the weekly price per item.

    Exact percentiles: the group is one item's weeks, bounded by the calendar.
    """
    p = F.col("unit_price_week")
    q = F.percentile(p, [0.25, 0.5, 0.75])
    stats = weekly.groupBy("item").agg(
        F.count(p).alias("n"),
        F.min(p).alias("min_price"),
        q.alias("_q"),
        F.max(p).alias("max_price"),
    )
    q1, q3 = F.col("_q")[0], F.col("_q")[2]
    return stats.select(
        "item",
        "n",
        "min_price",
        q1.alias("q1"),
        F.col("_q")[1].alias("median"),
        q3.alias("q3"),
        "max_price",
        (q1 - 1.5 * (q3 - q1)).alias("low_fence"),
        (q3 + 1.5 * (q3 - q1)).alias("high_fence"),
    )


def price_outliers(weekly: DataFrame) -> DataFrame:
    """Item-weeks outside the fences of :func:`price_box`."""
    box = price_box(weekly).select("item", "low_fence", "high_fence")
    p = F.col("unit_price_week")
    return weekly.join(box, "item").where((p < F.col("low_fence")) | (p > F.col("high_fence")))


def qty_price_relation(weekly: DataFrame) -> DataFrame:
    """Correlation and slope of price on quantity, per item and overall (item NULL)."""
    q, p = F.col("qty_in_week"), F.col("unit_price_week")
    pairs = weekly.where(q.isNotNull() & p.isNotNull())
    return pairs.groupingSets([["item"], []], "item").agg(
        F.count("*").alias("n"),
        F.corr(q, p).alias("corr"),
        F.regr_slope(p, q).alias("slope"),
        F.grouping("item").cast("int").alias("is_total"),
    )


def quality(weekly: DataFrame) -> DataFrame:
    """Counts of non-positive sums, missing prices and year-boundary weeks per item."""
    week = F.col("week")
    return weekly.groupBy("item").agg(
        F.count("*").alias("weeks"),
        F.count_if(F.col("qty_in_week") <= 0).alias("nonpositive_qty"),
        F.count_if(F.col("amount_week") <= 0).alias("nonpositive_amount"),
        F.count_if(F.col("unit_price_week").isNull()).alias("null_price"),
        F.count_if(F.year(week) != F.year(F.date_add(week, 6))).alias("boundary_weeks"),
    )


def yearly_curves(weekly: DataFrame) -> DataFrame:
    """Mean price per item, ISO year and ISO week, as drawn by year-over-year charts."""
    return (
        weekly.where(F.col("unit_price_week").isNotNull())
        .groupBy(
            "item",
            F.extract(F.lit("YEAROFWEEK"), F.col("week")).alias("iso_year"),
            F.weekofyear("week").alias("iso_week"),
        )
        .agg(F.avg("unit_price_week").alias("mean_price"))
    )


#: Replicates that one digest of a row serves: 16 bits each.
DRAWS = 8
#: Chances of at most 0, 1, 2, ... draws of a row in a Poisson sample with mean 1, in 65536ths.
POISSON = tuple(
    math.floor(65536 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(n + 1))) for n in range(9)
)


def draw_seeds(key: Column, replicates: int) -> Column:
    """Four hexadecimal digits a replicate from the digests of a row's ``key``: the same in any
    order of the rows and on any partitioning."""
    digests = F.concat(*[
        F.md5(F.concat(key, F.lit(f"|{block}")).cast("binary")) for block in range(math.ceil(replicates / DRAWS))
    ])
    # One pass over the digests; a lambda would work them out anew for every replicate.
    return F.slice(F.regexp_extract_all(digests, F.lit("(....)"), 1), 1, replicates)


def poisson_draws(seed: Column) -> Column:
    """How often a row is drawn, by its four digits."""
    uniform = F.conv(seed, 16, 10).cast("int")
    return sum((uniform >= F.lit(t)).cast("int") for t in POISSON)


def bootstrap_band(
    rows: DataFrame, by: Sequence[str], value: str, row_key: Column, replicates: int = 64, level: float = 0.95,
    decimals: int = 4,
) -> DataFrame:
    """Mean of ``value`` per group with the band of its bootstrap means, as line charts draw it.

    A Poisson bootstrap: in each replicate a row counts as often as its own draw says, so no row
    has to know of others and replicates combine inside the scan tasks. ``row_key`` is the text
    that names a row; it seeds the draws. Values are summed as integers of ``decimals`` places,
    so rows come out the same at any partitioning. Null values take no part; a replicate that
    draws no row of a group has no mean there; an empty table gives no rows.
    """
    units = F.floor(F.col(value) * 10**decimals + 0.5)
    keyed = rows.where(F.col(value).isNotNull()).select(
        *by, units.alias("_units"), row_key.alias("_key")
    )
    # Replicate 0 holds every row once: the mean itself.
    seeds = F.concat(F.array(F.lit("")), F.col("_seeds"))
    every = (
        keyed.withColumn("_seeds", draw_seeds(F.col("_key"), replicates))
        .select(*by, "_units", F.posexplode(seeds).alias("_replicate", "_seed"))
        .withColumn("_draws", F.when(F.col("_replicate") == 0, 1).otherwise(poisson_draws(F.col("_seed"))))
        .where("_draws > 0")
    )
    sums = every.groupBy(*by, "_replicate").agg(
        F.sum(F.col("_units") * F.col("_draws")).alias("_sum"), F.sum("_draws").alias("_n")
    )
    mean = F.col("_sum") / F.col("_n") / 10**decimals
    resampled = F.when(F.col("_replicate") > 0, mean)
    tail = (1 - level) / 2
    return sums.groupBy(*by).agg(
        F.max(F.when(F.col("_replicate") == 0, F.col("_n"))).alias("n"),
        F.max(F.when(F.col("_replicate") == 0, mean)).alias("mean"),
        F.percentile(resampled, F.lit(tail)).alias("low"),
        F.percentile(resampled, F.lit(1 - tail)).alias("high"),
    )


def lagged_correlation(
    weekly: DataFrame, weather: DataFrame, variable: str, max_lag: int = 8
) -> DataFrame:
    """Correlation of log price with a weather variable ``k`` calendar weeks earlier.

    The panel collapses to counts, sums and squares per week before it meets the shifted
    weather, so the lags multiply calendar weeks, not item-weeks. The weather is centred
    to keep the sums of squares exact enough.
    """
    shifted = weather.select(
        F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"),
        F.col("week").alias("_w"),
        (F.col(variable) - weather.select(F.avg(variable)).scalar()).alias("_x"),
    ).select("lag", F.date_add("_w", (F.col("lag") * 7).cast("int")).alias("week"), "_x")
    y = F.log1p("unit_price_week")
    weeks = weekly.where(y.isNotNull()).groupBy("week").agg(
        F.count("*").alias("_n"), F.sum(y).alias("_y"), F.sum(y * y).alias("_yy")
    )
    x, n = F.col("_x"), F.sum("_n")
    sx, sy = F.sum(F.col("_n") * x), F.sum("_y")
    spread_x = n * F.sum(F.col("_n") * x * x) - sx * sx
    spread_y = n * F.sum("_yy") - sy * sy
    both = n * F.sum(F.col("_y") * x) - sx * sy
    return weeks.join(shifted.where("_x is not null"), "week").groupBy("lag").agg(
        n.alias("n"), F.try_divide(both, F.sqrt(spread_x * spread_y)).alias("corr")
    )
