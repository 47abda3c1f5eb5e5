"""Cheaper, well supplied and stable substitutes within an item group.

Saving is ``(own - candidate) / own`` on next week's predicted price, so within a group the
best candidates of every item are simply the cheapest eligible ones: one short list per
group (``top_k`` and one spare, in case the item itself is on it) serves all its items. The
result equals ranking all pairs of a group, without forming them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweek.functions.quantiles import grouped_quantiles
from marketweek.functions.skew import salted_join
from marketweek.operators.features import recent_supply, volatility_columns, with_price_change
from marketweek.params import SUPPLY_WEEKS, SubstituteParams


def rule_params(table: DataFrame) -> SubstituteParams:
    """Read the one-row parameter table; absent values keep their defaults."""
    row = table.first()
    given = {} if row is None else {k: v for k, v in row.asDict().items() if v is not None}
    return SubstituteParams(**given)


def item_state(weekly: DataFrame, reference_week: Column | None = None) -> DataFrame:
    """Every item at the reference week: price, recent supply, recent volatility.

    The reference week is the latest of the table unless given; items without a row in
    that week are left out.
    """
    if reference_week is None:
        reference_week = weekly.select(F.max("week")).scalar()
    state = recent_supply(with_price_change(weekly), SUPPLY_WEEKS).withColumns(
        volatility_columns((8,))
    )
    return state.where(F.col("week") == reference_week).select(
        "item", "week", "unit_price_week", f"qty_rollmean{SUPPLY_WEEKS}", "price_vol_8"
    )


def grouped_state(state: DataFrame, predictions: DataFrame, groups: DataFrame) -> DataFrame:
    """Reference-week state with the predicted price and the item group."""
    return state.join(predictions.select("item", "pred_price"), "item").join(
        groups.select("item", "grp"), "item"
    )


def group_thresholds(
    grouped: DataFrame, params: SubstituteParams = SubstituteParams()
) -> DataFrame:
    """Supply median and upper volatility quartile per group, exact for groups of any size."""
    return grouped_quantiles(
        grouped,
        ["grp"],
        {
            "supply_median": (f"qty_rollmean{SUPPLY_WEEKS}", params.supply_quantile),
            "vol_q3": ("price_vol_8", params.volatility_quantile),
        },
    )


def shortlist(grouped: DataFrame, thresholds: DataFrame, params: SubstituteParams) -> DataFrame:
    """The cheapest eligible candidates per group, as one array of ``top_k + 1`` entries.

    The rank limit is applied inside each task before the exchange, so a hot group ships a
    handful of rows per task.
    """
    eligible = salted_join(grouped, thresholds, ["grp"], ["item"]).where(
        (F.col(f"qty_rollmean{SUPPLY_WEEKS}") >= F.col("supply_median"))
        & (F.col("price_vol_8") <= F.col("vol_q3"))
        & F.col("pred_price").isNotNull()
    )
    cheapest = Window.partitionBy("grp").orderBy("pred_price", "price_vol_8", "item")
    top = (
        eligible.select("grp", "item", "pred_price", "price_vol_8")
        .withColumn("_r", F.row_number().over(cheapest))
        .where(F.col("_r") <= params.top_k + 1)
    )
    entry = F.struct(
        "_r",
        F.col("item").alias("candidate"),
        F.col("pred_price").alias("candidate_price"),
        F.col("price_vol_8").alias("candidate_vol"),
    )
    return top.groupBy("grp").agg(F.array_sort(F.collect_list(entry)).alias("_list"))


def substitutes(
    grouped: DataFrame, params: SubstituteParams = SubstituteParams(), thresholds: DataFrame | None = None
) -> DataFrame:
    """``top_k`` substitutes per item, by saving, then lower volatility, then name.

    An item in several groups has one list; a substitute found in several of them stands there
    once, with the first group in order. One shuffle on the item serves both steps.
    """
    limits = group_thresholds(grouped, params) if thresholds is None else thresholds
    lists = shortlist(grouped, limits, params)
    own = F.col("pred_price")

    def saving(candidate: Column) -> Column:
        return (own - candidate["candidate_price"]) / own

    good = F.filter(
        "_list",
        lambda c: (c["candidate"] != F.col("item"))
        & (saving(c) >= params.price_discount_threshold),
    )
    found = (
        salted_join(grouped.where(own > 0), lists, ["grp"], ["item"])
        .select("grp", "item", "pred_price", "price_vol_8", F.explode(F.slice(good, 1, params.top_k)).alias("_c"))
        .select(
            "grp",
            "item",
            F.col("_c.candidate").alias("substitute"),
            F.col("_c.candidate_price").alias("_price"),
            ((own - F.col("_c.candidate_price")) / own).alias("saving_rate"),
            F.col("_c.candidate_vol").alias("price_vol_8"),
            F.col("price_vol_8").alias("own_vol_8"),
        )
        .repartition("item")
    )
    copies = Window.partitionBy("item", "substitute").orderBy("grp")
    once = found.withColumn("_copy", F.row_number().over(copies)).where("_copy = 1")
    best_first = Window.partitionBy("item").orderBy("_price", "price_vol_8", "substitute")
    return (
        once.withColumn("rank", F.row_number().over(best_first))
        .where(F.col("rank") <= params.top_k)
        .select("grp", "item", "rank", "substitute", "saving_rate", "price_vol_8", "own_vol_8")
    )


def recommendation_kpis(
    grouped: DataFrame, suggestions: DataFrame, feedback: DataFrame | None = None
) -> DataFrame:
    """One row: coverage, mean saving, stability and acceptance, all in percent.

    Stability is the share of suggestions that vary no more than the item they replace.
    Acceptance needs a feedback table ``item, substitute, accepted``; without it, NULL.
    """
    items = grouped.select(F.count("*").alias("items"))
    facts = suggestions
    if feedback is not None:
        facts = facts.join(
            feedback.select("item", "substitute", F.col("accepted").cast("int").alias("_a")),
            ["item", "substitute"],
            "left",
        )
    else:
        facts = facts.withColumn("_a", F.lit(None).cast("int"))
    # Two steps instead of a distinct count: one row per item first.
    per_item = facts.groupBy("item").agg(
        F.count("*").alias("n"),
        F.sum("saving_rate").alias("saving"),
        F.count_if(F.col("price_vol_8") <= F.col("own_vol_8")).alias("stable"),
        F.sum("_a").alias("accepted"),
        F.count("_a").alias("asked"),
    )
    totals = per_item.agg(
        F.count("*").alias("covered"),
        F.sum("n").alias("n"),
        F.sum("saving").alias("saving"),
        F.sum("stable").alias("stable"),
        F.sum("accepted").alias("accepted"),
        F.sum("asked").alias("asked"),
    )
    return totals.select(
        (F.try_divide(F.col("covered"), items.scalar()) * 100).alias("coverage_pct"),
        (F.try_divide("saving", "n") * 100).alias("mean_saving_pct"),
        (F.try_divide("stable", "n") * 100).alias("stability_pct"),
        (F.try_divide("accepted", "asked") * 100).alias("acceptance_pct"),
    )
