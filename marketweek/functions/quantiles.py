"""Exact quantiles of groups of any size, by distributed selection.

The built-in exact percentile keeps every distinct value of a group in one buffer. That is
fine for the weeks of one item, but a group of items has no such bound. Here a group is cut at
a fixed number of points, values are counted between them, and the search goes on only between
the points that hold the wanted ranks, until few distinct values are left. Every round is one
aggregation that combines inside the tasks; no task ever ranks a group.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweek.functions.skew import salted_join
from marketweek.session import materialise

#: Distinct values that may end up in one array, parts of a round, accuracy of its cut points.
FEW, PARTS, ACCURACY = 4096, 64, 1000
#: Distinct values of a group for each salt of a join on it.
PER_SALT, MAX_SALTS = 1_000_000, 4096


def distinct_counts(df: DataFrame, keys: list[str], specs: dict[str, tuple[str, float]]) -> DataFrame:
    """``keys, _q, _p, _v, _c``: the distinct values of every spec and how often they occur."""
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("_q"), F.col(column).cast("double").alias("_v"), F.lit(float(q)).alias("_p"))
            for name, (column, q) in specs.items()
        ]
    )
    long = df.select(*keys, F.inline(wanted)).where("_v is not null")
    return long.groupBy(*keys, "_q", "_p", "_v").agg(F.count("*").alias("_c"))


def narrowed(counted: DataFrame, state: DataFrame, by: list[str], salts: int) -> DataFrame:
    """The next state: the part between neighbouring cut points that holds both wanted ranks.

    ``state`` has for each group the wanted position ``_pos``, the values ``_lo`` to ``_hi`` it
    lies between, how many values lie below them (``_below``), and how many distinct ones
    between (``_m``).
    """
    inside = salted_join(counted, state, by, ["_v"], salts).where("_v between _lo and _hi")
    points = [k / PARTS for k in range(1, PARTS)]
    cuts = inside.groupBy(*by).agg(F.percentile_approx("_v", points, ACCURACY).alias("_cuts"))
    part = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    # At most one row a group and part.
    parts = (
        salted_join(inside, cuts, by, ["_v"], salts)
        .groupBy(*by, part.alias("_part"))
        .agg(
            F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_m"),
            F.first("_pos").alias("_pos"), F.first("_below").alias("_base"),
        )
    )
    order = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("_upto", F.col("_base") + F.sum("_c").over(order)).withColumn("_before", F.col("_upto") - F.col("_c"))
    # The two wanted ranks are neighbours: they lie in one part or in two that touch.
    holds = (F.col("_upto") > F.floor("_pos")) & (F.col("_before") <= F.ceil("_pos"))
    return parts.where(holds).groupBy(*by).agg(
        F.first("_pos").alias("_pos"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
        F.min("_before").alias("_below"), F.sum("_m").alias("_m"),
    )


def grouped_quantiles(
    df: DataFrame, keys: list[str], specs: dict[str, tuple[str, float]], few: int = FEW
) -> DataFrame:
    """Linear-interpolated quantiles by group: one row per group, one column per spec.

    ``specs`` maps an output column to ``(value column, q)``. NULL values are left out; a
    group without values for one spec gets NULL there, one without any value has no row. Any
    key may be null but joins on none, so a null group has no row either. ``few`` bounds the
    distinct values that meet in one array; groups with more are narrowed first.
    """
    by = [*keys, "_q"]
    counted = materialise(distinct_counts(df, keys, specs))
    # One row a group and spec.
    state = materialise(
        counted.groupBy(*by).agg(
            (F.first("_p") * (F.sum("_c") - 1)).alias("_pos"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
            F.lit(0).cast("long").alias("_below"), F.count("*").alias("_m"),
        )
    )
    counted = counted.drop("_p")
    largest = state.agg(F.max("_m")).first()[0] or 0
    salts = min(MAX_SALTS, max(1, math.ceil(largest / PER_SALT)))
    while largest > few:
        state = materialise(narrowed(counted, state, by, salts))
        # Two neighbouring parts of 64 with their share of error: at most about a 25th is left.
        largest = state.agg(F.max("_m")).first()[0]
    values = salted_join(counted, state, by, ["_v"], salts).where("_v between _lo and _hi")
    # At most ``few`` entries a group.
    packed = values.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("_v", "_c"))).alias("_s"), F.first("_pos").alias("_pos"), F.first("_below").alias("_below")
    )

    def at(rank):
        """Smallest value whose count, with all below, passes a zero-based rank."""
        start = F.struct(F.col("_below").alias("n"), F.lit(None).cast("double").alias("v"))
        return F.aggregate(
            "_s", start,
            lambda a, x: F.struct((a["n"] + x["_c"]).alias("n"), F.when(a["n"] > rank, a["v"]).otherwise(x["_v"]).alias("v")),
        )["v"]

    ends = packed.withColumns({"_a": at(F.floor("_pos")), "_z": at(F.ceil("_pos"))})
    value = F.col("_a") + (F.col("_pos") - F.floor("_pos")) * (F.col("_z") - F.col("_a"))
    return ends.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == name, value)).alias(name) for name in specs])
