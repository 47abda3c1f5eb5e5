"""Closed-form forecasters as array expressions over a training series.

Each returns one array with a value per horizon step. They run inside the row of the
series, so no forecaster adds a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweek.functions.scalar import array_mean


def _steps(horizon: int) -> Column:
    return F.sequence(F.lit(1), F.lit(horizon))


def seasonal_naive(y: Column, horizon: int, period: int) -> Column:
    """The last season repeated; the last value while there is no full season."""
    n = F.size(y)
    return F.transform(
        _steps(horizon),
        lambda h: F.when(
            n >= period, F.get(y, n - period + F.pmod(h - 1, F.lit(period)))
        ).otherwise(F.get(y, n - 1)),
    )


def rolling_mean(y: Column, horizon: int, window: int) -> Column:
    """Mean of the last ``window`` values, or of fewer at the start, for every step."""
    n = F.size(y)
    recent = F.slice(y, F.greatest(n - window + 1, F.lit(1)), F.lit(window))
    return F.array_repeat(array_mean(recent), horizon)


def week_pairs(weeks: Column, y: Column) -> Column:
    """``(ISO week, value)`` of every training row, the input of :func:`week_mean`."""
    return F.zip_with(
        weeks, y, lambda w, v: F.struct(F.weekofyear(w).alias("wk"), v.alias("v"))
    )


def week_mean(pairs: Column, target_weeks: Column) -> Column:
    """Training mean of the target's ISO week.

    A week number that training never saw gets the plain mean of the week means.
    """

    def mean_of(number: Column) -> Column:
        same = F.filter(pairs, lambda p: p["wk"] == number)
        return array_mean(F.transform(same, lambda p: p["v"]))

    seen = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["wk"])))
    fallback = array_mean(F.transform(seen, mean_of))
    return F.transform(
        target_weeks, lambda w: F.coalesce(mean_of(F.weekofyear(w)), fallback)
    )


def holt_start(y: Column) -> Column:
    """Struct of level and trend before the first value: a line through the first ten."""
    head = F.slice(y, 1, 10)
    m = F.size(head)
    sums = F.aggregate(
        F.transform(head, lambda v, i: F.struct(v.alias("v"), (v * (i + 1)).alias("tv"))),
        F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("tv")),
        lambda a, x: F.struct((a["v"] + x["v"]).alias("v"), (a["tv"] + x["tv"]).alias("tv")),
        lambda a: F.struct(
            (a["v"] / m).alias("mean"),
            F.coalesce(
                F.try_divide(
                    a["tv"] - (m + 1) / F.lit(2.0) * a["v"], m * (m * m - 1) / F.lit(12.0)
                ),
                F.lit(0.0),
            ).alias("slope"),
        ),
    )
    return F.transform(
        F.array(sums),
        lambda s: F.struct(
            (s["mean"] - s["slope"] * (m + 1) / 2).alias("level"), s["slope"].alias("trend")
        ),
    )[0]


def holt_fit(y: Column, start: Column, alpha: Column, beta: Column) -> Column:
    """Additive-trend smoothing at given parameters, from :func:`holt_start`.

    Struct of sse, alpha, beta, level, trend; the parameters ride along so that the least
    of several such structs is the best fit.
    """

    def state(sse: Column, a: Column, b: Column, level: Column, trend: Column) -> Column:
        return F.struct(
            sse.alias("sse"),
            a.alias("alpha"),
            b.alias("beta"),
            level.alias("level"),
            trend.alias("trend"),
        )

    def step(s: Column, value: Column) -> Column:
        error = value - s["level"] - s["trend"]
        return state(
            s["sse"] + error * error,
            s["alpha"],
            s["beta"],
            s["level"] + s["trend"] + s["alpha"] * error,
            s["trend"] + s["alpha"] * s["beta"] * error,
        )

    return F.aggregate(y, state(F.lit(0.0), alpha, beta, start["level"], start["trend"]), step)


def line_ahead(fit: Column, horizon: int) -> Column:
    return F.transform(_steps(horizon), lambda h: fit["level"] + h * fit["trend"])


HOLT_ALPHAS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
HOLT_BETAS = (0.0, 0.05, 0.1, 0.2, 0.4)


def holt(
    y: Column,
    start: Column,
    alphas: tuple[float, ...] = HOLT_ALPHAS,
    betas: tuple[float, ...] = HOLT_BETAS,
) -> Column:
    """The fit with the least squared error over a parameter grid; ties go to the smaller
    alpha, then beta."""
    grid = F.array(
        *[
            F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(b)).alias("beta"))
            for a in alphas
            for b in betas
        ]
    )
    return F.array_min(F.transform(grid, lambda p: holt_fit(y, start, p["alpha"], p["beta"])))


def calendar_naive(panel: DataFrame) -> DataFrame:
    """``item, week, y, y_hat`` where ``week`` is the predicted week and ``y_hat`` the item's
    value exactly 52 weeks (364 days) earlier.

    A range frame looks the earlier week up inside the item, so the panel is neither read
    twice nor joined to itself. Weeks without a year-ago value are left out.
    """
    year_ago = (
        Window.partitionBy("item").orderBy(F.unix_date("week")).rangeBetween(-364, -364)
    )
    return panel.select(
        "item", "week", F.col("target").alias("y"), F.max("target").over(year_ago).alias("y_hat")
    ).where("y_hat is not null")
