from __future__ import annotations

from datetime import date, timedelta

MONDAY = date(2018, 1, 1)


def monday(i: int) -> date:
    return MONDAY + timedelta(days=7 * i)


def panel(spark, series: dict[str, list[float | None]], start: int = 0):
    """``item, week, target`` rows from lists of weekly values."""
    rows = [
        (item, monday(start + i), None if v is None else float(v))
        for item, values in series.items()
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "item string, week date, target double")


def weekly(spark, rows):
    """``item, week index, qty, amount`` to the weekly schema with its unit price."""
    from marketweek.operators.weekly import with_unit_price

    data = [(i, monday(w), q, a) for i, w, q, a in rows]
    schema = "item string, week date, qty_in_week double, amount_week double"
    return with_unit_price(spark.createDataFrame(data, schema))


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}
