"""Scalar column functions: cleaning, calendar, prices, finite tests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_number(column: Column) -> Column:
    """Text to double; anything unreadable, and NaN, becomes NULL."""
    number = column.try_cast("double")
    return F.when(~F.isnan(number), number)


def coerce_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Apply :func:`to_number` to those of ``columns`` that exist."""
    present = set(df.columns)
    return df.withColumns({c: to_number(F.col(c)) for c in columns if c in present})


def parse_date(column: Column) -> Column:
    """``YYYYMMDD`` or ``YYYY-MM-DD`` text to date; unreadable text becomes NULL."""
    text = column.cast("string")
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyyMMdd")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
    ).cast("date")


def week_of(column: Column) -> Column:
    """Monday of the ISO week of a date or timestamp."""
    return F.trunc(column, "WEEK")


def iso_week_start(year: Column, week: Column) -> Column:
    """Monday of an ISO (year, week) pair; NULL unless the week lies in 1..53 and the year in
    1..9999, also for numbers beyond an integer."""
    whole = year.try_cast("int")
    first = F.trunc(F.make_date(F.when(whole.between(1, 9999), whole), F.lit(1), F.lit(4)), "WEEK")
    number = week.try_cast("int")
    return F.when(number.between(1, 53), F.date_add(first, (number - 1) * 7))


def iso_year(column: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), column)


def calendar(df: DataFrame, column: str = "week") -> DataFrame:
    """Add year, month and ISO week of the year."""
    day = F.col(column)
    return df.withColumns(
        {"year": F.year(day), "month": F.month(day), "weekofyear": F.weekofyear(day)}
    )


def not_sunday(column: Column) -> Column:
    return F.weekday(column) != 6


def positive_or_null(column: Column) -> Column:
    return F.when(column > 0, column)


def guarded_unit_price(amount: Column, qty: Column) -> Column:
    """Amount per quantity, NULL unless both are positive."""
    return F.when((qty > 0) & (amount > 0), amount / qty)


def plain_unit_price(amount: Column, qty: Column) -> Column:
    """Amount per quantity, NULL only for a zero or missing quantity."""
    return F.try_divide(amount, qty)


def clip_low(column: Column, low: float) -> Column:
    """Lower bound that keeps NULL."""
    return F.when(column.isNotNull(), F.greatest(column, F.lit(float(low))))


def is_finite(column: Column) -> Column:
    return F.coalesce(
        ~F.isnan(column) & (F.abs(column) < F.lit(float("inf"))), F.lit(False)
    )


def all_finite(values: Column) -> Column:
    """Every element of an array is a finite number; false for a NULL array."""
    return F.coalesce(F.forall(values, is_finite), F.lit(False))


def array_mean(values: Column) -> Column:
    """Mean of an array of doubles, NULL when it is empty."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def relative_change(value: Column, previous: Column) -> Column:
    return F.try_divide(value, previous) - 1


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    """Plan-time check, before any job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail on an empty input. Runs one short job."""
    if df.isEmpty():
        raise ValueError(f"no rows for {what}")
    return df


def present_columns(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    """Those of ``wanted`` the table has, in the wanted order."""
    have = set(df.columns)
    return [c for c in wanted if c in have]
