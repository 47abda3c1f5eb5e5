from datetime import date

import pytest
from pyspark.sql import functions as F

from marketweek.functions import scalar as s


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "year, week, expected",
    [
        (2020, 53, date(2020, 12, 28)),
        (2021, 53, date(2022, 1, 3)),
        (2021, 1, date(2021, 1, 4)),
        (2024, 0, None),
        (2024, 54, None),
    ],
)
def test_iso_week_start(spark, year, week, expected):
    assert one(spark, s.iso_week_start(F.lit(year), F.lit(week))) == expected


@pytest.mark.parametrize(
    "day, expected",
    [("2024-01-07", date(2024, 1, 1)), ("2024-01-08", date(2024, 1, 8))],
)
def test_week_of(spark, day, expected):
    assert one(spark, s.week_of(F.lit(day).cast("date"))) == expected


@pytest.mark.parametrize("text, expected", [("x", None), (" 12 ", 12.0), ("NaN", None), ("1.5", 1.5)])
def test_to_number(spark, text, expected):
    assert one(spark, s.to_number(F.lit(text))) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("20240108", date(2024, 1, 8)), ("2024-01-08", date(2024, 1, 8)), ("soon", None)],
)
def test_parse_date(spark, text, expected):
    assert one(spark, s.parse_date(F.lit(text))) == expected


def test_prices_with_zero_and_negative_quantity(spark):
    amount = F.lit(10.0)
    assert one(spark, s.guarded_unit_price(amount, F.lit(0.0))) is None
    assert one(spark, s.guarded_unit_price(amount, F.lit(-1.0))) is None
    assert one(spark, s.plain_unit_price(amount, F.lit(0.0))) is None
    assert one(spark, s.plain_unit_price(amount, F.lit(-1.0))) == -10.0


def test_clip_keeps_null(spark):
    assert one(spark, s.clip_low(F.lit(-3.0), 0)) == 0.0
    assert one(spark, s.clip_low(F.lit(None).cast("double"), 0)) is None


def test_all_finite(spark):
    good = F.array(F.lit(1.0), F.lit(2.0))
    assert one(spark, s.all_finite(good)) is True
    for bad in (float("nan"), float("inf"), None):
        values = F.array(F.lit(1.0), F.lit(bad).cast("double"))
        assert one(spark, s.all_finite(values)) is False
    assert one(spark, s.all_finite(F.lit(None).cast("array<double>"))) is False


def test_required_columns_and_rows(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="amount"):
        s.require_columns(df, ["a", "amount"])
    with pytest.raises(ValueError, match="no rows"):
        s.require_rows(df.where("a > 5"), "item x")
    assert s.require_rows(df, "item x") is df
    assert s.present_columns(df, ["b", "a"]) == ["a"]


@pytest.mark.parametrize("year, week", [(99999999999, 1), (2020, 99999999999), (0, 1), (10000, 1), (-5, 3)])
def test_iso_week_start_of_absurd_numbers(spark, year, week):
    assert one(spark, s.iso_week_start(F.lit(year), F.lit(week))) is None
