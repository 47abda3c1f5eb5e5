"""Forecast error measures, as array expressions and as aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketweek.functions.scalar import array_mean

# Guards against a zero denominator.
MAPE_FLOOR = 1e-9
SMAPE_EPSILON = 1e-9
# end of fixed values


def squared_error(y: Column, f: Column) -> Column:
    return (y - f) * (y - f)


def relative_error(y: Column, f: Column) -> Column:
    return F.abs((y - f) / F.greatest(y, F.lit(MAPE_FLOOR)))


def symmetric_error(y: Column, f: Column) -> Column:
    return 2 * F.abs(y - f) / (F.abs(y) + F.abs(f) + F.lit(SMAPE_EPSILON))


def window_metrics(actual: Column, forecast: Column) -> dict[str, Column]:
    """RMSE, MAE, MAPE and sMAPE (both in percent) of one forecast window held as arrays."""

    def mean_of(fn) -> Column:
        return array_mean(F.zip_with(actual, forecast, fn))

    return {
        "rmse": F.sqrt(mean_of(squared_error)),
        "mae": mean_of(lambda y, f: F.abs(y - f)),
        "mape": mean_of(relative_error) * 100,
        "smape": mean_of(symmetric_error) * 100,
    }


def prediction_metrics(y: Column, f: Column) -> dict[str, Column]:
    """WAPE, sMAPE (both as fractions), MAE and row count over the rows with both values."""
    both = y.isNotNull() & f.isNotNull()
    error = F.when(both, F.abs(y - f))
    return {
        "wape": F.try_divide(F.sum(error), F.sum(F.when(both, F.abs(y)))),
        "smape": F.avg(F.when(both, symmetric_error(y, f))),
        "mae": F.avg(error),
        "n": F.count(error),
    }


def log_rmse(log_y: Column, log_f: Column) -> Column:
    return F.sqrt(F.avg(squared_error(log_y, log_f)))
