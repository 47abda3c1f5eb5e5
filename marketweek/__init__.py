"""Weekly unit-price analytics for PySpark.

Every operator takes and returns a lazy ``DataFrame``; nothing runs until the caller acts.
"""

from marketweek.params import (
    FeatureParams,
    ForecastParams,
    GbmParams,
    SubstituteParams,
)

__all__ = ["FeatureParams", "ForecastParams", "GbmParams", "SubstituteParams"]
