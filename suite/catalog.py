"""All registered queries."""

from suite import files, forecasts, models, panels  # noqa: F401  (registering imports)
from suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
