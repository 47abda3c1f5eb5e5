"""Joins whose left side may hold most of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


def salted_join(
    left: DataFrame, right: DataFrame, on: list[str], spread_by: list[str], salts: int = SALTS
) -> DataFrame:
    """Inner join to a side with one row per key, spreading every key over ``salts`` tasks.

    Use it where rows are grouped by the same key right after the join: run-time skew
    handling cannot split the join there, because the grouping relies on its partitioning.
    The salt is a hash of the ``spread_by`` columns, so a repeated task repeats it.
    """
    salted = left.withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    )
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"]).drop("_salt")
