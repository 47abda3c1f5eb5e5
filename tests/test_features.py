import numpy as np
import pandas as pd
import pytest
from helpers import monday, weekly
from pyspark.sql import functions as F

from marketweek.operators import features as f
from marketweek.operators import gbm


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = []
    for item, n in (("a", 70), ("b", 20)):
        for i in range(n):
            price = None if (item, i) == ("a", 30) else float(rng.uniform(5, 9))
            rows.append((item, i, float(rng.integers(1, 9)), None if price is None else price))
    data = [(i, w, q, None if p is None else p * q) for i, w, q, p in rows]
    return weekly(spark, data)


def test_lags_and_rolling_match_pandas(spark, table):
    got = f.weekly_features(table).toPandas().sort_values(["item", "week"]).reset_index(drop=True)
    base = table.toPandas().sort_values(["item", "week"]).reset_index(drop=True)
    price = np.log1p(base["unit_price_week"].astype(float))
    by_item = price.groupby(base["item"])
    for k in (1, 52):
        pd.testing.assert_series_equal(
            got[f"log_price_lag{k}"].astype(float), by_item.shift(k), check_names=False
        )
    for w in (4, 26):
        for fn, name in (("mean", "rollmean"), ("std", "rollstd")):
            want = by_item.transform(lambda s: getattr(s.shift(1).rolling(w), fn)())
            pd.testing.assert_series_equal(
                got[f"log_price_{name}{w}"].astype(float), want, check_names=False
            )
    change = base["unit_price_week"].astype(float) / base.groupby("item")["unit_price_week"].shift(1).astype(float) - 1
    want = change.groupby(base["item"]).transform(lambda s: s.shift(1).rolling(8).std())
    pd.testing.assert_series_equal(got["price_vol_8"].astype(float), want, check_names=False)


def test_no_leakage(spark, table):
    """A changed price at week t leaves every look-back of weeks up to t as it was."""
    t = monday(60)
    bumped = table.withColumn(
        "unit_price_week",
        F.when((F.col("item") == "a") & (F.col("week") == t), 99.0).otherwise(F.col("unit_price_week")),
    )
    past = [c for c in gbm.feature_names() if "_lag" in c or "_roll" in c or c.startswith("price_vol")]
    kept = []
    for df in (table, bumped):
        rows = f.weekly_features(df).where(F.col("week") <= t).select("item", "week", *past)
        kept.append(sorted(rows.collect(), key=lambda r: (r.item, r.week)))
    assert kept[0] == kept[1]


def test_window_expressions_share_one_exchange_and_sort(spark, table):
    plan = f.weekly_features(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [item") == 1
