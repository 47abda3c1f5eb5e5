import numpy as np
import pytest

from marketweek.operators.substitutes import group_thresholds, recommendation_kpis, shortlist, substitutes
from marketweek.params import SubstituteParams

STATE = "grp string, item string, pred_price double, qty_rollmean4 double, price_vol_8 double"


def all_pairs(rows, params):
    """Every ordered pair of a group, filtered and ranked."""
    out = set()
    for g in {r[0] for r in rows}:
        members = [r for r in rows if r[0] == g]
        median = np.percentile([r[3] for r in members], 100 * params.supply_quantile)
        q3 = np.percentile([r[4] for r in members], 100 * params.volatility_quantile)
        for a in members:
            found = [
                ((a[2] - c[2]) / a[2], c[4], c[1])
                for c in members
                if c[1] != a[1] and c[3] >= median and c[4] <= q3
                and (a[2] - c[2]) / a[2] >= params.price_discount_threshold
            ]
            found.sort(key=lambda f: (-f[0], f[1], f[2]))
            out |= {(a[1], i + 1, f[2]) for i, f in enumerate(found[: params.top_k])}
    return out


@pytest.mark.parametrize("threshold", [0.15, 0.0, -10.0])
def test_equals_all_pairs(spark, threshold):
    """A hot group, ties in price and volatility, and thresholds under which an item's own
    entry would be on the short list."""
    rng = np.random.default_rng(2)
    rows = []
    for g, n in (("hot", 60), ("small", 5), ("single", 1)):
        for i in range(n):
            rows.append((g, f"{g}{i:03d}", float(rng.integers(8, 20)), float(rng.integers(1, 9)), float(rng.integers(1, 6))))
    params = SubstituteParams(price_discount_threshold=threshold, top_k=4)
    got = {(r["item"], r["rank"], r["substitute"]) for r in substitutes(spark.createDataFrame(rows, STATE), params).collect()}
    assert got == all_pairs(rows, params)
    assert got


def test_boundaries_are_inclusive(spark):
    rows = [("g", "dear", 100.0, 1.0, 9.0), ("g", "exact", 85.0, 5.0, 1.0), ("g", "close", 85.5, 9.0, 1.0)]
    got = [(r["item"], r["substitute"], r["saving_rate"]) for r in substitutes(spark.createDataFrame(rows, STATE)).collect()]
    # Supply equals the median; volatility equals the upper quartile bound or lies below.
    assert got == [("dear", "exact", 0.15)]


def test_kpis(spark):
    rows = [("g", "dear", 100.0, 1.0, 9.0), ("g", "exact", 85.0, 5.0, 1.0), ("g", "close", 85.5, 9.0, 1.0)]
    grouped = spark.createDataFrame(rows, STATE)
    found = substitutes(grouped)
    kpi = recommendation_kpis(grouped, found).first()
    assert kpi.coverage_pct == pytest.approx(100 / 3) and kpi.mean_saving_pct == pytest.approx(15)
    assert kpi.stability_pct == 100 and kpi.acceptance_pct is None
    feedback = spark.createDataFrame([("dear", "exact", False)], "item string, substitute string, accepted boolean")
    assert recommendation_kpis(grouped, found, feedback).first().acceptance_pct == 0
    none = recommendation_kpis(grouped, found.where("false")).first()
    assert none.coverage_pct == 0 and none.mean_saving_pct is None


def test_short_list_is_cut_before_the_exchange(spark):
    rows = [("g", "a", 1.0, 1.0, 1.0)]
    state = spark.createDataFrame(rows, STATE)
    lists = shortlist(state, group_thresholds(state, SubstituteParams()), SubstituteParams())
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert ", Partial" in plan and plan.count("WindowGroupLimit") == 2
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_one_list_for_an_item_in_several_groups(spark):
    rows = [(g, f"i{k}", 100.0 - 5 * k, 1.0, 0.1) for g in ("a", "b") for k in range(8)]
    rows += [("c", "i0", 100.0, 1.0, 0.1), ("c", "solo", 50.0, 1.0, 0.1)]
    found = substitutes(spark.createDataFrame(rows, STATE)).where("item = 'i0'").orderBy("rank").collect()
    assert [r["rank"] for r in found] == [1, 2, 3, 4, 5]
    assert [r.substitute for r in found] == ["solo", "i7", "i6", "i5", "i4"]
    assert [r.grp for r in found] == ["c", "a", "a", "a", "a"]
