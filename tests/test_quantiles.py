import numpy as np
import pytest

from marketweek.functions.quantiles import grouped_quantiles


def groups_of(rng):
    return {
        "hot": np.round(rng.lognormal(0, 2, 50_000), 1),
        "fine": rng.normal(size=20_000),
        "same": np.full(20_000, 3.5),
        "two": np.repeat([1.0, 9.0], [5_000, 5_000]),
        "pair": np.array([1.0, 4.0]),
        "one": np.array([2.0]),
        "seven": rng.uniform(0, 1, 7),
    }


@pytest.mark.parametrize("few", [4096, 50, 3])
def test_against_numpy_on_hot_groups(spark, few):
    """Groups far above the bound, with heavy ties, beside tiny ones; any bound gives the same."""
    groups = groups_of(np.random.default_rng(0))
    rows = [(g, float(v), float(-v)) for g, vs in groups.items() for v in vs]
    rows += [("pair", None, None), ("empty", None, 1.0), ("void", None, None)]
    df = spark.createDataFrame(rows, "grp string, a double, b double").repartition(6)
    specs = {"q2": ("a", 0.5), "q3": ("b", 0.75), "low": ("a", 0.0), "high": ("a", 1.0), "odd": ("b", 0.123)}
    got = {r.grp: r for r in grouped_quantiles(df, ["grp"], specs, few).collect()}
    assert set(got) == {*groups, "empty"}
    for g, vs in groups.items():
        for name, (column, q) in specs.items():
            assert got[g][name] == pytest.approx(np.percentile(vs if column == "a" else -vs, 100 * q), rel=1e-12), (g, name)
    assert tuple(got["empty"])[1:] == (None, 1.0, None, None, 1.0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "grp string, a double")
    assert grouped_quantiles(df, ["grp"], {"m": ("a", 0.5)}).count() == 0


def test_no_task_ranks_a_group(spark):
    """No window over the values of a group, no size at which the answer fails."""
    df = spark.createDataFrame([("g", float(k)) for k in range(100)], "grp string, a double")
    plan = grouped_quantiles(df, ["grp"], {"m": ("a", 0.5)})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "raise_error" not in plan
