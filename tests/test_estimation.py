import duckdb
import numpy as np
import pandas as pd
import pytest
from helpers import panel
from pyspark.sql import functions as F

from marketweek.functions import estimation as e
from marketweek.operators import forecast as fc
from marketweek.params import ForecastParams


def noisy(rng, n, period, multiplicative):
    t = np.arange(1, n + 1)
    shape = np.sin(2 * np.pi * t / period)
    line = 40 + 0.2 * t
    y = line * (1 + 0.2 * shape) if multiplicative else line + 6 * shape
    return y + rng.normal(0, 2, n)


@pytest.mark.parametrize("multiplicative", [False, True])
def test_derivatives(multiplicative):
    rng, period = np.random.default_rng(1), 5
    n = np.array([23, 20, 17])
    y = np.abs(20 + rng.normal(0, 2, (3, 23)))
    for row, length in enumerate(n):
        y[row, length:] = 0
    season = rng.normal(0, 0.1, (3, period)) + multiplicative
    p = np.column_stack([rng.uniform(0.1, 0.6, (3, 3)), np.full(3, 20.0), rng.normal(0, 0.1, 3), season])
    _, jac, _ = e.errors(y, n, p, period, multiplicative)
    for k in range(p.shape[1]):
        up, down = p.copy(), p.copy()
        up[:, k] += 1e-6
        down[:, k] -= 1e-6
        slope = (e.errors(y, n, up, period, multiplicative, False)[0] - e.errors(y, n, down, period, multiplicative, False)[0]) / 2e-6
        assert np.abs(jac[:, :, k] - slope).max() < 1e-6


@pytest.mark.parametrize("form", ["add", "mul"])
def test_noise_free_series_are_recovered(form):
    period, t = 8, np.arange(1, 45)
    shape = np.array([0.7, 0.9, 1.2, 1.2, 1.1, 1.0, 0.9, 1.0])
    season, line = shape[(t - 1) % period], 50 + 0.5 * t
    y = line * season if form == "mul" else line + 10 * (season - 1)
    fit = e.fits([y[:40]], period, 4, form)[0]
    assert fit["converged"] and np.allclose(fit["ahead"], y[40:], rtol=1e-6)


@pytest.mark.parametrize("form", ["add", "mul", "trend"])
def test_never_worse_than_the_start_and_at_a_minimum(form):
    rng, period = np.random.default_rng(2), 12
    lengths = [30, 47, 60] if form != "trend" else [5, 12, 20]
    block = [noisy(rng, n, period, form == "mul") for n in lengths]
    for y, fit in zip(block, e.fits(block, period, 3, form)):
        assert fit["converged"] and fit["sse"] <= fit["grid_sse"]
        # No small step of a start state lowers the error.
        season = [0.0] if form == "trend" else fit["season"]
        p = np.array([[fit["alpha"], fit["beta"], fit["share"], fit["level"], fit["trend"], *season]])
        width = 1 if form == "trend" else period
        for k in (3, 4):
            for step in (-1e-2, 1e-2):
                moved = p.copy()
                moved[0, k] += step * max(1.0, abs(p[0, k]))
                sse = np.square(e.errors(y[None], np.array([len(y)]), moved, width, form == "mul", False)[0]).sum()
                assert sse > fit["sse"] * (1 - 1e-5)


def test_a_block_equals_single_fits():
    rng = np.random.default_rng(3)
    block = [noisy(rng, n, 6, False) for n in (14, 40, 25)]
    for y, fit in zip(block, e.fits(block, 6, 2, "add")):
        assert np.isclose(fit["sse"], e.fits([y], 6, 2, "add")[0]["sse"], rtol=1e-3)


@pytest.mark.parametrize("form", ["add", "mul"])
def test_sql_recursion_at_the_found_weights(form):
    """Error and forecasts of the found parameters, recomputed by recursion in SQL."""
    rng, period = np.random.default_rng(4), 6
    block = [noisy(rng, n, period, form == "mul") for n in (20, 33)]
    found = e.fits(block, period, 2, form)
    fit = pd.DataFrame([{"item": i, **f} for i, f in enumerate(found)])  # noqa: F841
    ser = pd.DataFrame([{"item": i, "rn": t + 1, "y": v} for i, y in enumerate(block) for t, v in enumerate(y)])  # noqa: F841
    fitted, gain, turn = ("base * s", "alpha * e / s", "s + g * e / base") if form == "mul" else ("base + s", "alpha * e", "s + g * e")
    rows = duckdb.sql(f"""
      WITH RECURSIVE walk AS (
        SELECT item, alpha, beta, share * (1 - alpha) AS g, 0::BIGINT AS rn, 0::DOUBLE AS sse, level, trend, season FROM fit
        UNION ALL
        SELECT item, alpha, beta, g, rn, sse + e * e, base + {gain}, trend + beta * {gain}, list_append(season[2:], {turn})
        FROM (SELECT *, y - ({fitted}) AS e FROM (
          SELECT w.item, alpha, beta, g, w.rn + 1 AS rn, sse, trend, season, s.y, level + trend AS base, season[1] AS s
          FROM walk w JOIN ser s ON s.item = w.item AND s.rn = w.rn + 1))
      )
      SELECT sse, level + trend, season[1], level + 2 * trend, season[2] FROM walk
      QUALIFY row_number() OVER (PARTITION BY item ORDER BY rn DESC) = 1 ORDER BY item""").fetchall()
    for f, (sse, one, s1, two, s2) in zip(found, rows):
        assert np.isclose(f["sse"], sse)
        assert np.allclose(f["ahead"], [one * s1, two * s2] if form == "mul" else [one + s1, two + s2])


def test_forms_by_length_and_sign(spark):
    rng = np.random.default_rng(5)
    long = noisy(rng, 30, 8, True)
    rows = [
        ("long", list(long)), ("negative", list(long - 60)), ("short", [5.0 + 2 * t for t in range(1, 13)]), ("one", [4.0]),
        ("none", []), ("null", None), ("nan", [float("nan")] * 20),  # no finite fit
    ]
    rows = [(item, y and [float(v) for v in y]) for item, y in rows]
    df = spark.createDataFrame(rows, "item string, y array<double>")
    got = {r.item: r.f for r in df.select("item", e.estimated(F.col("y"), 2, 8).alias("f")).collect()}
    assert len(got["long"].hw_add.season) == 8 and got["long"].hw_add.ahead != got["long"].hw_mul.ahead
    assert got["negative"].hw_mul == got["negative"].hw_add
    assert got["short"].hw_add.season is None and np.allclose(got["short"].hw_mul.ahead, [31, 33])
    assert got["one"].hw_add.ahead == [4.0, 4.0]
    assert all(got[k].hw_add is None and got[k].hw_mul is None for k in ("none", "null", "nan"))


def test_board_estimates_by_default(spark):
    rng = np.random.default_rng(6)
    df = panel(spark, {"a": list(noisy(rng, 120, 52, False)), "b": list(noisy(rng, 80, 52, True))})
    rows = {}
    for smoothing in ("estimated", "grid"):
        params = ForecastParams(smoothing=smoothing)
        rows[smoothing] = {(r.item, r.fold, r.model): r.yhat for r in fc.model_rows(df, params).collect()}
    assert ForecastParams().smoothing == "estimated" and rows["estimated"].keys() == rows["grid"].keys()
    assert all(np.isfinite(f).all() for f in rows["estimated"].values())
    assert rows["estimated"]["a", 0, "HW-Add"] != rows["grid"]["a", 0, "HW-Add"]
    assert rows["estimated"]["a", 0, "WeekMean"] == rows["grid"]["a", 0, "WeekMean"]
    with pytest.raises(ValueError, match="unknown smoothing"):
        fc.model_rows(df, ForecastParams(smoothing="magic"))
