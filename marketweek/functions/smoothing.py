"""Seasonal exponential smoothing of many series at once.

The one numeric kernel that column expressions cannot hold: the state has a value per
season and changes with every observation. Spark distributes the series; inside a task the
recursion runs over time once for a whole block of series and the whole parameter grid.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHAS = (0.02, 0.1, 0.2, 0.35, 0.5, 0.7)
BETAS = (0.0, 0.02, 0.1, 0.3)
GAMMA_SHARES = (0.0, 0.1, 0.3, 0.6)
"""The seasonal weight is ``share * (1 - alpha)``, which keeps it in its valid range."""
REFINEMENTS = 3
REACH = (0.08, 0.05, 0.12)
"""First step of the refinement in each parameter; every round halves it."""
BLOCK = 16


def default_grid() -> np.ndarray:
    return np.array(list(product(ALPHAS, BETAS, GAMMA_SHARES)))


def start_states(y: np.ndarray, period: int, multiplicative: bool):
    """Level, slope and season before the first value, from the first two seasons."""
    first, second = y[:, :period].mean(1), y[:, period : 2 * period].mean(1)
    slope = (second - first) / period
    level = first - slope * (period + 1) / 2
    line = level[:, None] + slope[:, None] * np.arange(1, 2 * period + 1)
    head = y[:, : 2 * period]
    detached = head / line if multiplicative else head - line
    season = (detached[:, :period] + detached[:, period:]) / 2
    centre = season.mean(1, keepdims=True)
    return level, slope, season / centre if multiplicative else season - centre


def smooth(y, n, params, period, multiplicative, horizon=0):
    """Run the recursion for series ``[s, t]`` of lengths ``n`` (longest first) and
    parameters ``[s, g, 3]``; returns the squared error ``[s, g]`` and, with a horizon, the
    forecasts ``[s, g, horizon]``."""
    level0, slope0, season0 = start_states(y, period, multiplicative)
    alpha, beta = params[:, :, 0], params[:, :, 1]
    gamma = params[:, :, 2] * (1 - alpha)
    level = np.repeat(level0[:, None], params.shape[1], 1)
    trend = np.repeat(slope0[:, None], params.shape[1], 1)
    season = np.repeat(season0.T[:, :, None], params.shape[1], 2)
    sse = np.zeros_like(level)
    alive = np.searchsorted(-n, -np.arange(y.shape[1]), side="left")
    for t in range(y.shape[1]):
        m = alive[t]
        base = level[:m] + trend[:m]
        s = season[t % period, :m]
        a, b, g = alpha[:m], beta[:m], gamma[:m]
        value = y[:m, t, None]
        if multiplicative:
            error = value - base * s
            gain = a * error / s
            season[t % period, :m] = s + g * error / base
        else:
            error = value - base - s
            gain = a * error
            season[t % period, :m] = s + g * error
        sse[:m] += error * error
        level[:m] = base + gain
        trend[:m] += b * gain
    ahead = np.empty((*level.shape, horizon))
    rows = np.arange(len(n))
    for h in range(horizon):
        s = season[(n + h) % period, rows]
        line = level + (h + 1) * trend
        ahead[:, :, h] = line * s if multiplicative else line + s
    return sse, ahead


def search(y, n, period, multiplicative, grid, refinements):
    """Weights ``[s, 3]`` of the least squared error, by grid and refinement, and that error."""
    rows = np.arange(len(n))
    tried = np.repeat(grid[None], len(n), 0)
    best, least = tried[:, 0], np.full(len(n), np.inf)
    offsets = np.array(list(product((-1, 0, 1), repeat=3)))
    reach = np.array(REACH)
    for depth in range(refinements + 1):
        sse, _ = smooth(y, n, tried, period, multiplicative)
        sse = np.where(np.isfinite(sse), sse, np.inf)
        pick = sse.argmin(1)
        better = sse[rows, pick] < least
        best = np.where(better[:, None], tried[rows, pick], best)
        least = np.minimum(least, sse[rows, pick])
        tried = np.clip(best[:, None] + offsets * reach / 2**depth, 0.0, 1.0)
        tried[:, :, 0] = np.clip(tried[:, :, 0], 1e-4, 0.9999)
    return best, least


def best_forecasts(block, period, horizon, multiplicative, grid, refinements):
    """Forecasts of the parameters with the least squared error; NULL where none is finite."""
    order = np.argsort([-len(v) for v in block], kind="stable")
    n = np.array([len(block[i]) for i in order])
    y = np.zeros((len(n), n[0]))
    for row, i in enumerate(order):
        y[row, : n[row]] = block[i]
    with np.errstate(all="ignore"):
        best, least = search(y, n, period, multiplicative, grid, refinements)
        _, ahead = smooth(y, n, best[:, None], period, multiplicative, horizon)
    out = [None] * len(block)
    for row, i in enumerate(order):
        if np.isfinite(least[row]):
            out[i] = ahead[row, 0]
    return out


def holt_winters(
    y: Column,
    horizon: int,
    period: int,
    grid: list[tuple[float, float, float]] | None = None,
    refinements: int = REFINEMENTS,
) -> Column:
    """Struct of two arrays, ``hw_add`` and ``hw_mul``.

    NULL for a series shorter than two seasons. A series with a value that is not positive
    has no multiplicative season and gets the additive forecast in both.
    """
    points = default_grid() if grid is None else np.asarray(grid, dtype=float)

    @F.pandas_udf("struct<hw_add:array<double>,hw_mul:array<double>>")
    def forecast(values: pd.Series) -> pd.DataFrame:
        additive, multiplicative = [None] * len(values), [None] * len(values)
        usable = [i for i, v in enumerate(values) if v is not None and len(v) >= 2 * period]
        arrays = values.to_numpy()
        for lo in range(0, len(usable), BLOCK):
            ids = usable[lo : lo + BLOCK]
            block = [np.asarray(arrays[i], dtype=float) for i in ids]
            for i, f in zip(ids, best_forecasts(block, period, horizon, False, points, refinements)):
                additive[i] = multiplicative[i] = f
            positive = [(i, v) for i, v in zip(ids, block) if (v > 0).all()]
            if positive:
                ids, block = zip(*positive)
                fits = best_forecasts(block, period, horizon, True, points, refinements)
                for i, f in zip(ids, fits):
                    multiplicative[i] = f
        return pd.DataFrame({"hw_add": additive, "hw_mul": multiplicative})

    return forecast(y)
