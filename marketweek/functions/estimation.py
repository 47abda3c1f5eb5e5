"""Smoothing with estimated start states: least squares over weights and states together.

The grid search of :mod:`marketweek.functions.smoothing` only chooses weights; level, trend and
the seasons before the first value stay at a rule of thumb. Here all of them are parameters.
The recursion carries the derivatives of its states along, so one pass over time gives every
error and its gradient for a block of series, and damped Gauss-Newton steps go on until the
squared error stops falling. A step that doesn't lower it is not taken, so a fit is never
worse than its start, the best point of the grid.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marketweek.functions.smoothing import REFINEMENTS, default_grid, search, start_states

WEIGHTS = 3
LOWEST, HIGHEST = np.array([1e-4, 0.0, 0.0]), np.array([0.9999, 1.0, 1.0])
#: A fit has converged once a step lowers its error by less than this share, three times in a row.
TOLERANCE = 1e-6
#: Damping at the start and where no step helps any more; rounds are a guard, not the stop.
DAMPING, NO_STEP, GUARD = 1e-3, 1e12, 500
BLOCK = 64
FIT = (
    "struct<alpha:double,beta:double,share:double,level:double,trend:double,season:array<double>,"
    "sse:double,grid_sse:double,converged:boolean,ahead:array<double>>"
)


def errors(y, n, params, period, multiplicative, slopes=True, horizon=0):
    """Errors ``[s, t]``, their derivatives ``[s, t, k]`` and forecasts of series ``[s, t]``.

    ``params`` holds for each series the three weights, level, trend and ``period`` seasons;
    series are ordered from the longest to the shortest (lengths ``n``). Errors beyond a
    series' end are zero. Without ``slopes`` only errors and forecasts are computed.
    """
    rows, k = params.shape
    alpha, beta, share = params[:, 0].copy(), params[:, 1].copy(), params[:, 2].copy()
    gamma = share * (1 - alpha)
    level, trend, season = params[:, 3].copy(), params[:, 4].copy(), params[:, 5:].T.copy()
    out = np.zeros(y.shape)
    if slopes:
        jac = np.zeros((*y.shape, k))
        d_level, d_trend, d_season = np.zeros((rows, k)), np.zeros((rows, k)), np.zeros((period, rows, k))
        d_level[:, 3] = d_trend[:, 4] = 1
        for p in range(period):
            d_season[p, :, 5 + p] = 1
    alive = np.searchsorted(-n, -np.arange(y.shape[1]), side="left")
    for t in range(y.shape[1]):
        m, p = alive[t], t % period
        base, s, a, b, g = level[:m] + trend[:m], season[p, :m], alpha[:m], beta[:m], gamma[:m]
        error = y[:m, t] - (base * s if multiplicative else base + s)
        gain = a * error / s if multiplicative else a * error
        if slopes:
            d_base, d_s = d_level[:m] + d_trend[:m], d_season[p, :m]
            if multiplicative:
                d_error = -(d_base * s[:, None] + base[:, None] * d_s)
                d_gain = (a[:, None] * d_error - gain[:, None] * d_s) / s[:, None]
                d_gain[:, 0] += error / s
                shift = g * error / base
                d_shift = (g[:, None] * d_error - shift[:, None] * d_base) / base[:, None]
                weight = error / base
            else:
                d_error = -(d_base + d_s)
                d_gain = a[:, None] * d_error
                d_gain[:, 0] += error
                d_shift = g[:, None] * d_error
                weight = error
            d_shift[:, 0] -= share[:m] * weight
            d_shift[:, 2] += (1 - a) * weight
            jac[:m, t] = d_error
            d_season[p, :m] = d_s + d_shift
            d_level[:m] = d_base + d_gain
            d_trend[:m] += b[:, None] * d_gain
            d_trend[:m, 1] += gain
        out[:m, t] = error
        season[p, :m] = s + (g * error / base if multiplicative else g * error)
        level[:m] = base + gain
        trend[:m] += b * gain
    ahead = np.empty((rows, horizon))
    for h in range(horizon):
        s = season[(n + h) % period, np.arange(rows)]
        line = level + (h + 1) * trend
        ahead[:, h] = line * s if multiplicative else line + s
    return out, jac if slopes else None, ahead


def equations(error, jac):
    """Normal matrix and gradient of the squared error (halved)."""
    turned = jac.transpose(0, 2, 1)
    return turned @ jac, (turned @ error[..., None])[..., 0]


def steps(normal, slope, damping, held):
    """Damped Gauss-Newton steps; ``held`` parameters stay where they are."""
    free = ~held
    normal = normal * (free[:, :, None] & free[:, None, :])
    k = normal.shape[1]
    size = normal[:, np.arange(k), np.arange(k)]
    # Held and unseen parameters get a unit diagonal: no step, and no singular system.
    spread = np.where(size > 0, size * damping[:, None], 1.0) + 1e-14 * size.max(axis=1, keepdims=True)
    normal[:, np.arange(k), np.arange(k)] += spread
    return -np.linalg.solve(normal, (slope * free)[..., None])[..., 0]


def fitted(y, n, params, period, multiplicative, free):
    """Lower the squared error from ``params`` on until it stops falling.

    ``free`` says which parameters may move. Weights stay within their bounds: one that lies on
    a bound and would leave it is held. Returns parameters, squared errors, and whether each
    series converged.
    """
    params = params.copy()
    error, jac, _ = errors(y, n, params, period, multiplicative)
    sse = np.square(error).sum(axis=1)
    normal, slope = equations(error, jac)
    damping, still = np.full(len(params), DAMPING), np.zeros(len(params), int)
    done = ~np.isfinite(sse) | ~np.isfinite(normal).all(axis=(1, 2))
    exact = np.square(y).sum(axis=1) * 1e-28
    for _ in range(GUARD):
        done |= (sse <= exact) | (damping > NO_STEP) | (still >= 3)
        run = np.flatnonzero(~done)
        if not len(run):
            break
        weights, down = params[run, :WEIGHTS], slope[run, :WEIGHTS]
        held = np.broadcast_to(~free, (len(run), params.shape[1])).copy()
        held[:, :WEIGHTS] |= ((weights <= LOWEST) & (down > 0)) | ((weights >= HIGHEST) & (down < 0))
        tried = params[run] + steps(normal[run], slope[run], damping[run], held)
        tried[:, :WEIGHTS] = np.clip(tried[:, :WEIGHTS], LOWEST, HIGHEST)
        error, jac, _ = errors(y[run], n[run], tried, period, multiplicative)
        new = np.square(error).sum(axis=1)
        new_normal, new_slope = equations(error, jac)
        good = np.isfinite(new) & (new < sse[run]) & np.isfinite(new_normal).all(axis=(1, 2))
        small = good & (sse[run] - new <= TOLERANCE * sse[run])
        still[run] = np.where(small, still[run] + 1, np.where(good, 0, still[run]))
        damping[run] = np.where(good, np.maximum(damping[run] / 5, 1e-12), damping[run] * 4)
        won = run[good]
        params[won], sse[won], normal[won], slope[won] = tried[good], new[good], new_normal[good], new_slope[good]
    return params, sse, done & np.isfinite(sse)


def trend_starts(y, n):
    """Level and trend before the first value: a line through the first ten values."""
    m = np.minimum(n, 10)
    t = np.arange(1, 11)
    head = np.zeros((len(y), 10))
    head[:, : min(10, y.shape[1])] = y[:, :10]
    seen = t <= m[:, None]
    mean = (head * seen).sum(axis=1) / m
    centred = (t - (m[:, None] + 1) / 2) * seen
    square = np.square(centred).sum(axis=1)
    slope = np.divide((centred * head).sum(axis=1), square, out=np.zeros(len(y)), where=square > 0)
    return mean - slope * (m + 1) / 2, slope


def fits(block, period, horizon, form):
    """Fits of a block of arrays in ``form`` ``add``, ``mul`` or ``trend``; None where none is finite."""
    order = np.argsort([-len(v) for v in block], kind="stable")
    n = np.array([len(block[i]) for i in order])
    y = np.zeros((len(n), n[0]))
    for row, i in enumerate(order):
        y[row, : n[row]] = block[i]
    multiplicative = form == "mul"
    with np.errstate(all="ignore"):
        if form == "trend":
            period = 1
            level, slope = trend_starts(y, n)
            season = np.zeros((len(n), 1))
            points = np.array([(a, b, 0.0) for a in (0.05, 0.2, 0.5, 0.8) for b in (0.0, 0.1, 0.4)])
            tried = [
                np.square(errors(y, n, np.column_stack([np.tile(p, (len(n), 1)), level, slope, season]), 1, False, False)[0]).sum(axis=1)
                for p in points
            ]
            weights = points[np.argmin(np.where(np.isfinite(tried), tried, np.inf), axis=0)]
        else:
            level, slope, season = start_states(y, period, multiplicative)
            weights, _ = search(y, n, period, multiplicative, default_grid(), REFINEMENTS)
        start = np.column_stack([weights, level, slope, season])
        grid = np.square(errors(y, n, start, period, multiplicative, False)[0]).sum(axis=1)
        free = np.ones(start.shape[1], bool)
        if form == "trend":
            free[2] = free[5] = False
        params, sse, converged = fitted(y, n, start, period, multiplicative, free)
        ahead = errors(y, n, params, period, multiplicative, False, horizon)[2]
    out = [None] * len(block)
    for row, i in enumerate(order):
        if np.isfinite(sse[row]) and np.isfinite(ahead[row]).all():
            p = params[row]
            out[i] = {
                "alpha": p[0], "beta": p[1], "share": p[2], "level": p[3], "trend": p[4],
                "season": None if form == "trend" else p[5:], "sse": sse[row], "grid_sse": grid[row],
                "converged": bool(converged[row]), "ahead": ahead[row],
            }
    return out


def estimated(y: Column, horizon: int, period: int) -> Column:
    """Struct of two fits, ``hw_add`` and ``hw_mul``, of a series array.

    A series of at least two seasons gets both seasonal forms; one with a value that is not
    positive has no multiplicative season and gets the additive fit in both. A shorter one gets
    the trend-only form in both. NULL where no fit is finite, and for a null or empty series.
    """

    @F.pandas_udf(f"struct<hw_add:{FIT},hw_mul:{FIT}>")
    def fit(values: pd.Series) -> pd.DataFrame:
        arrays = [None if v is None or not len(v) else np.asarray(v, dtype=float) for v in values]
        found = {"hw_add": [None] * len(arrays), "hw_mul": [None] * len(arrays)}

        def run(ids, form, names):
            # Series of like length share a block.
            ids = sorted(ids, key=lambda i: -len(arrays[i]))
            for lo in range(0, len(ids), BLOCK):
                part = ids[lo : lo + BLOCK]
                for i, one in zip(part, fits([arrays[i] for i in part], period, horizon, form)):
                    for name in names:
                        found[name][i] = one

        usable = [i for i, v in enumerate(arrays) if v is not None]
        long = [i for i in usable if len(arrays[i]) >= 2 * period]
        run([i for i in usable if len(arrays[i]) < 2 * period], "trend", ["hw_add", "hw_mul"])
        run(long, "add", ["hw_add", "hw_mul"])
        run([i for i in long if (arrays[i] > 0).all()], "mul", ["hw_mul"])
        return pd.DataFrame(found)

    return fit(y)
