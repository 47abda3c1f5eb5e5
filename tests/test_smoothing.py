import numpy as np
import pytest

from marketweek.functions import smoothing as s


def plain(y, alpha, beta, share, period, multiplicative, horizon):
    """The recursion for one series, value by value."""
    level, trend, season = (v[0] for v in s.start_states(np.array([y], float), period, multiplicative))
    season, gamma, sse = list(season), share * (1 - alpha), 0.0
    for t, value in enumerate(y):
        base, k = level + trend, season[t % period]
        error = value - (base * k if multiplicative else base + k)
        gain = alpha * error / k if multiplicative else alpha * error
        season[t % period] = k + (gamma * error / base if multiplicative else gamma * error)
        level, trend, sse = base + gain, trend + beta * gain, sse + error * error
    out = []
    for h in range(horizon):
        line, k = level + (h + 1) * trend, season[(len(y) + h) % period]
        out.append(line * k if multiplicative else line + k)
    return sse, out


@pytest.mark.parametrize("multiplicative", [False, True])
def test_block_of_different_lengths_equals_plain_recursion(multiplicative):
    rng = np.random.default_rng(0)
    block = [20 + rng.uniform(-3, 3, n) for n in (17, 30, 12, 30)]
    grid = np.array([(0.3, 0.1, 0.2), (0.7, 0.0, 0.5)])
    got = s.best_forecasts(block, 6, 3, multiplicative, grid, 0)
    for y, f in zip(block, got):
        fits = [plain(y, *p, 6, multiplicative, 3) for p in grid]
        assert np.allclose(f, min(fits)[1])


@pytest.mark.parametrize("multiplicative", [False, True])
def test_exact_recovery_without_noise(multiplicative):
    period, t = 8, np.arange(1, 45)
    shape = np.array([0.7, 0.9, 1.2, 1.2, 1.1, 1.0, 0.9, 1.0])
    season = (shape if multiplicative else 10 * (shape - 1))[(t - 1) % period]
    line = 50 + 0.5 * t
    y = line * season if multiplicative else line + season
    f = s.best_forecasts([y[:40]], period, 4, multiplicative, s.default_grid(), s.REFINEMENTS)[0]
    if multiplicative:  # the starting line is estimated from seasonal means, so nearly exact
        assert np.allclose(f, y[40:], rtol=0.02)
    else:
        assert np.allclose(f, y[40:])


def test_refinement_never_fits_worse():
    rng = np.random.default_rng(5)
    y = 30 + 5 * np.sin(np.arange(60) * 2 * np.pi / 12) + rng.normal(0, 1, 60)
    n = np.array([60])

    def least(refinements):
        f = s.best_forecasts([y], 12, 1, False, s.default_grid(), refinements)
        return f[0]

    sse, _ = s.smooth(y[None], n, s.default_grid()[None], 12, False)
    assert np.isfinite(sse).all() and np.isfinite(least(3)).all()


def test_series_without_a_finite_fit_gives_none():
    y = np.full(24, np.nan)
    assert s.best_forecasts([y], 6, 2, False, s.default_grid(), 1) == [None]
