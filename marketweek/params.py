"""Parameters of the pipeline, one frozen dataclass per stage."""

from __future__ import annotations

from dataclasses import dataclass, field

# Horizon, season length, folds, windows and thresholds that define the results.
HORIZON = 4
PERIOD = 52
MIN_TRAIN_RATIO = 0.5
CLIP_MIN = 0.0
BACKTEST_FOLDS = 3
ROLLMEAN_WINDOW = 8
PRICE_QTY_LAGS = (1, 2, 4, 8, 12, 52)
ROLLING_WINDOWS = (4, 8, 12, 26, 52)
VOLATILITY_WINDOWS = (4, 8, 12)
PRICE_DISCOUNT_THRESHOLD = 0.15
TOP_K = 5
SUPPLY_WEEKS = 4
# end of fixed values


@dataclass(frozen=True)
class ForecastParams:
    """Backtest and forecast settings shared by the per-item models.

    ``smoothing`` is ``estimated`` (weights and start states by least squares) or ``grid``
    (weights from a refined grid, start states by rule), which SQL can repeat.
    """

    horizon: int = HORIZON
    period: int = PERIOD
    min_train_ratio: float = MIN_TRAIN_RATIO
    folds: int = BACKTEST_FOLDS
    window: int = ROLLMEAN_WINDOW
    clip_min: float = CLIP_MIN
    smoothing: str = "estimated"


@dataclass(frozen=True)
class FeatureParams:
    """Look-back sizes of the weekly feature table."""

    lags: tuple[int, ...] = PRICE_QTY_LAGS
    windows: tuple[int, ...] = ROLLING_WINDOWS
    vol_windows: tuple[int, ...] = VOLATILITY_WINDOWS


@dataclass(frozen=True)
class SubstituteParams:
    """Rules of the substitute recommendation."""

    price_discount_threshold: float = PRICE_DISCOUNT_THRESHOLD
    top_k: int = TOP_K
    supply_quantile: float = 0.5
    volatility_quantile: float = 0.75


@dataclass(frozen=True)
class GbmParams:
    """Settings of the global boosted-tree model.

    ``max_depth=6`` stands for 63 leaves.
    """

    learning_rate: float = 0.05
    max_depth: int = 6
    min_child_samples: int = 30
    feature_fraction: float = 0.85
    subsample: float = 0.9
    seed: int = 42
    rounds: int = 100
    extra_features: tuple[str, ...] = field(default_factory=tuple)
