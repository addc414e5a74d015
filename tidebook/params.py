"""Plain parameter records; the operators take these instead of configuration files."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SessionParams:
    """A daily trading window in local time and the decision clock inside it."""

    zone: str = "America/New_York"
    start: str = "09:35:00"
    end: str = "15:55:00"
    grid_ms: int = 100
    max_age_ms: int = 500


@dataclass(frozen=True)
class BookParams:
    """Lookbacks and horizons of the book study, all in milliseconds."""

    depth_levels: tuple[int, ...] = (1, 5, 10)
    depth_decay: float = 0.5
    flow_ms: tuple[int, ...] = (100, 500, 1000)
    trade_ms: tuple[int, ...] = (100, 500, 1000)
    intensity_ms: int = 1000
    return_ms: int = 1000
    horizons_ms: tuple[int, ...] = (100, 250, 500, 1000)
    tick: float = 0.25


@dataclass(frozen=True)
class Contract:
    """Contract terms that definitions are checked against."""

    tick: float
    multiplier: float
    tolerance: float = 1e-9


@dataclass(frozen=True)
class SplitRange:
    """An inclusive range of dates (or date ids) that belongs to one split."""

    name: str
    first: object
    last: object


@dataclass(frozen=True)
class AuctionParams:
    """Grid, lags and windows of the closing-auction panel, in seconds."""

    closing_second: int = 600
    step: int = 10
    lags: tuple[int, ...] = (10, 30, 60)
    windows: tuple[int, ...] = (30, 60)
    ranked: tuple[str, ...] = ("wap_mid_gap_bps", "auction_imbalance_ratio", "spread_bps")


@dataclass(frozen=True)
class TradingRule:
    """Eligibility and cost terms of the cross-sectional long/short rule."""

    quantile: float
    min_prediction_bps: float
    max_spread_bps: float
    min_liquidity: float
    fee_bps: float
