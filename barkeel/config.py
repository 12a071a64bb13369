"""Settings of the market pipeline, with their defaults, limits and loading (frozen dataclasses)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


# The defaults of all settings below, on which results depend.
@dataclass(frozen=True)
class BarConfig:
    doji_body_ratio: float = 0.20
    strong_body_ratio: float = 0.65
    strong_close_threshold: float = 0.75
    minimum_range: float = 0.0

    def __post_init__(self) -> None:
        _need(self.doji_body_ratio < self.strong_body_ratio, "doji_body_ratio must be below strong_body_ratio")


@dataclass(frozen=True)
class TrendConfig:
    ema_period: int = 20
    ema_slope_lookback: int = 5
    distance_scale: float = 0.01
    slope_scale: float = 0.001
    distance_weight: float = 0.5
    slope_weight: float = 0.5
    structure_lookback: int = 5
    pressure_lookback: int = 10
    overlap_lookback: int = 10
    breakout_lookback: int = 10
    strong_threshold: float = 0.70
    trend_threshold: float = 0.30
    neutral_threshold: float = 0.10
    always_in_threshold: float = 0.45
    always_in_bars: int = 2
    ema_weight: float = 0.20
    structure_weight: float = 0.25
    pressure_weight: float = 0.20
    overlap_weight: float = 0.15
    breakout_weight: float = 0.20

    def __post_init__(self) -> None:
        _need(0 <= self.neutral_threshold < self.trend_threshold < self.strong_threshold <= 1, "thresholds must ascend")
        _need(self.ema_weight + self.structure_weight + self.pressure_weight + self.overlap_weight + self.breakout_weight > 0, "weights must be positive in total")
        _need(self.ema_period >= 1 and self.ema_slope_lookback >= 1 and self.always_in_bars >= 1, "lengths must be positive")


@dataclass(frozen=True)
class PatternConfig:
    pullback_min_bars: int = 1
    pullback_max_bars: int = 20
    context_weight: float = 0.50
    signal_close_weight: float = 0.30
    directional_body_weight: float = 0.20

    def __post_init__(self) -> None:
        _need(1 <= self.pullback_min_bars <= self.pullback_max_bars, "pullback_max_bars must be at least pullback_min_bars")


@dataclass(frozen=True)
class Modules:
    """Switches of the setup filters, in catalogue order."""

    h2_with_trend: bool = True
    l2_with_trend: bool = True
    market_regime_filter: bool = True
    ema_alignment_filter: bool = True
    pattern_quality_filter: bool = True
    context_quality_filter: bool = True
    signal_bar_filter: bool = True
    pressure_filter: bool = True
    pullback_depth_filter: bool = True
    tight_trading_range_filter: bool = True
    recent_climax_filter: bool = True
    room_to_target_filter: bool = True

    def enabled(self) -> tuple[str, ...]:
        return tuple(f.name for f in fields(self) if getattr(self, f.name))


@dataclass(frozen=True)
class SetupConfig:
    minimum_pattern_score: float = 0.20
    minimum_context_score: float = 0.30
    minimum_signal_body_ratio: float = 0.20
    minimum_signal_close_location: float = 0.55
    minimum_directional_pressure: float = 0.0
    maximum_pullback_depth_ranges: float = 8.0
    context_lookback: int = 20
    tight_range_lookback: int = 10
    tight_range_min_overlap: float = 0.65
    tight_range_max_span_ranges: float = 4.0
    climax_lookback: int = 10
    climax_min_trend_bars: int = 4
    minimum_room_to_target_r: float = 1.0
    reject_tight_trading_range: bool = True
    reject_recent_climax: bool = False
    reject_insufficient_room: bool = False
    exit_mode: str = "2R"
    reward_multiple: float = 2.0

    def __post_init__(self) -> None:
        _need(self.climax_min_trend_bars <= self.climax_lookback, "climax_min_trend_bars cannot exceed climax_lookback")
        _need({"1R": 1.0, "2R": 2.0}.get(self.exit_mode) == self.reward_multiple, "reward_multiple must match exit_mode")


@dataclass(frozen=True)
class MarketConfig:
    tick_size: float = 0.01
    point_value: float = 1.0

    def __post_init__(self) -> None:
        _need(self.tick_size > 0 and self.point_value > 0, "tick_size and point_value must be positive")


@dataclass(frozen=True)
class ExecutionConfig:
    slippage_ticks: int = 1
    commission: float = 0.0
    policy: str = "adverse"
    expiry_bars: int = 1
    initial_cash: float = 100_000.0
    risk_per_trade: float = 0.005
    close_at_end: bool = True

    def __post_init__(self) -> None:
        _need(self.policy in ("adverse", "favorable"), "policy must be adverse or favorable")
        _need(self.slippage_ticks >= 0 and self.commission >= 0 and self.expiry_bars >= 1, "execution limits")


@dataclass(frozen=True)
class StatisticsConfig:
    minimum_sample: int = 30
    body_weight: float = 0.5
    close_weight: float = 0.5
    quality_weak: float = 0.50
    quality_strong: float = 0.75
    slope_flat: float = 0.0001
    slope_strong: float = 0.0005
    volatility_low: float = 0.0025
    volatility_high: float = 0.0075
    zone: str = "America/New_York"
    session_minutes: tuple[int, int, int, int] = (570, 630, 900, 960)

    def __post_init__(self) -> None:
        _need(self.quality_weak < self.quality_strong and self.slope_flat < self.slope_strong and self.volatility_low < self.volatility_high, "bucket limits must ascend")


@dataclass(frozen=True)
class KnowledgeConfig:
    target_characters: int = 900
    maximum_characters: int = 1400
    overlap_paragraphs: int = 1
    dimension: int = 1024
    word_ngrams: int = 2
    character_ngram: int = 3
    top_k: int = 5


# Tick size and point value per market.
MARKETS = {
    "ES": MarketConfig(0.25, 50.0), "MES": MarketConfig(0.25, 5.0), "SPY": MarketConfig(), "AAPL": MarketConfig(),
    "QQQ": MarketConfig(), "DIA": MarketConfig(), "IWM": MarketConfig(),
}


@dataclass(frozen=True)
class Pipeline:
    """All settings of one run; ``strategy_version`` is a column of every output."""

    strategy_version: str = "0.7.0-phase7"
    bar: BarConfig = field(default_factory=BarConfig)
    trend: TrendConfig = field(default_factory=TrendConfig)
    patterns: PatternConfig = field(default_factory=PatternConfig)
    setup: SetupConfig = field(default_factory=SetupConfig)
    modules: Modules = field(default_factory=Modules)
    market: MarketConfig = field(default_factory=MarketConfig)
    execution: ExecutionConfig = field(default_factory=ExecutionConfig)
    statistics: StatisticsConfig = field(default_factory=StatisticsConfig)
    knowledge: KnowledgeConfig = field(default_factory=KnowledgeConfig)

    def __post_init__(self) -> None:
        _need(bool(self.strategy_version.strip()), "strategy_version must not be empty")


def build(kind: type, values: Mapping[str, Any] | None = None, **overrides: Any) -> Any:
    """A settings object from nested mappings; unknown keys are errors."""
    given = {**(values or {}), **overrides}
    types = get_type_hints(kind)
    known = {f.name for f in fields(kind)}
    _need(set(given) <= known, f"unknown settings: {sorted(set(given) - known)}")
    made = {k: build(types[k], v) if is_dataclass(types[k]) and isinstance(v, Mapping) else v for k, v in given.items()}
    return kind(**made)


def load(path: str) -> Pipeline:
    """Settings from a YAML or JSON file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        raw = yaml.safe_load(text)
    except ImportError:
        import json

        raw = json.loads(text)
    _need(isinstance(raw, Mapping), "settings must be a mapping")
    return build(Pipeline, raw)
