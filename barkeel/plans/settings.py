"""Settings of the registered market queries."""

from __future__ import annotations

from barkeel.config import ExecutionConfig, MarketConfig, Pipeline, SetupConfig, StatisticsConfig

# the bars of the events are small prices that jump, so the filters are set wide enough to let signals through
WIDE = Pipeline(
    setup=SetupConfig(minimum_context_score=0.0, minimum_directional_pressure=-1.0, minimum_pattern_score=0.0, minimum_signal_body_ratio=0.0, minimum_signal_close_location=0.5, maximum_pullback_depth_ranges=50.0, reject_tight_trading_range=False),
    market=MarketConfig(0.01, 1.0), execution=ExecutionConfig(slippage_ticks=1, commission=0.25), statistics=StatisticsConfig(minimum_sample=5),
)

# the delivered bars run with the default filters
SHIPPED = Pipeline(market=MarketConfig(0.01, 1.0), execution=ExecutionConfig(slippage_ticks=1, commission=0.25), statistics=StatisticsConfig(minimum_sample=5))
