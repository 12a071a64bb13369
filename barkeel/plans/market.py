"""Queries of the market pipeline, with their SQL.

A stage runs over two inputs: bars made from the ``events`` table, with wide filters,
and the delivered bars of ``sample_ohlcv`` (``ohlcv_`` before the stage's name), with
the default filters.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barkeel.config import Pipeline, StatisticsConfig
from barkeel.functions.bars import expected_value, label, risk_reward, slug
from barkeel.operators import execution, features, patterns, sessions, setups, statistics, validate, views
from barkeel.operators.blocks import SERIES, indexed
from barkeel.operators.clock import certain_instants
from barkeel.plans.market_sql import ORACLE as _SQL
from barkeel.plans.market_sql import delivered
from barkeel.plans.settings import SHIPPED, WIDE
from barkeel.plans.tables import table
from barkeel.session import durable

SHIFT = 100.0
Source = Callable[[SparkSession, str], DataFrame]


def event_bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars per event type; prices are moved up so that none is near zero."""
    e = table(spark, d, "events").where("ts is not null and value is not null and event_type is not null")
    e = e.select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("value") + SHIFT).alias("price"))
    return sessions.tick_bars(e, "event_type", "ts", "price", "event_id", "hour", "1h")


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _valid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_ohlcv").withColumn("reason", validate.reject_reason()).where("reason is null")


def _clean(spark: SparkSession, d: str) -> DataFrame:
    """sample_ohlcv without rows that are no bars, re-sent bars once."""
    return validate.keep_last(_valid(spark, d), "received_at", "bar_id")


def settings(bars: Source) -> Pipeline:
    return SHIPPED if bars is _clean else WIDE


def _spine(spark: SparkSession, d: str, bars: Source) -> DataFrame:
    return setups.spine(bars(spark, d), settings(bars))


def _stages(spark: SparkSession, d: str, bars: Source = event_bars) -> tuple[DataFrame, DataFrame]:
    """The spine, written once as several stages read it, and all evaluations."""
    rows = durable(_spine(spark, d, bars))
    return rows, setups.evaluate_setups(patterns.pattern_events(rows, settings(bars)), rows, settings(bars))


def _simulated(spark: SparkSession, d: str, bars: Source) -> tuple[DataFrame, DataFrame]:
    rows, evaluated = _stages(spark, d, bars)
    accepted = durable(setups.signals(evaluated))
    return execution.simulate(rows, accepted, settings(bars)), accepted


def _trades(spark: SparkSession, d: str, bars: Source) -> DataFrame:
    return execution.trade_log(*_simulated(spark, d, bars), settings(bars))


def ohlcv_bars(spark: SparkSession, d: str) -> DataFrame:
    return event_bars(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def ohlcv_validate_rejects(spark: SparkSession, d: str) -> DataFrame:
    judged = table(spark, d, "sample_ohlcv").withColumn("reason", validate.reject_reason())
    return judged.where("reason is not null").select("bar_id", "reason")


def ohlcv_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return validate.duplicates(table(spark, d, "sample_ohlcv")).select(*SERIES, F.unix_micros("timestamp").alias("ts_us"), "copies")


def ohlcv_dedupe_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return validate.keep_last(table(spark, d, "sample_ohlcv"), "received_at", "bar_id").select("bar_id")


def session_resample(spark: SparkSession, d: str) -> DataFrame:
    """The half-hour series to hours; all intraday series are in ohlcv_resample."""
    bars = sessions.resample(_clean(spark, d).where("timeframe = '30m'"), 60)
    return bars.select("symbol", "timeframe", F.unix_seconds("timestamp").alias("ts_s"), "open", "high", "low", "close", F.round("volume", 4).alias("volume"))


def ohlcv_resample(spark: SparkSession, d: str) -> DataFrame:
    """Every delivered intraday series to each coarser timeframe, with the timeframe it came from."""
    bars = sessions.resample_each(_clean(spark, d))
    return bars.select("symbol", "source_timeframe", "timeframe", F.unix_seconds("timestamp").alias("ts_s"), "open", "high", "low", "close", F.round("volume", 4).alias("volume"))


def session_coverage(spark: SparkSession, d: str) -> DataFrame:
    """First and last bar, count and mean volume per series."""
    c = statistics.coverage(_clean(spark, d))
    return c.select(*SERIES, F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "last_close", "n_bars", F.round("mean_volume", 4).alias("mean_volume"))


def bar_features(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    f = features.bar_features(bars(spark, d), settings(bars))
    cols = [c for c in features.FEATURES if c not in ("ema20", "distance_to_ema", "ema_slope")]
    nums = [c for c in cols if dict(f.dtypes)[c] == "double"]
    return _round(f.select(*keys, "bar_index", *cols), *nums, digits=9)


def sample_bar_features(spark: SparkSession, d: str) -> DataFrame:
    """Class counts of all series of the delivered bars."""
    f = features.bar_features(_clean(spark, d), WIDE)
    return f.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("bars"), *(F.count_if(F.col(c)).alias(f"n_{c}") for c in ("trend_bar", "doji", "inside_bar", "outside_bar", "higher_high", "lower_low")))


def bar_class_counts(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    f = features.bar_features(bars(spark, d), settings(bars))
    return f.groupBy(*keys).agg(F.count(F.lit(1)).alias("bars"), *(F.count_if(F.col(c)).alias(f"n_{c}") for c in ("trend_bar", "doji", "inside_bar", "outside_bar")))


def ema_slope(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    f = features.bar_features(bars(spark, d), settings(bars))
    return _round(f.select(*keys, "bar_index", "ema20", "distance_to_ema", "ema_slope"), "ema20", "distance_to_ema", "ema_slope")


def context_scores(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _round(_spine(spark, d, bars).select(*keys, "bar_index", *features.SCORES), *features.SCORES)


def regime_labels(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _spine(spark, d, bars).groupBy(*keys, "regime").agg(F.count(F.lit(1)).alias("bars"))


def always_in_state(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _spine(spark, d, bars).select(*keys, "bar_index", "always_in")


def pattern_events(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    e = patterns.pattern_events(durable(_spine(spark, d, bars)), settings(bars))
    return _round(e.select(*keys, "bar_index", "pattern_type", "direction", "start_index", "pullback_bars", "trigger_price", "pattern_score"), "trigger_price", "pattern_score")


def pattern_transitions(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    t = patterns.detect(durable(_spine(spark, d, bars)), settings(bars)).where("kind = 'transition'")
    return t.groupBy(*keys, "detector", "condition").agg(F.count(F.lit(1)).alias("n"))


def setup_evaluations(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    _, e = _stages(spark, d, bars)
    e = e.select(*keys, "bar_index", "pattern_type", "accepted", F.array_join("rejections", ",").alias("rejections"), F.array_join("warnings", ",").alias("warnings"), "entry", "stop", "target", "pullback_depth", "room_r")
    return _round(e, "entry", "stop", "target", "pullback_depth", "room_r")


def setup_rejection_counts(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    _, e = _stages(spark, d, bars)
    return e.select(*keys, F.explode("rejections").alias("reason")).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


def tight_range_flags(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _spine(spark, d, bars).where("tight_range").select(*keys, "bar_index")


def climax_flags(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _spine(spark, d, bars).where("bull_climax or bear_climax").select(*keys, "bar_index", "bull_climax", "bear_climax")


def signals(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    _, e = _stages(spark, d, bars)
    s = setups.signals(e).select(*keys, "bar_index", "direction", "entry", "stop", "target", F.array_join("reasons", "; ").alias("reasons"))
    return _round(s, "entry", "stop", "target")


def expected_values(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Expected value of every signal at even odds, and its risk and reward."""
    _, e = _stages(spark, d, bars)
    risk, reward, ratio = risk_reward(F.col("entry"), F.col("stop"), F.col("target"))
    ev, ev_r = expected_value(F.lit(0.5), reward, risk, F.lit(0.02))
    s = setups.signals(e).select(*keys, "bar_index", risk.alias("risk"), reward.alias("reward"), ratio.alias("ratio"), ev.alias("ev"), ev_r.alias("ev_r"))
    return _round(s, "risk", "reward", "ratio", "ev", "ev_r")


def orders(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    sim, _ = _simulated(spark, d, bars)
    return sim.groupBy(*keys, "status", F.coalesce("exit_reason", "rejection").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def order_history(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Every state of every order, entries and exits."""
    states = execution.order_history(_simulated(spark, d, bars)[0])
    cols = [*keys, "order_id", "seq", F.unix_seconds("at").alias("at_s"), "direction", "order_type", "quantity", "price", "status", F.unix_seconds("filled_at").alias("filled_s"), "filled_price", "rejection"]
    return _round(states.select(*cols), "price", "filled_price")


def order_latest_state(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return execution.order_states(execution.order_history(_simulated(spark, d, bars)[0])).select(*keys, "order_id", "order_type", "status", "rejection")


def trade_log(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    t = _trades(spark, d, bars).select("trade_id", *keys, "setup", "direction", "entry_price", "exit_price", "quantity", "pnl", "pnl_r", "mfe", "mae", "bars_held", "signal_bar_index", "exit_reason")
    return _round(t, "entry_price", "exit_price", "pnl", "pnl_r", "mfe", "mae")


def equity_curve(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return _round(execution.equity_curve(_trades(spark, d, bars), settings(bars)).select(*keys, "trade_id", "pnl", "cash"), "pnl", "cash")


def mfe_mae_excursion(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Excursions recomputed from the bars by a range join."""
    rows, evaluated = _stages(spark, d, bars)
    sim = execution.simulate(rows, setups.signals(evaluated), settings(bars))
    return _round(statistics.excursions(sim.where("status = 'FILLED'"), rows), "mfe", "mae")


def _conditions(spark: SparkSession, d: str, trades: DataFrame) -> DataFrame:
    """Completed trades with condition buckets, the session by the one instant that the entry time's text denotes."""
    read = certain_instants(table(spark, d, "trade_log"), "row_id", "entry_time", table(spark, d, "feeds"))
    clocks = read.select(F.col("row_id").alias("_id"), F.timestamp_micros("utc_us").alias("_entry"))
    done = statistics.completed(trades)
    timed = done.join(clocks, done["row_id"] == clocks["_id"], "left")
    return timed.withColumns(statistics.condition_columns(StatisticsConfig(), F.col("_entry"))).drop("_id", "_entry")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each delivered trade, if completed, with condition buckets."""
    return _conditions(spark, d, statistics.latest(table(spark, d, "trade_log"), "row_id"))


def trade_condition_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Buckets of every completed row, re-sent ones too."""
    return _conditions(spark, d, table(spark, d, "trade_log")).select("row_id", "signal_bar_quality", "ema_slope_bucket", "session", "volatility_regime")


def _mean(df: DataFrame, column: str, count: str) -> DataFrame:
    """A mean as its sum, to six digits, by its count: the same number whatever order the sum had."""
    return df.withColumn(column, F.try_divide(F.round(F.col(column) * F.col(count), 6), F.col(count)))


def setup_statistics_7_scopes(spark: SparkSession, d: str) -> DataFrame:
    s = statistics.setup_statistics(_log(spark, d))
    for column, count in (("avg_win_r", "wins"), ("avg_loss_r", "losses"), ("avg_r", "total"), ("expectancy_r", "total")):
        s = _mean(s, column, count)
    return _round(s, "profit_factor", "max_drawdown", "median_mfe", "median_mae", "median_mfe_r", "median_mae_r", digits=9)


def setup_statistics_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    s = statistics.grouping_set_statistics(_log(spark, d))
    return s.groupBy("symbol", "timeframe", "pattern_type", "market_regime", "scope_bits").agg(F.sum("total").alias("total"), F.sum("wins").alias("wins")).drop("scope_bits")


def backtest_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = statistics.backtest_metrics(_log(spark, d), 100_000.0, ["symbol"])
    return _round(_mean(m, "expectancy_r", "total_trades"), "net_pnl", "total_return", "profit_factor", "max_drawdown", digits=9)


def empirical_probability(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    asked = log.select(*SERIES, "strategy_version", "pattern_type", "market_regime").distinct()
    return statistics.empirical_probability(asked, statistics.setup_statistics(log))


def trade_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Completed trades of each series: span, count, sum of results, win rate."""
    c = statistics.trade_coverage(statistics.completed(statistics.latest(table(spark, d, "trade_log"), "row_id")))
    return c.select(*SERIES, F.unix_micros("first_exit").alias("first_us"), F.unix_micros("last_exit").alias("last_us"), "n_trades", F.round("pnl", 6).alias("pnl"), "win_rate")


def stats_labels(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "trade_log").select("pattern_type", "market_regime").distinct()
    return t.select("pattern_type", "market_regime", label(F.col("pattern_type"), F.col("market_regime")).alias("label"), slug(label(F.col("pattern_type"), F.col("market_regime"))).alias("slug"))


def chart_window(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The last 50 bars of each event type."""
    rows = indexed(bars(spark, d))
    return views.chart_window(rows, 50).select(*keys, "bar_index", "close")


def chart_markers(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Entries and exits of the simulated trades among the last 2000 bars."""
    trades = durable(_trades(spark, d, bars))
    marks = views.trade_markers(trades, views.chart_window(indexed(bars(spark, d)), 2000))
    return marks.select(*keys, "trade_id", "kind", F.unix_seconds("at").alias("at_s"), F.round("price", 6).alias("price"))


def dimension_values(spark: SparkSession, d: str) -> DataFrame:
    return views.dimension_values(table(spark, d, "trade_log"), "market_regime")


def filtered_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Samples of the pattern-and-regime scope for one regime."""
    s = views.filter_statistics(statistics.setup_statistics(_log(spark, d)), scope="PATTERN_REGIME", market_regime="BULL_TREND", pattern_type="All")
    return s.select(*SERIES, "strategy_version", "pattern_type", "total", "wins")


def session_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Expected minutes and first minute of each New York session of four months."""
    minutes = sessions.expected_minutes(sessions.session_table(spark, dt.date(2025, 8, 1), dt.date(2025, 11, 30)))
    return minutes.groupBy(F.date_format("session_date", "yyyy-MM-dd").alias("session_date")).agg(F.count(F.lit(1)).alias("minutes"), F.unix_seconds(F.min("timestamp")).alias("open_s"))


def session_minute_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Per delivered intraday series, minutes of New York sessions without a reading and minutes with one outside them, over the dates of all readings."""
    bars = _valid(spark, d).where(F.col("timeframe").endswith("m")).select(*SERIES, F.date_trunc("minute", "timestamp").alias("timestamp"))
    day = F.to_date(F.from_utc_timestamp("timestamp", sessions.ZONE))
    first, last = bars.agg(F.min(day), F.max(day)).first()
    calendar = sessions.session_table(spark, first or dt.date(2025, 1, 2), last or dt.date(2025, 1, 2))
    return sessions.minute_differences(bars, calendar).groupBy(*SERIES, "kind").agg(F.count(F.lit(1)).alias("n"))


def ohlcv_minute_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Per delivered 1m series and UTC day, planned minutes without a bar and minutes with a bar outside the planned sessions."""
    gaps = sessions.planned_differences(_valid(spark, d).where("timeframe = '1m'"), table(spark, d, "session_plan").where("timeframe = '1m'"))
    return gaps.groupBy(*SERIES, F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "kind").agg(F.count(F.lit(1)).alias("n"))


NAMES = [
    ohlcv_bars, ohlcv_validate_rejects, ohlcv_duplicate_keys, ohlcv_dedupe_keep_last, session_resample, ohlcv_resample, session_coverage, bar_features, sample_bar_features, bar_class_counts,
    ema_slope, context_scores, regime_labels, always_in_state, pattern_events, pattern_transitions, setup_evaluations, setup_rejection_counts, tight_range_flags, climax_flags,
    signals, expected_values, orders, order_history, order_latest_state, trade_log, equity_curve, mfe_mae_excursion, trade_condition_buckets, setup_statistics_7_scopes,
    setup_statistics_grouping_sets, backtest_metrics, empirical_probability, trade_coverage, stats_labels, chart_window, chart_markers, dimension_values, filtered_statistics, session_minutes,
    session_minute_gaps, ohlcv_minute_gaps,
]
STAGES = [
    bar_features, bar_class_counts, ema_slope, context_scores, regime_labels, always_in_state, pattern_events, pattern_transitions, setup_evaluations, setup_rejection_counts,
    tight_range_flags, climax_flags, signals, expected_values, orders, order_history, order_latest_state, trade_log, equity_curve, mfe_mae_excursion, chart_window, chart_markers,
]
QUERIES: dict[str, Source] = {f.__name__: f for f in NAMES} | {f"ohlcv_{f.__name__}": partial(f, bars=_clean, keys=SERIES) for f in STAGES}

ORACLE = _SQL | {f"ohlcv_{f.__name__}": delivered(_SQL[f.__name__]) for f in STAGES if f.__name__ in _SQL}

__all__ = ["ORACLE", "QUERIES"]
