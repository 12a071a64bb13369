"""Setup evaluation: every rejection and warning of a pattern event, prices, signals.

Rolling marks (tight range, climax, mean range) are windows over the blocks of
the series.  What depends on an event's own stretch of bars (its pullback and the
bars before it) is an equi-join of the event's bar numbers with the bars, at most
``pullback_max_bars + context_lookback`` a event, and one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barkeel.config import Pipeline
from barkeel.functions.bars import clip, to_tick
from barkeel.operators.blocks import SERIES, core, over_block
from barkeel.operators.features import BARS, FEATURES, SCORES, _with_always_in, context_blocks


def spine(bars: DataFrame, cfg: Pipeline = Pipeline()) -> DataFrame:
    """``market_context`` with the rolling marks that setups need."""
    s, w = cfg.setup, over_block()
    rows = context_blocks(bars, cfg)
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    n, m = s.tight_range_lookback, s.climax_lookback
    mean = F.avg("range").over(last(n))
    span = F.max("high").over(last(n)) - F.min("low").over(last(n))
    overlap = F.avg("overlap_previous").over(last(n - 1))
    tight = F.when(mean <= 0, True).otherwise((overlap >= s.tight_range_min_overlap) & (F.try_divide(span, mean) <= s.tight_range_max_span_ranges))
    burst = lambda c: F.sum((F.col("trend_bar") & F.col(c)).cast("int")).over(last(m))
    rows = rows.select(
        "*", ((F.col("bar_index") >= n - 1) & tight).alias("tight_range"),
        ((F.col("bar_index") >= m - 1) & (burst("bull_bar") >= s.climax_min_trend_bars)).alias("bull_climax"),
        ((F.col("bar_index") >= m - 1) & (burst("bear_bar") >= s.climax_min_trend_bars)).alias("bear_climax"),
        F.coalesce(F.try_divide(F.avg("range").over(last(s.context_lookback)), F.abs("close")), F.lit(0.0)).alias("volatility_range_ratio"),
    )
    rows = core(_with_always_in(rows, cfg))
    return rows.select(
        *BARS, "bar_index", "previous_high", "previous_low", *FEATURES, *SCORES, "regime", "always_in",
        "tight_range", "bull_climax", "bear_climax", "volatility_range_ratio", F.lit(cfg.strategy_version).alias("strategy_version"),
    )


def stretches(events: DataFrame, rows: DataFrame, cfg: Pipeline) -> DataFrame:
    """Per event: extremes and mean range of its pullback, nearest level before it."""
    back = cfg.setup.context_lookback
    reach = events.select(*SERIES, F.col("bar_index").alias("signal"), "start_index", "entry", "direction", F.explode(F.sequence(F.greatest(F.col("start_index") - back, F.lit(0)), F.col("bar_index"))).alias("bar_index"))
    joined = reach.join(rows.select(*SERIES, "bar_index", "high", "low", "range"), [*SERIES, "bar_index"])
    inside = F.col("bar_index") >= F.col("start_index")
    return joined.groupBy(*SERIES, "signal", "direction").agg(
        F.max(F.when(inside, F.col("high"))).alias("pullback_high"), F.min(F.when(inside, F.col("low"))).alias("pullback_low"), F.avg(F.when(inside, F.col("range"))).alias("pullback_range"),
        F.min(F.when(~inside & (F.col("high") > F.col("entry")), F.col("high"))).alias("resistance"), F.max(F.when(~inside & (F.col("low") < F.col("entry")), F.col("low"))).alias("support"),
    ).withColumnRenamed("signal", "bar_index")


def prices(direction: Column, cfg: Pipeline) -> tuple[Column, Column]:
    """Stop entry beyond the signal bar and structural stop beyond the pullback, on the tick grid."""
    tick = cfg.market.tick_size
    long = direction == "LONG"
    entry = F.when(long, to_tick(F.col("high") + tick, tick, True)).otherwise(to_tick(F.col("low") - tick, tick, False))
    stop = F.when(long, to_tick(F.col("pullback_low") - tick, tick, False)).otherwise(to_tick(F.col("pullback_high") + tick, tick, True))
    return entry, stop


def target_price(cfg: Pipeline) -> Column:
    """Entry plus the risk in whole ticks times the multiple, rounded away from entry."""
    tick = F.lit(str(cfg.market.tick_size)).cast("decimal(18,9)")
    ticks = F.round(F.col("risk").cast("decimal(28,9)") / tick, 0).cast("decimal(20,0)")
    move = ticks * tick * F.lit(str(cfg.setup.reward_multiple)).cast("decimal(6,3)")
    entry = F.col("entry").cast("decimal(28,9)")
    long = F.col("direction") == "LONG"
    raw = F.when(long, entry + move).otherwise(entry - move).cast("decimal(30,9)") / tick
    return (F.when(long, F.ceil(raw)).otherwise(F.floor(raw)).cast("decimal(20,0)") * tick).cast("double")


def evaluate_setups(events: DataFrame, rows: DataFrame, cfg: Pipeline = Pipeline()) -> DataFrame:
    """Every event with its rejections, warnings, reasons, prices and ``accepted``."""
    s, on = cfg.setup, cfg.modules
    long = F.col("direction") == "LONG"
    side = lambda x: F.when(long, x).otherwise(-x)
    entry, _ = prices(F.col("direction"), cfg)
    e = events.withColumn("entry", entry)
    e = e.join(stretches(e, rows, cfg), [*SERIES, "bar_index", "direction"])
    e = e.withColumn("stop", prices(F.col("direction"), cfg)[1]).withColumn("risk", F.abs(F.col("entry") - F.col("stop")))
    e = e.withColumn("target", target_price(cfg))
    span = F.col("pullback_high") - F.col("pullback_low")
    gap = F.when(long, F.col("resistance") - F.col("entry")).otherwise(F.col("entry") - F.col("support"))
    e = e.select(
        "*", F.when(F.col("pullback_range") > 0, F.try_divide(span, F.col("pullback_range"))).otherwise(0.0).alias("pullback_depth"),
        F.when((F.col("risk") > 0) & (F.col("start_index") > 0), F.try_divide(gap, F.col("risk"))).alias("room_r"),
        side(F.col("trend_score")).alias("raw_context_score"), F.when(long, F.col("bull_climax")).otherwise(F.col("bear_climax")).alias("climax"),
        F.coalesce(F.try_divide(F.col("ema_slope"), F.abs("ema20")), F.lit(0.0)).alias("ema_slope_ratio"),
    )
    e = e.withColumn("context_score", clip(F.col("raw_context_score"), 0.0, 1.0))
    trend = F.when(long, F.col("regime").isin("BULL_TREND", "STRONG_BULL_TREND")).otherwise(F.col("regime").isin("BEAR_TREND", "STRONG_BEAR_TREND"))
    aligned = F.coalesce((side(F.col("distance_to_ema")) > 0) & (side(F.col("ema_slope")) > 0), F.lit(False))
    place = s.minimum_signal_close_location
    weak = F.when(long, F.col("close_location") < place).otherwise(F.col("close_location") > 1.0 - place)
    tight, cramped = F.col("tight_range"), F.coalesce(F.col("room_r") < s.minimum_room_to_target_r, F.lit(False))
    no = F.lit(False)
    # Names of rejections and warnings.
    rejects = [
        ("strategy_module_disabled", F.when(long, F.lit(not on.h2_with_trend)).otherwise(F.lit(not on.l2_with_trend))),
        ("second_entry_pattern_required", F.col("attempt_number") != 2),
        ("market_regime_not_with_trend", ~trend if on.market_regime_filter else no),
        ("ema_not_aligned", ~aligned if on.ema_alignment_filter else no),
        ("pattern_quality_below_minimum", F.col("pattern_score") < s.minimum_pattern_score if on.pattern_quality_filter else no),
        ("context_score_below_minimum", F.col("raw_context_score") < s.minimum_context_score if on.context_quality_filter else no),
        ("signal_bar_body_too_small", F.col("body_ratio") < s.minimum_signal_body_ratio if on.signal_bar_filter else no),
        ("signal_bar_close_too_weak", weak if on.signal_bar_filter else no),
        ("opposite_or_insufficient_pressure", side(F.col("pressure_score")) < s.minimum_directional_pressure if on.pressure_filter else no),
        ("pullback_too_deep", F.col("pullback_depth") > s.maximum_pullback_depth_ranges if on.pullback_depth_filter else no),
        ("tight_trading_range", tight if on.tight_trading_range_filter and s.reject_tight_trading_range else no),
        ("recent_climax", F.col("climax") if on.recent_climax_filter and s.reject_recent_climax else no),
        ("non_positive_initial_risk", F.col("risk") <= 0),
        ("insufficient_room_to_target", cramped if on.room_to_target_filter and s.reject_insufficient_room else no),
    ]
    warns = [
        ("signal_bar_not_directional", ~F.when(long, F.col("bull_bar")).otherwise(F.col("bear_bar"))),
        ("tight_trading_range", tight if on.tight_trading_range_filter and not s.reject_tight_trading_range else no),
        ("recent_climax", F.col("climax") if on.recent_climax_filter and not s.reject_recent_climax else no),
        ("insufficient_room_to_target", cramped if on.room_to_target_filter and not s.reject_insufficient_room else no),
    ]
    listed = lambda pairs: F.array_distinct(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in pairs))))
    e = e.withColumn("rejections", listed(rejects)).withColumn("warnings", listed(warns))
    e = e.withColumn("accepted", F.size("rejections") == 0)
    return e.withColumn("reasons", F.when(F.col("accepted"), F.array(*(F.lit(r) for r in accepted_reasons(cfg)))).otherwise(F.array().cast("array<string>")))


def accepted_reasons(cfg: Pipeline) -> list[str]:
    """The reasons of an accepted setup, which depend on the modules that are on."""
    on = cfg.modules
    both = on.pattern_quality_filter and on.context_quality_filter
    # Names of reasons.
    pairs = [
        ("second_entry_pattern", True), ("market_regime_with_trend", on.market_regime_filter), ("ema_aligned", on.ema_alignment_filter),
        ("context_and_pattern_quality_accepted", both), ("pattern_quality_accepted", on.pattern_quality_filter and not both),
        ("context_quality_accepted", on.context_quality_filter and not both), ("signal_bar_quality_accepted", on.signal_bar_filter),
        ("directional_pressure_accepted", on.pressure_filter), ("pullback_depth_accepted", on.pullback_depth_filter),
        ("trading_range_filter_passed", on.tight_trading_range_filter), ("climax_filter_passed", on.recent_climax_filter), ("room_to_target_accepted", on.room_to_target_filter),
    ]
    return [n for n, yes in pairs if yes]


def require_point_in_time(events: DataFrame, rows: DataFrame, cfg: Pipeline) -> None:
    """Every bar that an event's evaluation looks at must be there, up to its signal bar, with the event's time and version; else an error that names up to ten."""
    first = F.greatest(F.col("start_index") - cfg.setup.context_lookback, F.lit(0))
    need = events.select(*SERIES, F.col("bar_index").alias("_signal"), F.col("timestamp").alias("_at"), F.explode(F.sequence(first, F.col("bar_index"))).alias("bar_index"))
    seen = need.join(rows.select(*SERIES, "bar_index", F.col("timestamp").alias("_time"), "strategy_version"), [*SERIES, "bar_index"], "left")
    wrong = F.col("_time").isNull() | (F.col("_time") > F.col("_at")) | ((F.col("bar_index") == F.col("_signal")) & (F.col("_time") != F.col("_at"))) | (F.col("strategy_version") != cfg.strategy_version)
    bad = seen.where(wrong).select(*SERIES, "_signal", "bar_index").limit(10).collect()
    if bad:
        raise ValueError(f"evaluations without their bars: {[tuple(r) for r in bad]}")


def signals(evaluated: DataFrame, version: str | None = None) -> DataFrame:
    """Accepted evaluations; with a ``version``, evaluations of another one are an error."""
    if version is not None and not evaluated.where(~F.col("strategy_version").eqNullSafe(F.lit(version))).isEmpty():
        raise ValueError(f"evaluations of another version than {version}")
    return evaluated.where("accepted")
