"""Bar features and market context (projections, neighbours, averages, scores, states).

All windows run over blocks (see ``blocks``): one specification, thus one shuffle
and one sort for features and scores together.  The exponential average is a
running sum of powers of its decay inside the block, exact to rounding, so it
needs no Python.

Defined results: bars with null symbol, timeframe, timestamp or price are left
out; duplicate (series, timestamp) bars are the caller's to remove first (see
``validate``); the first bar of a series has no neighbour (flags false, overlap
0), and the slope is null for the first ``ema_slope_lookback`` bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barkeel.config import Pipeline
from barkeel.functions.bars import bar_columns, clip
from barkeel.operators.blocks import SERIES, Blocks, blocked, core, indexed, over_block

FEATURES = [
    "range", "body", "body_ratio", "upper_tail", "lower_tail", "upper_tail_ratio", "lower_tail_ratio", "close_location", "bull_bar", "bear_bar", "doji",
    "trend_bar", "inside_bar", "outside_bar", "higher_high", "higher_low", "lower_high", "lower_low", "overlap_previous", "ema20", "distance_to_ema", "ema_slope",
]
SCORES = ["ema_score", "structure_score", "pressure_score", "overlap_score", "breakout_score", "trend_score"]
BARS = [*SERIES, "timestamp", "open", "high", "low", "close", "volume"]

# Names of regimes and always-in states.
REGIMES = ["STRONG_BULL_TREND", "BULL_TREND", "WEAK_BULL_TREND", "TRADING_RANGE", "WEAK_BEAR_TREND", "BEAR_TREND", "STRONG_BEAR_TREND"]
LONG, SHORT, NEUTRAL = "ALWAYS_IN_LONG", "ALWAYS_IN_SHORT", "NEUTRAL"


def usable(bars: DataFrame) -> DataFrame:
    need = [*SERIES, "timestamp", "open", "high", "low", "close"]
    return bars.select(*BARS).dropna(subset=need)


def _ema(period: int, blocks: Blocks) -> Column:
    """Exponential average from the block's first bar, which seeds it."""
    alpha = 2.0 / (period + 1)
    q = 1.0 - alpha
    if q == 0:
        return F.col("close")
    first = F.greatest(F.col("_blk") * blocks.rows - blocks.halo, F.lit(0))
    i = (F.col("bar_index") - first).cast("double")
    weight = F.when(i == 0, 1.0).otherwise(alpha)
    total = F.sum(weight * F.col("close") * F.pow(F.lit(q), -i)).over(over_block().rowsBetween(W.unboundedPreceding, W.currentRow))
    average = total * F.pow(F.lit(q), i)
    # an average that differs from the close by the rounding of the powers alone is the close: its sign would be noise
    return F.when(F.abs(average - F.col("close")) <= 1e-12 * F.abs("close"), F.col("close")).otherwise(average)


def _with_features(rows: DataFrame, cfg: Pipeline, blocks: Blocks) -> DataFrame:
    w = over_block()
    first = F.col("bar_index") == 0
    ph, pl = F.col("previous_high"), F.col("previous_low")
    known = lambda x: F.coalesce(x, F.lit(False))
    high, low = F.col("high"), F.col("low")
    same = (high == ph) & (low == pl)
    shared = F.greatest(F.least(high, ph) - F.greatest(low, pl), F.lit(0.0))
    joint = F.greatest(high, ph) - F.least(low, pl)
    rows = rows.select("*", F.lag("high").over(w).alias("previous_high"), F.lag("low").over(w).alias("previous_low"), _ema(cfg.trend.ema_period, blocks).alias("ema20"))
    n = cfg.trend.ema_slope_lookback
    rows = rows.select("*", *(c.alias(k) for k, c in bar_columns(cfg.bar).items()), ((F.col("ema20") - F.lag("ema20", n).over(w)) / n).alias("_slope"))
    return rows.select(
        "*",
        known((high <= ph) & (low >= pl) & ~same).alias("inside_bar"), known((high >= ph) & (low <= pl) & ~same).alias("outside_bar"),
        known(high > ph).alias("higher_high"), known(low > pl).alias("higher_low"), known(high < ph).alias("lower_high"), known(low < pl).alias("lower_low"),
        F.when(first | ph.isNull(), 0.0).when(joint == 0, 1.0).otherwise(F.try_divide(shared, joint)).alias("overlap_previous"),
        (F.col("close") - F.col("ema20")).alias("distance_to_ema"),
        F.when(F.col("bar_index") >= n, F.col("_slope")).alias("ema_slope"),
    ).drop("_slope")


def regime_of(score: Column, cfg: Pipeline) -> Column:
    t = cfg.trend
    return (
        F.when(score >= t.strong_threshold, REGIMES[0]).when(score >= t.trend_threshold, REGIMES[1]).when(score > t.neutral_threshold, REGIMES[2])
        .when(score <= -t.strong_threshold, REGIMES[6]).when(score <= -t.trend_threshold, REGIMES[5]).when(score < -t.neutral_threshold, REGIMES[4])
        .otherwise(REGIMES[3])
    )


def _with_scores(rows: DataFrame, cfg: Pipeline) -> DataFrame:
    t, w = cfg.trend, over_block()
    num = lambda c: F.col(c).cast("int").cast("double")
    mean = lambda x, n: F.avg(x).over(w.rowsBetween(-(n - 1), 0))
    bound = lambda x: clip(x, -1.0, 1.0)
    scale = F.abs("ema20")
    part = lambda x, s: F.tanh(F.coalesce(F.try_divide(x, scale), F.lit(0.0)) / s)
    ema = (t.distance_weight * part(F.col("distance_to_ema"), t.distance_scale) + t.slope_weight * part(F.coalesce("ema_slope", F.lit(0.0)), t.slope_scale)) / (t.distance_weight + t.slope_weight)
    direction = num("bull_bar") - num("bear_bar")
    body, place = F.col("body_ratio"), F.col("close_location")
    rows = rows.select(
        "*", ema.alias("_ema"), direction.alias("_dir"),
        F.when(F.col("trend_bar"), direction).otherwise(0.0).alias("_break"),
    )
    before = F.coalesce(F.lag("_break").over(w), F.lit(0.0))
    follow = F.when((F.col("_dir") != 0) & (F.col("_dir") == before), F.col("_dir")).otherwise(0.0)
    rows = rows.withColumn("_burst", 0.5 * F.col("_break") + 0.5 * follow)
    pressure = F.when(F.col("bull_bar"), body * place).when(F.col("bear_bar"), -body * (1.0 - place)).otherwise(0.0)
    structure = (num("higher_high") + num("higher_low") - num("lower_high") - num("lower_low")) / 2.0
    rows = rows.select(
        "*", mean(structure, t.structure_lookback).alias("_st"), mean(pressure, t.pressure_lookback).alias("_pr"),
        mean((1.0 - F.col("overlap_previous")) * F.signum("_ema"), t.overlap_lookback).alias("_ov"), mean(F.col("_burst"), t.breakout_lookback).alias("_br"),
    )
    weights = [(t.ema_weight, "_ema"), (t.structure_weight, "_st"), (t.pressure_weight, "_pr"), (t.overlap_weight, "_ov"), (t.breakout_weight, "_br")]
    trend = sum((k * F.col(c) for k, c in weights[1:]), weights[0][0] * F.col("_ema")) / sum(k for k, _ in weights)
    rows = rows.select("*", *(bound(F.col(c)).alias(s) for (_, c), s in zip(weights, SCORES)), bound(trend).alias("trend_score"))
    return rows.withColumn("regime", regime_of(F.col("trend_score"), cfg)).drop("_ema", "_dir", "_break", "_burst", "_st", "_pr", "_ov", "_br")


def _with_always_in(rows: DataFrame, cfg: Pipeline) -> DataFrame:
    """The last direction that was confirmed by enough equal candidates in a row, ever.

    Inside a block a running value finds it; across blocks the last one of each
    block is carried over the blocks, which are few.
    """
    t, w = cfg.trend, over_block()
    score, ema, structure = F.col("trend_score"), F.col("ema_score"), F.col("structure_score")
    candidate = (
        F.when((score >= t.always_in_threshold) & (ema > 0) & (structure >= 0), LONG)
        .when((score <= -t.always_in_threshold) & (ema < 0) & (structure <= 0), SHORT).otherwise(NEUTRAL)
    )
    rows = rows.withColumn("_cand", candidate)
    rows = rows.withColumn("_turn", F.when(~F.lag("_cand").over(w).eqNullSafe(F.col("_cand")), F.col("bar_index")))
    run = F.col("bar_index") - F.last("_turn", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)) + 1
    rows = rows.withColumn("_conf", F.when((F.col("_cand") != NEUTRAL) & (run >= t.always_in_bars), F.col("_cand")))
    rows = rows.withColumn("_state", F.last("_conf", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    ends = rows.where("_core").groupBy(*SERIES, "_blk").agg(F.max_by("_conf", F.when(F.col("_conf").isNotNull(), F.col("bar_index"))).alias("_end"))
    over_blocks = W.partitionBy(*SERIES).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(*SERIES, "_blk", F.last("_end", ignorenulls=True).over(over_blocks).alias("_carry"))
    joined = rows.join(carry, [*SERIES, "_blk"], "left")
    return joined.withColumn("always_in", F.coalesce("_state", "_carry", F.lit(NEUTRAL))).drop("_cand", "_turn", "_conf", "_state", "_carry")


def feature_blocks(bars: DataFrame, cfg: Pipeline = Pipeline()) -> tuple[DataFrame, Blocks]:
    blocks = Blocks().for_period(cfg.trend.ema_period)
    return _with_features(blocked(indexed(usable(bars), blocks), blocks), cfg, blocks), blocks


def bar_features(bars: DataFrame, cfg: Pipeline = Pipeline()) -> DataFrame:
    """Bars with bar_index and the feature columns."""
    rows, _ = feature_blocks(bars, cfg)
    return core(rows).select(*BARS, "bar_index", *FEATURES)


def context_blocks(bars: DataFrame, cfg: Pipeline = Pipeline()) -> DataFrame:
    """Features, scores, regime and always-in state, still in blocks with halo."""
    rows, _ = feature_blocks(bars, cfg)
    return _with_scores(rows, cfg)


def market_context(bars: DataFrame, cfg: Pipeline = Pipeline()) -> DataFrame:
    """Bars with features, scores, regime, always_in and strategy_version."""
    rows = core(_with_always_in(context_blocks(bars, cfg), cfg))
    return rows.select(*BARS, "bar_index", "previous_high", "previous_low", *FEATURES, *SCORES, "regime", "always_in", F.lit(cfg.strategy_version).alias("strategy_version"))
