"""Statistics of closed trades: conditional scopes, metrics, buckets, excursions.

Order-free measures are plain aggregates.  Drawdown depends on order, but is a
monoid: a stretch of results is its sum, highest and lowest running sum and its
own drawdown.  Stretches of a month are reduced by windows and then joined in
order, so a group that holds most trades is never sorted in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barkeel.config import StatisticsConfig
from barkeel.operators.blocks import SERIES

DIMENSIONS = ["pattern_type", "market_regime", "signal_bar_quality", "ema_slope_bucket", "session", "volatility_regime"]

# Scopes and the dimensions that each of them has.
SCOPES = {
    "OVERALL": [], "PATTERN": ["pattern_type"], "PATTERN_REGIME": ["pattern_type", "market_regime"],
    "PATTERN_SIGNAL_QUALITY": ["pattern_type", "signal_bar_quality"], "PATTERN_EMA_SLOPE": ["pattern_type", "ema_slope_bucket"],
    "PATTERN_SESSION": ["pattern_type", "session"], "PATTERN_VOLATILITY": ["pattern_type", "volatility_regime"],
}


def condition_columns(cfg: StatisticsConfig, entry_time: Column) -> dict[str, Column]:
    """Buckets of a trade's conditions at entry; the session of an unknown entry time is UNKNOWN."""
    long = F.col("direction") == "LONG"
    place = F.when(long, F.col("signal_close_location")).otherwise(1.0 - F.col("signal_close_location"))
    quality = (cfg.body_weight * F.col("signal_body_ratio") + cfg.close_weight * place) / (cfg.body_weight + cfg.close_weight)
    slope = F.when(long, F.col("ema_slope_ratio")).otherwise(-F.col("ema_slope_ratio"))
    local = F.from_utc_timestamp(entry_time, cfg.zone)
    minute = F.hour(local) * 60 + F.minute(local)
    a, b, c, d = cfg.session_minutes
    v = F.col("volatility_range_ratio")
    return {
        "signal_bar_quality": F.when(quality <= cfg.quality_weak, "WEAK").when(quality >= cfg.quality_strong, "STRONG").otherwise("ACCEPTABLE"),
        "ema_slope_bucket": F.when(slope < 0, "OPPOSING").when(slope <= cfg.slope_flat, "FLAT").when(slope >= cfg.slope_strong, "STRONG").otherwise("MODERATE"),
        "session": F.when(minute.isNull(), "UNKNOWN").when(minute < a, "PREMARKET").when(minute < b, "OPEN").when(minute < c, "MIDDAY").when(minute < d, "CLOSE").otherwise("AFTER_HOURS"),
        "volatility_regime": F.when(v <= cfg.volatility_low, "LOW").when(v >= cfg.volatility_high, "HIGH").otherwise("NORMAL"),
    }


def latest(trades: DataFrame, order: str) -> DataFrame:
    """The row with the largest ``order`` per trade_id; rows without a trade_id all stay."""
    known = trades.where(F.col("trade_id").isNotNull()).groupBy("trade_id").agg(F.max_by(F.struct(*trades.columns), order).alias("_row")).select("_row.*")
    return known.unionByName(trades.where(F.col("trade_id").isNull()))


def completed(trades: DataFrame, strict: bool = False) -> DataFrame:
    """Trades with an exit and a result; with ``strict`` the others are an error, in one pass over the data."""
    done = F.col("exit_time").isNotNull() & F.col("exit_price").isNotNull() & F.col("pnl").isNotNull() & F.col("pnl_r").isNotNull()
    if strict and not trades.where(~done).isEmpty():
        raise ValueError("setup statistics require completed trades")
    return trades.where(done & ~F.isnan("pnl_r") & ~F.isnan("pnl"))


def drawdowns(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Largest fall from the running peak (at least 0) of cumulative pnl, per group, by (exit_time, trade_id)."""
    month = F.date_format("exit_time", "yyyyMM")
    part = W.partitionBy(*keys, "_m").orderBy("exit_time", "trade_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = trades.select(*keys, "exit_time", "trade_id", "pnl", month.alias("_m")).withColumn("_c", F.sum("pnl").over(part))
    rows = rows.withColumn("_p", F.greatest(F.lit(0.0), F.max("_c").over(part)))
    stretch = rows.groupBy(*keys, "_m").agg(
        F.sum("pnl").alias("s"), F.greatest(F.lit(0.0), F.max("_c")).alias("hi"), F.least(F.lit(0.0), F.min("_c")).alias("lo"), F.max(F.col("_p") - F.col("_c")).alias("dd")
    )
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("hi"), F.lit(0.0).alias("dd"))
    add = lambda a, x: F.struct((a["s"] + x["s"]).alias("s"), F.greatest(a["hi"], a["s"] + x["hi"]).alias("hi"), F.greatest(a["dd"], x["dd"], a["hi"] - a["s"] - x["lo"]).alias("dd"))
    ordered = F.sort_array(F.collect_list(F.struct("_m", "s", "hi", "lo", "dd")))
    return stretch.groupBy(*keys).agg(F.aggregate(ordered, start, add)["dd"].alias("max_drawdown"))


def null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    right = b.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in b.columns))
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys))
    return a.join(right, on, how).drop(*(f"_r_{k}" for k in keys))


def measures(cfg: StatisticsConfig) -> list[Column]:
    r, pnl = F.col("pnl_r"), F.col("pnl")
    n, wins, losses = F.count(F.lit(1)), F.count_if(r > 0), F.count_if(r < 0)
    gains, lost = F.sum(F.when(pnl > 0, pnl).otherwise(0.0)), -F.sum(F.when(pnl < 0, pnl).otherwise(0.0))
    return [
        n.alias("total"), wins.alias("wins"), losses.alias("losses"), (n - wins - losses).alias("breakevens"), (wins / n).alias("win_rate"),
        F.when(n >= cfg.minimum_sample, wins / n).alias("probability_win"), F.avg(F.when(r > 0, r)).alias("avg_win_r"), F.avg(F.when(r < 0, r)).alias("avg_loss_r"),
        F.avg(r).alias("avg_r"), F.avg(r).alias("expectancy_r"), F.when(lost > 0, F.try_divide(gains, lost)).alias("profit_factor"),
        *(F.median(c).alias(f"median_{c}") for c in ("mfe", "mae", "mfe_r", "mae_r")),
    ]


def setup_statistics(trades: DataFrame, cfg: StatisticsConfig = StatisticsConfig()) -> DataFrame:
    """All seven scopes; ``trades`` holds completed trades with condition columns."""
    base = [*SERIES, "strategy_version"]
    keys = [*base, "scope", *DIMENSIONS]
    scope = F.explode(F.array(*(F.struct(F.lit(s).alias("scope"), *((F.col(d) if d in dims else F.lit(None).cast("string")).alias(d) for d in DIMENSIONS)) for s, dims in SCOPES.items())))
    values = ["exit_time", "trade_id", "pnl", "pnl_r", "mfe", "mae", "mfe_r", "mae_r"]
    rows = trades.select(*base, *values, scope.alias("_k")).select(*base, *values, "_k.*")
    return null_safe(rows.groupBy(*keys).agg(*measures(cfg)), drawdowns(rows, keys), keys)


def grouping_set_statistics(trades: DataFrame) -> DataFrame:
    """The order-free counts of the same scopes through GROUPING SETS."""
    base = [*SERIES, "strategy_version"]
    sets = [[F.col(c) for c in [*base, *dims]] for dims in SCOPES.values()]
    return trades.groupingSets(sets, *(F.col(c) for c in [*base, *DIMENSIONS])).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("pnl_r") > 0).alias("wins"), F.grouping_id().alias("scope_bits")
    )


def backtest_metrics(trades: DataFrame, initial_cash: float, keys: list[str]) -> DataFrame:
    """Counts by pnl, returns and drawdown of each group."""
    pnl = F.col("pnl")
    n, wins, losses = F.count(F.lit(1)), F.count_if(pnl > 0), F.count_if(pnl < 0)
    gains, lost = F.sum(F.when(pnl > 0, pnl).otherwise(0.0)), -F.sum(F.when(pnl < 0, pnl).otherwise(0.0))
    factor = F.when(lost > 0, F.try_divide(gains, lost)).when(gains > 0, F.lit(float("inf")))
    totals = trades.groupBy(*keys).agg(
        n.alias("total_trades"), wins.alias("wins"), losses.alias("losses"), F.try_divide(wins, n).alias("win_rate"), F.sum(pnl).alias("net_pnl"),
        (F.sum(pnl) / initial_cash).alias("total_return"), F.avg("pnl_r").alias("expectancy_r"), factor.alias("profit_factor"),
    )
    return null_safe(totals, drawdowns(trades, keys), keys)


def empirical_probability(asked: DataFrame, stats: DataFrame, cfg: StatisticsConfig = StatisticsConfig()) -> DataFrame:
    """Probability of each asked (series, version, pattern, regime), with the status of its evidence."""
    keys = [*SERIES, "strategy_version", "pattern_type", "market_regime"]
    known = stats.where("scope = 'PATTERN_REGIME'").select(*keys, "total", "probability_win")
    status = F.when(F.col("total").isNull(), "NO_MATCHING_STATISTICS").when(F.col("total") < cfg.minimum_sample, "INSUFFICIENT_SAMPLE").otherwise("AVAILABLE")
    return asked.join(known, keys, "left").withColumn("evidence", status)


def excursions(trades: DataFrame, bars: DataFrame, block: int = 1024) -> DataFrame:
    """mfe and mae over the held bars, from bar numbers: an equi-join on blocks plus a range."""
    spans = trades.withColumn("_b", F.explode(F.sequence(F.floor(F.col("entry_index") / block), F.floor(F.col("exit_index") / block))))
    held = bars.select(*SERIES, "bar_index", "high", "low", F.floor(F.col("bar_index") / block).alias("_b"))
    joined = spans.join(held, [*SERIES, "_b"]).where("bar_index between entry_index and exit_index")
    up, down = F.max("high") - F.first("entry_price"), F.first("entry_price") - F.min("low")
    long = F.first("sign") > 0
    floor0 = lambda x: F.greatest(F.lit(0.0), x)
    return joined.groupBy(*SERIES, "trade_no").agg(floor0(F.when(long, up).otherwise(down)).alias("mfe"), floor0(F.when(long, down).otherwise(up)).alias("mae"))


def coverage(bars: DataFrame) -> DataFrame:
    """Span, last close, count and mean volume per series."""
    return bars.groupBy(*SERIES).agg(
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.max_by("close", F.struct("timestamp", "close")).alias("last_close"),
        F.count(F.lit(1)).alias("n_bars"), F.avg("volume").alias("mean_volume"),
    )


def trade_coverage(trades: DataFrame) -> DataFrame:
    """Span, count, sum of results and win rate of completed trades per series."""
    n = F.count(F.lit(1))
    return trades.groupBy(*SERIES).agg(
        F.min("exit_time").alias("first_exit"), F.max("exit_time").alias("last_exit"), n.alias("n_trades"), F.sum("pnl").alias("pnl"), F.try_divide(F.count_if(F.col("pnl") > 0), n).alias("win_rate")
    )
