"""Rolling totals over trailing calendar periods (problem 7).

Daily totals are exploded onto every output day that they influence, grouped by
entity and day, and joined to the entity's calendar for days without activity.
One explosion over the longest window serves all windows: a shorter one sums
only the offsets below its length.

Defined results: rows with null symbol or timestamp are no bars; re-sent bars (one
symbol and timestamp) count once, as the row with the latest received_at, then
the largest bar_id; null or NaN close or volume adds nothing to totals and
averages, though its row is a bar; averages are over the bars that have the value
and null where there are none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_bars(bars: DataFrame) -> DataFrame:
    """One row per (symbol, timestamp), the one received last."""
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    kept = F.max(F.struct("received_at", "bar_id", value("close").alias("close"), value("volume").alias("volume")))
    return bars.where(F.col("symbol").isNotNull() & F.col("timestamp").isNotNull()).groupBy("symbol", "timestamp").agg(kept.alias("r")).select("symbol", "timestamp", "r.close", "r.volume")


def daily_totals(bars: DataFrame) -> DataFrame:
    """Totals per symbol and UTC day."""
    return current_bars(bars).groupBy("symbol", F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("bars"), F.count("close").alias("closes"), F.count("volume").alias("volumes"),
        F.sum("close").alias("close_sum"), F.sum("volume").alias("volume_sum"),
    )


def rolling_totals(bars: DataFrame, windows: Sequence[int] = (7, 30), timeframe: str = "1d") -> DataFrame:
    """Trailing totals and averages per symbol, calendar day and window.

    Out: symbol, day, window_days, bars, close_sum, close_avg, volume_sum,
    volume_avg, and the counts closes and volumes; from each symbol's first to its last day with a bar.
    """
    daily = daily_totals(bars.where(F.col("timeframe") == timeframe))
    longest = max(windows)
    reach = daily.select("*", F.explode(F.sequence(F.lit(0), F.lit(longest - 1))).alias("lag")).withColumn("out_day", F.date_add("day", F.col("lag")))
    within = lambda c, n: F.sum(F.when(F.col("lag") < n, F.col(c)))
    names = ["bars", "closes", "volumes", "close_sum", "volume_sum"]
    sums = reach.groupBy("symbol", "out_day").agg(*(within(c, n).alias(f"{c}_{n}") for n in windows for c in names))
    span = daily.groupBy("symbol").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    calendar = span.select("symbol", F.explode(F.sequence("lo", "hi")).alias("out_day"))
    rows = calendar.join(sums, ["symbol", "out_day"], "left")
    per = F.array(*(F.struct(F.lit(n).alias("window_days"), *(F.col(f"{c}_{n}").alias(c) for c in names)) for n in windows))
    rows = rows.select("symbol", F.col("out_day").alias("day"), F.explode(per).alias("w")).select("symbol", "day", "w.*")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(
        "symbol", "day", "window_days", zero("bars").alias("bars"),
        F.coalesce("close_sum", F.lit(0.0)).alias("close_sum"), F.try_divide("close_sum", "closes").alias("close_avg"),
        F.coalesce("volume_sum", F.lit(0.0)).alias("volume_sum"), F.try_divide("volume_sum", "volumes").alias("volume_avg"),
        zero("closes").alias("closes"), zero("volumes").alias("volumes"),
    )
