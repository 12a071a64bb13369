"""Streaming twins: prints to bars, and the pattern machine as keyed state.

Bars close when the watermark passes them, so late prints are dropped and counted
by Spark.  The machine keeps its phase, its age and the last bar per series; it
runs the same ``step`` as the batch operator, so both give the same events.  Input
of one trigger is ordered by bar number before it is stepped; bars at or before
the last one seen are late and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barkeel.config import Pipeline
from barkeel.operators.patterns import NAMES, signs, step

EVENTS = "symbol string, timeframe string, bar_index bigint, pattern_type string, start_index bigint, pullback_bars int"
_STATE = "last bigint, long_phase int, long_age int, short_phase int, short_age int"


def bars_from_ticks(ticks: DataFrame, symbol: str, ts: str, price: str, tie: str, every: str = "1 hour", late: str = "10 minutes", timeframe: str = "1h") -> DataFrame:
    """OHLCV bars of a stream of prints (or of a batch)."""
    k = F.struct(ts, tie, F.col(price).cast("double").alias("p"))
    rows = ticks.select(F.col(symbol).alias("symbol"), ts, tie, price, k.alias("k"))
    if rows.isStreaming:
        rows = rows.withWatermark(ts, late)
    g = rows.groupBy("symbol", F.window(ts, every).alias("w")).agg(
        F.min("k")["p"].alias("open"), F.max("k.p").alias("high"), F.min("k.p").alias("low"), F.max("k")["p"].alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return g.select("symbol", F.lit(timeframe).alias("timeframe"), F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume")


def pattern_stream(rows: DataFrame, cfg: Pipeline = Pipeline()) -> DataFrame:
    """Pattern events of a stream of context rows (``market_context`` columns)."""
    p = cfg.patterns

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, lp, la, sp, sa = state.get if state.exists else (-1, 0, 0, 0, 0)
        sides = {"long": [lp, la], "short": [sp, sa]}
        out = []
        frame = pd.concat(list(frames)).sort_values("bar_index")
        for r in frame.itertuples(index=False):
            if r.bar_index <= last:
                continue
            last = int(r.bar_index)
            flags = {"long": (r.long_context, r.long_start, r.up, r.down), "short": (r.short_context, r.short_start, r.down, r.up)}
            for k, now in sides.items():
                before = now[1]
                now[0], now[1], _, fired = step(now[0], now[1], *flags[k], p)
                if fired:
                    out.append((*key, last, NAMES[k][2][fired - 1], last - before, before + 1))
        state.update((last, *sides["long"], *sides["short"]))
        yield pd.DataFrame(out, columns=["symbol", "timeframe", "bar_index", "pattern_type", "start_index", "pullback_bars"])

    return signs(rows).groupBy("symbol", "timeframe").applyInPandasWithState(run, EVENTS, _STATE, "append", "NoTimeout")
