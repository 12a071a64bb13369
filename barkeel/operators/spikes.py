"""Implausible readings: robust control charts per series (problem 1).

A *series* is one (symbol, timeframe).  Each series is cut into time blocks with
a halo on either side; a block is charted forwards and backwards, and a reading
is a spike only if it lies outside the limits of both charts.  A level that
shifts for good is therefore no spike: the chart that comes from its far side
finds nothing odd.  Suspected values are clipped before they touch mean and
scale, a run-length counter re-centres a chart after a few suspects that agree
with each other, another counts bars that repeat close and high, and physical
limits catch what no bar can be.  Charts and counters of a block begin in its halo, 64 bars or five days
long, whichever is more; a series with fewer bars in it starts its charts from what is there, and a stuck
run that crosses a border is counted from the halo's first bar on.

Defined results: rows with null symbol, timeframe or timestamp are judged by the
physical limits alone; null close, high or volume is never a case by itself and
leaves the charts as they were; rows of one timestamp (re-sent bars) move a
chart once and are each judged by their own values; an empty table gives an
empty result; other columns pass unused.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barkeel.shards import sharded_map


@dataclass(frozen=True)
class ChartRule:
    """Limits of one control chart, in scales (``k``) and in log units (``least``)."""

    weight: float
    scale_weight: float
    k: float
    clip: float
    least: float
    resync: int
    floor: float


@dataclass(frozen=True)
class SpikeRules:
    """Parameters of the operator; the defaults are the production values."""

    close: ChartRule = ChartRule(weight=0.8, scale_weight=0.02, k=10.0, clip=4.0, least=0.004, resync=3, floor=1e-4)
    wick: ChartRule = ChartRule(weight=0.1, scale_weight=0.02, k=15.0, clip=4.0, least=0.006, resync=4, floor=1e-4)
    volume: ChartRule = ChartRule(weight=0.15, scale_weight=0.05, k=4.5, clip=2.0, least=2.3, resync=6, floor=0.2)
    stuck_bars: int = 8
    block_slots: int = 20160
    halo_slots: int = 64
    halo_seconds: int = 5 * 86400


def slot_seconds(timeframe: Column) -> Column:
    """Seconds of a timeframe such as 1m, 30m, 4h, 1d; null if unreadable."""
    n = F.regexp_extract(timeframe, r"^(\d{1,6})[smhdw]$", 1)
    unit = F.regexp_extract(timeframe, r"^\d{1,6}([smhdw])$", 1)
    per = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800)
    return F.when((n != "") & (n.try_cast("long") > 0), n.try_cast("long") * per)


def walk(x: np.ndarray, skip: np.ndarray, rule: ChartRule, mean: float, scale: float) -> np.ndarray:
    """Signed excess of each value over one chart's limits: |v| > 1 is outside.

    ``skip`` marks values that are judged but must not move the chart.
    """
    out = [0.0] * len(x)
    w, b, k, clip, least, floor = rule.weight, rule.scale_weight, rule.k, rule.clip, rule.least, rule.floor
    m, s, run, last = mean, max(scale, floor), 0, 0.0
    for i, (v, still) in enumerate(zip(x.tolist(), skip.tolist())):
        if v != v:
            continue
        e = v - m
        a = e if e >= 0 else -e
        limit = k * s
        if limit < least:
            limit = least
        out[i] = e / limit
        if still:
            continue
        c = clip * s
        if a > limit:
            near = v - last
            run = run + 1 if run and -limit <= near <= limit else 1
            last = v
            if run >= rule.resync:
                m, run = v, 0
            else:
                m += w * (c if e > 0 else -c)
        else:
            run = 0
            m += w * (e if a <= c else c if e > 0 else -c)
        s += b * ((a if a < c else c) - s)
        if s < floor:
            s = floor
    return np.asarray(out)


def outside(x: np.ndarray, skip: np.ndarray, rule: ChartRule, scale: float, start: int = 9) -> np.ndarray:
    """Values outside the charts of both directions, on the same side."""
    known = x[~np.isnan(x) & ~skip]
    if len(known) < 3:
        return np.zeros(len(x), dtype=bool)
    ahead = walk(x, skip, rule, float(np.median(known[:start])), scale)
    back = walk(x[::-1], skip[::-1], rule, float(np.median(known[-start:])), scale)[::-1]
    return (np.minimum(np.abs(ahead), np.abs(back)) > 1) & (np.sign(ahead) == np.sign(back))


def stuck(first: np.ndarray, close: np.ndarray, high: np.ndarray, least: int) -> np.ndarray:
    """Rows that repeat the close and high before them in a run of ``least`` bars or more.

    ``first`` marks the first row of each timestamp; other rows of the timestamp
    share its verdict.  The run's first bar is no repeat.
    """
    out = np.zeros(len(close), dtype=bool)
    known = ~(np.isnan(close) | np.isnan(high))
    at = np.flatnonzero(first & known)
    if len(at) < least:
        return out
    c, h = close[at], high[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (c[1:] != c[:-1]) | (h[1:] != h[:-1])
    run = np.cumsum(new) - 1
    length = np.bincount(run)
    repeat = ~new & (length[run] >= least)
    if not repeat.any():
        return out
    bar = np.cumsum(first) - 1  # number of the timestamp a row belongs to
    verdict = np.zeros(bar[-1] + 1, dtype=bool)
    verdict[bar[at[repeat]]] = True
    value_c = np.full(bar[-1] + 1, np.nan)
    value_h = value_c.copy()
    value_c[bar[at]], value_h[bar[at]] = c, h
    return verdict[bar] & (close == value_c[bar]) & (high == value_h[bar])


def _block(ts, o, h, lo, c, v, bad, rules: SpikeRules):
    """Flags of one block's rows in time order: close, high, volume spike, stuck."""
    first = np.ones(len(ts), dtype=bool)
    first[1:] = ts[1:] != ts[:-1]
    still = stuck(first, c, h, rules.stuck_bars)
    skip = ~first
    with np.errstate(invalid="ignore", divide="ignore"):
        price = np.log(np.where((c > 0) & ~bad & ~still, c, np.nan))
        top = np.fmax(o, c)
        wick = np.log(np.where((h > 0) & (top > 0) & ~bad & ~still, h, np.nan) / top)
        size = np.log1p(np.where(v >= 0, v, np.nan))
    level = price[first & ~np.isnan(price)]
    moves = np.abs(np.diff(level))
    scale = 1.2 * float(np.median(moves)) if len(moves) >= 5 else 0.01
    far_close = outside(price, skip, rules.close, scale)
    far_high = outside(wick, skip, rules.wick, scale) & (wick > 0)
    base = size[~np.isnan(size)]
    spread = float(np.median(np.abs(base - np.median(base)))) if len(base) else 0.0
    far_volume = outside(size, skip, rules.volume, max(spread, rules.volume.floor), start=25) & (size > np.nanmedian(size) if len(base) else False)
    return far_close, far_high, far_volume, still


def flag_readings(df: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """Every row's id and series with one boolean per kind of implausibility.

    Out: bar_id, symbol, timeframe, timestamp, impossible, close_spike,
    high_spike, volume_spike, stuck, implausible.
    """
    num = {n: F.col(n).cast("double") for n in ("open", "high", "low", "close", "volume")}
    infinite = lambda x: x.isNotNull() & (F.isnan(x) | (F.abs(x) == float("inf")))
    o, h, lo, c, v = (num[n] for n in ("open", "high", "low", "close", "volume"))
    limits = [h < lo, h < o, h < c, c < lo, c <= 0, h <= 0, v < 0, infinite(c), infinite(h), infinite(v)]
    bad = reduce(lambda x, y: x | y, (F.coalesce(x, F.lit(False)) for x in limits))
    rows = df.select("bar_id", "symbol", "timeframe", "timestamp", *(x.alias(f"_{n}") for n, x in num.items()), F.col("received_at").alias("_received"), bad.alias("_bad"))

    slot = F.coalesce(slot_seconds(F.col("timeframe")), F.lit(60))
    span = slot * rules.block_slots
    halo = F.greatest(slot * rules.halo_slots, F.lit(rules.halo_seconds))
    at = F.unix_micros("timestamp") / 1e6
    rows = rows.withColumn("_blk", F.floor(at / span)).withColumn("_pos", at - F.col("_blk") * span)
    place = F.array_compact(
        F.array(
            F.struct(F.col("_blk").alias("b"), F.lit(True).alias("core")),
            F.when(F.col("_pos") >= span - halo, F.struct((F.col("_blk") + 1).alias("b"), F.lit(False).alias("core"))),
            F.when(F.col("_pos") < halo, F.struct((F.col("_blk") - 1).alias("b"), F.lit(False).alias("core"))),
        )
    )
    rows = rows.withColumn("_p", F.explode(place)).select("*", F.col("_p.b").alias("_b"), F.col("_p.core").alias("_core")).drop("_p", "_blk", "_pos")

    def kernel(t: pa.Table, starts: np.ndarray) -> pa.Table:
        col = {n: t.column(n).to_numpy(zero_copy_only=False) for n in ("_open", "_high", "_low", "_close", "_volume")}
        col = {n: np.asarray(a, dtype=float) for n, a in col.items()}
        ts = t.column("timestamp").cast(pa.int64()).to_numpy(zero_copy_only=False)
        no_series = np.asarray(t.column("_b").is_null())
        core = t.column("_core").to_numpy(zero_copy_only=False)
        bad_rows = t.column("_bad").to_numpy(zero_copy_only=False)
        flags = np.zeros((4, t.num_rows), dtype=bool)
        for s, e in zip(starts, [*starts[1:], t.num_rows]):
            if no_series[s] or not core[s:e].any():
                continue
            g = slice(s, e)
            flags[:, g] = _block(ts[g], col["_open"][g], col["_high"][g], col["_low"][g], col["_close"][g], col["_volume"][g], bad_rows[g], rules)
        keep = pa.array(core)
        out = t.select(["bar_id", "symbol", "timeframe", "timestamp"]).append_column("impossible", t.column("_bad"))
        for name, f in zip(("close_spike", "high_spike", "volume_spike", "stuck"), flags):
            out = out.append_column(name, pa.array(f))
        return out.filter(keep)

    # rows without a series or instant skip the charts; rows of theirs share one key, so they stay where they are
    whole = F.col("symbol").isNotNull() & F.col("timeframe").isNotNull() & F.col("timestamp").isNotNull()
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"bar_id {kinds['bar_id']}, symbol string, timeframe string, timestamp {kinds['timestamp']}, impossible boolean, close_spike boolean, high_spike boolean, volume_spike boolean, stuck boolean"
    charted = sharded_map(rows.where(whole), ["symbol", "timeframe", "_b"], ["timestamp", "_received", "bar_id"], kernel, schema)
    off = [F.lit(False).alias(n) for n in ("close_spike", "high_spike", "volume_spike", "stuck")]
    loose = rows.where(~whole & F.col("_core")).select("bar_id", "symbol", "timeframe", "timestamp", F.col("_bad").alias("impossible"), *off)
    both = charted.unionByName(loose)
    return both.withColumn("implausible", F.col("impossible") | F.col("close_spike") | F.col("high_spike") | F.col("volume_spike") | F.col("stuck"))
