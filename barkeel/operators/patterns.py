"""First and second entries (H1, H2, L1, L2): a keyed state machine in parallel blocks.

A detector's state is a phase and the age of its pullback, so there are few
states.  Each block of a series is reduced to the map from every possible state
at its start to the state at its end; the maps are chained over the blocks of the
series, and then every block runs once more from the state it really starts in.
The result is that of one pass over the whole series.  ``step`` is the machine
itself, used here and by the streaming twin.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barkeel.config import PatternConfig, Pipeline
from barkeel.functions.bars import clip
from barkeel.operators.blocks import SERIES
from barkeel.shards import sharded_map

IDLE, PULLBACK, FIRST, BROKEN, READY = range(5)

# Names of detectors, states, conditions and patterns.
NAMES = {
    "long": ("H1H2", ["IDLE", "PULLBACK_STARTED", "H1_TRIGGERED", "H1_FAILED_OR_NEW_PULLBACK", "H2_READY"], ["H1", "H2"]),
    "short": ("L1L2", ["IDLE", "PULLBACK_STARTED", "L1_TRIGGERED", "L1_FAILED_OR_NEW_PULLBACK", "L2_READY"], ["L1", "L2"]),
}
CONDITIONS = {
    "long": {"lost": "long_context_lost", "expired": "pullback_expired", "start": "bear_bar_or_lower_low", "first": "first_up_attempt", "leg": "new_down_leg_after_h1", "arm": "second_attempt_armed", "second": "second_up_attempt"},
    "short": {"lost": "short_context_lost", "expired": "pullback_expired", "start": "bull_bar_or_higher_high", "first": "first_down_attempt", "leg": "new_up_leg_after_l1", "arm": "second_attempt_armed", "second": "second_down_attempt"},
}


def step(phase: int, age: int, context: bool, start: bool, onward: bool, against: bool, cfg: PatternConfig) -> tuple[int, int, list[tuple[int, str, int]], int]:
    """One bar: new phase and age, transitions (before, condition, after) and the attempt fired (0, 1 or 2).

    ``onward`` is a break of the previous bar in the trade's direction, ``against``
    one in the other.  The age of a fired attempt is the returned third value of
    the caller's own bookkeeping: age before a reset.
    """
    if not context:
        return IDLE, 0, [(phase, "lost", IDLE)] if phase else [], 0
    if phase:
        age += 1
        if age > cfg.pullback_max_bars:
            return IDLE, 0, [(phase, "expired", IDLE)], 0
    if phase == IDLE:
        return (PULLBACK, 1, [(IDLE, "start", PULLBACK)], 0) if start else (IDLE, 0, [], 0)
    if phase == PULLBACK:
        if age >= cfg.pullback_min_bars and onward:
            return FIRST, age, [(PULLBACK, "first", FIRST)], 1
        return PULLBACK, age, [], 0
    if phase == FIRST:
        return (BROKEN, age, [(FIRST, "leg", BROKEN)], 0) if against else (FIRST, age, [], 0)
    log = [(BROKEN, "arm", READY)] if phase == BROKEN else []
    if onward:
        return IDLE, 0, [*log, (READY, "second", IDLE)], 2
    return READY, age, log, 0


def signs(rows: DataFrame) -> DataFrame:
    """Per bar and side the four booleans that drive the machine."""
    up, down = F.coalesce(F.col("high") > F.col("previous_high"), F.lit(False)), F.coalesce(F.col("low") < F.col("previous_low"), F.lit(False))
    bull, bear = F.col("regime").isin("BULL_TREND", "STRONG_BULL_TREND"), F.col("regime").isin("BEAR_TREND", "STRONG_BEAR_TREND")
    return rows.select(
        *SERIES, "bar_index",
        (bull | ((F.col("always_in") == "ALWAYS_IN_LONG") & ~bear)).alias("long_context"), (bear | ((F.col("always_in") == "ALWAYS_IN_SHORT") & ~bull)).alias("short_context"),
        (F.col("bear_bar") | F.col("lower_low")).alias("long_start"), (F.col("bull_bar") | F.col("higher_high")).alias("short_start"), up.alias("up"), down.alias("down"),
    )


def _sides(t: pa.Table) -> dict[str, list[list[bool]]]:
    get = lambda c: t.column(c).to_pylist()
    up, down = get("up"), get("down")
    return {"long": [get("long_context"), get("long_start"), up, down], "short": [get("short_context"), get("short_start"), down, up]}


def _code(phase: int, age: int, top: int) -> int:
    return 0 if phase == IDLE else 1 + (phase - 1) * top + age - 1


def _state(code: int, top: int) -> tuple[int, int]:
    return (IDLE, 0) if code == 0 else ((code - 1) // top + 1, (code - 1) % top + 1)


def block_map(columns: list[list[bool]], s: int, e: int, cfg: PatternConfig) -> list[int]:
    """End state per start state of one block; runs stop when they meet the run from IDLE."""
    top = cfg.pullback_max_bars
    base = []
    phase, age = IDLE, 0
    for i in range(s, e):
        phase, age, _, _ = step(phase, age, *(c[i] for c in columns), cfg)
        base.append((phase, age))
    out = [_code(*base[-1], top)]
    for code in range(1, 1 + 4 * top):
        state = _state(code, top)
        for i in range(s, e):
            phase, age, _, _ = step(*state, *(c[i] for c in columns), cfg)
            state = (phase, age)
            if state == base[i - s]:
                state = base[-1]
                break
        out.append(_code(*state, top))
    return out


def detect(rows: DataFrame, cfg: Pipeline = Pipeline(), block: int = 4096) -> DataFrame:
    """Events and transitions of both detectors.

    ``rows`` is ``market_context``'s result.  Out: symbol, timeframe, bar_index,
    detector, kind (event, transition), pattern_type, start_index, pullback_bars,
    state_before, condition, state_after.
    """
    p = cfg.patterns
    top = p.pullback_max_bars
    flags = signs(rows).withColumn("_blk", F.floor(F.col("bar_index") / block))
    keys = [*SERIES, "_blk"]

    def summarise(t: pa.Table, starts: np.ndarray) -> pa.Table:
        sides = _sides(t)
        maps = {k: [block_map(c, s, e, p) for s, e in zip(starts, [*starts[1:], t.num_rows])] for k, c in sides.items()}
        out = t.select(keys).take(pa.array(starts))
        for k in sides:
            out = out.append_column(k, pa.array(maps[k], pa.list_(pa.int32())))
        return out

    def chain(t: pa.Table, starts: np.ndarray) -> pa.Table:
        out = t.select(keys)
        for k in ("long", "short"):
            maps, enter = t.column(k).to_pylist(), []
            for s, e in zip(starts, [*starts[1:], t.num_rows]):
                code = 0
                for i in range(s, e):
                    enter.append(code)
                    code = maps[i][code]
            out = out.append_column(f"enter_{k}", pa.array(enter, pa.int32()))
        return out

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        sides, index = _sides(t), t.column("bar_index").to_pylist()
        at, rec = [], []
        for k, columns in sides.items():
            name, states, patterns = NAMES[k]
            enter = t.column(f"enter_{k}").to_pylist()
            for s, e in zip(starts, [*starts[1:], t.num_rows]):
                phase, age = _state(enter[s], top)
                for i in range(s, e):
                    before = age
                    phase, age, log, fired = step(phase, age, *(c[i] for c in columns), p)
                    if fired:
                        bars = before + 1
                        at.append(i)
                        rec.append((name, "event", patterns[fired - 1], index[i] - bars + 1, bars, states[PULLBACK if fired == 1 else READY], None, None))
                    for a, why, b in log:
                        at.append(i)
                        done = patterns[0] if why == "first" else patterns[1] if why == "second" else None
                        rec.append((name, "transition", done, None, None, states[a], CONDITIONS[k][why], states[b]))
        out = t.select([*SERIES, "bar_index"]).take(pa.array(at, pa.int64()))
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for j, (n, kind) in enumerate(zip(("detector", "kind", "pattern_type", "start_index", "pullback_bars", "state_before", "condition", "state_after"), kinds)):
            out = out.append_column(n, pa.array([r[j] for r in rec], kind))
        return out

    series = "symbol string, timeframe string"
    maps = sharded_map(flags, keys, ["bar_index"], summarise, f"{series}, _blk bigint, long array<int>, short array<int>")
    enters = sharded_map(maps, SERIES, ["_blk"], chain, f"{series}, _blk bigint, enter_long int, enter_short int")
    schema = f"{series}, bar_index bigint, detector string, kind string, pattern_type string, start_index bigint, pullback_bars int, state_before string, condition string, state_after string"
    return sharded_map(flags.join(enters, keys), keys, ["bar_index"], run, schema)


def quality(direction: Column, cfg: Pipeline) -> Column:
    """Pattern quality, a score and no probability."""
    p = cfg.patterns
    long = direction == "LONG"
    context = F.greatest(F.lit(0.0), F.when(long, F.col("trend_score")).otherwise(-F.col("trend_score")))
    place = F.when(long, F.col("close_location")).otherwise(1.0 - F.col("close_location"))
    body = F.when(F.when(long, F.col("bull_bar")).otherwise(F.col("bear_bar")), F.col("body_ratio")).otherwise(0.0)
    total = p.context_weight + p.signal_close_weight + p.directional_body_weight
    return clip((p.context_weight * context + p.signal_close_weight * place + p.directional_body_weight * body) / total, 0.0, 1.0)


def pattern_events(rows: DataFrame, cfg: Pipeline = Pipeline()) -> DataFrame:
    """Events joined to their signal bar, with direction, trigger price and quality.

    Events whose second-entry module is off are dropped; first entries stay.
    """
    found = detect(rows, cfg).where("kind = 'event'").select(*SERIES, "bar_index", "pattern_type", "start_index", "pullback_bars", "state_before")
    off = [p for p, on in (("H2", cfg.modules.h2_with_trend), ("L2", cfg.modules.l2_with_trend)) if not on]
    if off:
        found = found.where(~F.col("pattern_type").isin(off))
    direction = F.when(F.col("pattern_type").startswith("H"), "LONG").otherwise("SHORT")
    joined = rows.join(found, [*SERIES, "bar_index"]).withColumn("direction", direction)
    return joined.select(
        "*", F.when(F.col("direction") == "LONG", F.col("high")).otherwise(F.col("low")).alias("trigger_price"),
        F.substring("pattern_type", 2, 1).cast("int").alias("attempt_number"), quality(F.col("direction"), cfg).alias("pattern_score"),
    )


def transition_log(found: DataFrame) -> DataFrame:
    """Transitions of both detectors as one log, in order of bar and detector."""
    log = found.where("kind = 'transition'").drop("kind", "start_index", "pullback_bars")
    return log.orderBy(*SERIES, "bar_index", "detector")
