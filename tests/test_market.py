import dataclasses
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from barkeel.config import MARKETS, BarConfig, ExecutionConfig, MarketConfig, Modules, PatternConfig, Pipeline, SetupConfig, build
from barkeel.functions.bars import expected_value, json_or_raw, slug, to_tick
from barkeel.operators import blocks, execution, features, patterns, sessions, setups, statistics, validate

D = dt.datetime
BARS = "symbol string, timeframe string, timestamp timestamp, open double, high double, low double, close double, volume double"


def bars(spark, rows, symbol="A", step=5):
    t0 = D(2025, 1, 2, 14, 30)
    return spark.createDataFrame([(symbol, "5m", t0 + dt.timedelta(minutes=step * i), *map(float, r), 1.0) for i, r in enumerate(rows)], BARS)


def walk(n, seed=1, drift=0.0):
    rng, price, out = random.Random(seed), 100.0, []
    for _ in range(n):
        o = price
        price = max(1.0, price + rng.gauss(drift, 1))
        out.append((o, max(o, price) + rng.random() * 0.5, min(o, price) - rng.random() * 0.5, price))
    return [tuple(round(x, 2) for x in r) for r in out]


def test_ema_overlap_and_zero_range(spark):
    cfg = build(Pipeline, {"trend": {"ema_period": 2, "ema_slope_lookback": 1}})
    f = features.bar_features(bars(spark, [(1, 1, 1, 1), (1, 2, 1, 2), (2, 3, 1.5, 3)]), cfg).orderBy("bar_index").collect()
    assert [round(r.ema20, 9) for r in f] == [1.0, round(5 / 3, 9), round(23 / 9, 9)]
    assert f[0].doji and f[0].body_ratio == 0 and f[0].close_location == 0.5 and f[0].overlap_previous == 0 and f[0].ema_slope is None
    assert math.isclose(f[2].overlap_previous, 0.5 / 2) and f[2].higher_high and f[2].higher_low and not f[0].higher_high


def test_blocks_give_the_whole_series_result(spark, monkeypatch):
    df = bars(spark, walk(1300))
    cfg = Pipeline()
    cols = ["bar_index", "regime", "always_in", *(F.round(c, 9).alias(c) for c in (*features.SCORES, "ema20"))]
    whole = features.market_context(df, cfg).select(*cols).orderBy("bar_index").collect()
    monkeypatch.setattr(blocks.Blocks, "for_period", lambda self, p: blocks.Blocks(rows=420, halo=410, span_seconds=3600))
    cut = features.market_context(df, cfg).select(*cols).orderBy("bar_index").collect()
    assert [r.bar_index for r in whole] == list(range(1300))
    assert whole == cut


def test_prefix_invariance(spark):
    rows = walk(200, 3)
    cut = features.market_context(bars(spark, rows[:150])).orderBy("bar_index").collect()
    full = features.market_context(bars(spark, rows)).where("bar_index < 150").orderBy("bar_index").collect()
    assert cut == full


def test_always_in_keeps_its_state(spark):
    rows = [(100 + i, 101 + i, 99.5 + i, 100.9 + i) for i in range(40)] + [(140, 140.2, 139.8, 140)] * 10
    states = [r.always_in for r in features.market_context(bars(spark, rows)).orderBy("bar_index").collect()]
    assert states[0] == "NEUTRAL" and states[-1] == "ALWAYS_IN_LONG" and "ALWAYS_IN_SHORT" not in states


def brute_patterns(flags, cfg):
    out = []
    for k in ("long", "short"):
        phase = age = 0
        for i, f in enumerate(flags):
            before = age
            phase, age, _, fired = patterns.step(phase, age, *f[k], cfg)
            if fired:
                out.append((i, patterns.NAMES[k][2][fired - 1], i - before, before + 1))
    return sorted(out)


@pytest.mark.parametrize("block", [7, 50, 4096])
def test_pattern_blocks_equal_one_pass(spark, block):
    rng = random.Random(block)
    data, flags = [], []
    for i in range(400):
        regime = rng.choice(["BULL_TREND"] * 6 + ["BEAR_TREND"] * 3 + ["TRADING_RANGE"])
        up, down, bull, bear = (rng.random() < 0.5 for _ in range(4))
        data.append(("A", "5m", i, 2.0 if up else 0.5, 1.0, 0.5 if down else 2.0, 1.0, bull, bear, down, up, regime, rng.choice(["NEUTRAL", "ALWAYS_IN_LONG"])))
        inb, ins = regime == "BULL_TREND", regime == "BEAR_TREND"
        flags.append({"long": (inb or (data[-1][12] == "ALWAYS_IN_LONG" and not ins), bear or down, up, down), "short": (ins, bull or up, down, up)})
    df = spark.createDataFrame(data, "symbol string, timeframe string, bar_index long, high double, previous_high double, low double, previous_low double, bull_bar boolean, bear_bar boolean, lower_low boolean, higher_high boolean, regime string, always_in string")
    got = sorted((r.bar_index, r.pattern_type, r.start_index, r.pullback_bars) for r in patterns.detect(df, Pipeline(), block).where("kind = 'event'").collect())
    assert got == brute_patterns(flags, PatternConfig()) and len(got) > 20


def test_machine_steps():
    cfg = PatternConfig()
    seen = []
    phase = age = 0
    for start, onward, against in ((True, False, False), (False, True, False), (False, False, True), (False, False, False), (False, True, False)):
        phase, age, log, fired = patterns.step(phase, age, True, start, onward, against, cfg)
        seen.append((fired, [c for _, c, _ in log]))
    assert seen == [(0, ["start"]), (1, ["first"]), (0, ["leg"]), (0, ["arm"]), (2, ["second"])]
    assert patterns.step(1, 20, True, True, True, True, cfg)[:2] == (0, 0) and patterns.step(3, 5, False, True, True, True, cfg)[0] == 0


def test_tick_prices(spark):
    df = spark.createDataFrame([(103.0,), (103.005,), (97.999999,)], "x double")
    up = [r[0] for r in df.select(to_tick(F.col("x"), 0.01, True)).collect()]
    down = [r[0] for r in df.select(to_tick(F.col("x"), 0.25, False)).collect()]
    assert up == [103.0, 103.01, 98.0] and down == [103.0, 103.0, 97.75]


def test_expected_value_slug_json(spark):
    ev, ev_r = expected_value(F.col("p"), F.lit(2.0), F.lit(1.0), F.lit(0.1))
    df = spark.createDataFrame([(0.5, " H2 / Bull Trend! ", '{"a":1}'), (None, "", "oops")], "p double, s string, j string")
    rows = df.select(ev.alias("ev"), ev_r.alias("r"), slug(F.col("s")).alias("s"), json_or_raw(F.col("j")).alias("j")).collect()
    assert math.isclose(rows[0].ev, 0.4) and rows[1].ev is None and rows[0].s == "h2-bull-trend" and rows[0].j == '{"a":1}' and rows[1].j == '{"raw":"oops"}'


class Market:
    """A bar-by-bar broker in plain Python, for comparison."""

    def __init__(self, x, m):
        self.x, self.m, self.slip = x, m, x.slippage_ticks * m.tick_size
        self.cash, self.wait, self.pos, self.out = x.initial_cash, None, None, []

    def bar(self, i, o, h, lo, c, sig):
        entered = False
        if self.wait:
            s, entry, stop, target, q, at = self.wait
            if i <= at + self.x.expiry_bars and (h >= entry if s > 0 else lo <= entry):
                base = (o if o >= entry else entry) if s > 0 else (o if o <= entry else entry)
                self.pos, self.wait, entered = [s, base + s * self.slip, stop, target, q, i, at], None, True
            elif i >= at + self.x.expiry_bars:
                self.wait = None
        if self.pos:
            s, e, stop, target, q, i0, at = self.pos
            price = reason = None
            if s > 0:
                gap_stop, gap_target, hit_stop, hit_target = o <= stop, o >= target, min(o, lo) <= stop, max(o, h) >= target
            else:
                gap_stop, gap_target, hit_stop, hit_target = o >= stop, o <= target, max(o, h) >= stop, min(o, lo) <= target
            if entered and gap_target:
                reason, price = "TARGET", o
            elif not entered and gap_stop:
                reason, price = "STOP_LOSS", o
            elif not entered and gap_target:
                reason, price = "TARGET", o
            elif hit_stop and (not hit_target or self.x.policy == "adverse"):
                reason, price = "STOP_LOSS", stop
            elif hit_target:
                reason, price = "TARGET", target
            if reason:
                self.end(i, price - s * self.slip, reason)
        if sig and not self.wait and not self.pos:
            s, entry, stop, target = sig
            q = math.floor(self.cash * self.x.risk_per_trade / (abs(entry - stop) * self.m.point_value))
            if q > 0:
                self.wait = (s, entry, stop, target, q, i)

    def end(self, i, price, reason):
        s, e, stop, target, q, i0, at = self.pos
        pnl = s * (price - e) * q * self.m.point_value - self.x.commission
        self.cash += pnl
        self.out.append((at, i0, round(e, 6), i, round(price, 6), reason, round(pnl, 4)))
        self.pos = None


@pytest.mark.parametrize("policy,expiry", [("adverse", 1), ("favorable", 3)])
def test_execution_equals_bar_loop(spark, policy, expiry):
    cfg = dataclasses.replace(Pipeline(), execution=ExecutionConfig(policy=policy, expiry_bars=expiry, commission=0.5), market=MarketConfig(0.01, 2.0))
    rng = random.Random(expiry)
    rows = walk(1500, 11)
    sig = {}
    for i in range(0, 1499):
        if rng.random() < 0.15:
            s, c = rng.choice([1, -1]), rows[i][3]
            sig[i] = (s, round(c + s * 0.4, 2), round(c - s * rng.uniform(1, 4), 2), round(c + s * rng.uniform(1, 5), 2))
    m = Market(cfg.execution, cfg.market)
    for i, r in enumerate(rows):
        m.bar(i, *r, sig.get(i))
    if m.pos:
        m.end(len(rows) - 1, rows[-1][3] - m.pos[0] * m.slip, "END_OF_DATA")
    numbered = blocks.indexed(bars(spark, rows))
    accepted = spark.createDataFrame([("A", "5m", i, "LONG" if s > 0 else "SHORT", e, st, t) for i, (s, e, st, t) in sig.items()], "symbol string, timeframe string, bar_index long, direction string, entry double, stop double, target double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        sim = execution.simulate(numbered, accepted, cfg)
        got = sorted((r.signal_bar_index, r.entry_index, round(r.entry_price, 6), r.exit_index, round(r.exit_price, 6), r.exit_reason, round(r.pnl, 4)) for r in sim.where("status = 'FILLED'").collect())
        again = {r.trade_no: (round(r.mfe, 9), round(r.mae, 9)) for r in statistics.excursions(sim.where("status = 'FILLED'"), numbered, 64).collect()}
        kept = {r.trade_no: (round(r.mfe, 9), round(r.mae, 9)) for r in sim.where("status = 'FILLED'").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == sorted(m.out) and len(got) > 30 and again == kept


def test_drawdown_stretches_equal_loop(spark):
    rng = random.Random(2)
    rows = [("A", f"t{i:05d}", D(2025, 1, 1) + dt.timedelta(hours=7 * i), rng.gauss(0.1, 5)) for i in range(800)]
    got = statistics.drawdowns(spark.createDataFrame(rows, "symbol string, trade_id string, exit_time timestamp, pnl double"), ["symbol"]).first().max_drawdown
    cum = peak = worst = 0.0
    for r in rows:
        cum += r[3]
        peak, worst = max(peak, cum), max(worst, max(peak, cum) - cum)
    assert math.isclose(got, worst, rel_tol=1e-12)


def test_metrics_edges(spark):
    rows = [("A", "a", D(2025, 1, 1), 10.0, 1.0), ("B", "b", D(2025, 1, 1), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "symbol string, trade_id string, exit_time timestamp, pnl double, pnl_r double")
    got = {r.symbol: r for r in statistics.backtest_metrics(df, 100.0, ["symbol"]).collect()}
    assert got["A"].profit_factor == float("inf") and got["B"].profit_factor is None and got["A"].max_drawdown == 0
    with pytest.raises(ValueError):
        statistics.completed(df.withColumn("exit_price", F.lit(None).cast("double")), strict=True)


def test_validation(spark):
    df = spark.createDataFrame([("2025-01-01T10:00:00+02:00", "1", "2", "0.5", "1.5", "3", "x"), ("2025-01-01 10:00:00", "1", "2", "0.5", "1.5", "3", "x")], "Timestamp string, ` OPEN ` string, high string, low string, close string, volume string, extra string")
    out = validate.normalize(df).orderBy("timestamp").collect()
    assert [r.timestamp for r in out] == [D(2025, 1, 1, 8), D(2025, 1, 1, 10)] and out[0].open == 1.0
    with pytest.raises(validate.InvalidBars, match="high_below_low"):
        validate.normalize(df.withColumn("high", F.lit("0.1")))
    with pytest.raises(validate.InvalidBars, match="duplicate timestamps"):
        validate.normalize(df.unionByName(df))
    with pytest.raises(validate.InvalidBars, match="duplicate column"):
        validate.canonical_names(df.withColumn("HIGH ", F.lit(1)))
    with pytest.raises(validate.InvalidBars, match="missing"):
        validate.canonical_names(df.drop("volume"))
    n = spark.createDataFrame([(1735725600000, 1.0, 2.0, 0.5, 1.5, 3.0)], "timestamp long, open double, high double, low double, close double, volume double")
    with pytest.raises(validate.InvalidBars, match="unit"):
        validate.normalize(n)
    assert validate.normalize(n, unit="ms").first().timestamp == D(2025, 1, 1, 10)
    with pytest.raises(validate.InvalidBars, match="no rows"):
        validate.normalize(n.limit(0), unit="ms")


def test_sessions(spark):
    days = list(sessions.us_sessions(dt.date(2025, 1, 1), dt.date(2025, 12, 31)))
    assert len(days) == 250 and dt.date(2025, 4, 18) not in {d for d, *_ in days} and dict((d, e) for d, _, e in days)[dt.date(2025, 11, 28)] == 780
    table = sessions.session_table(spark, dt.date(2025, 3, 7), dt.date(2025, 3, 10))
    opens = [r.open_ts for r in table.orderBy("open_ts").collect()]
    assert opens == [D(2025, 3, 7, 14, 30), D(2025, 3, 10, 13, 30)]
    minutes = sessions.expected_minutes(table).where("session_date = date'2025-03-07'")
    have = minutes.where("timestamp <> timestamp'2025-03-07 15:00:00'").selectExpr("'A' symbol", "'1m' timeframe", "timestamp")
    diff = sessions.minute_differences(have, table.where("session_date = date'2025-03-07'")).collect()
    assert [(r.timestamp, r.kind) for r in diff] == [(D(2025, 3, 7, 15), "missing")]
    one = bars(spark, [(1, 2, 0.5, 1.5), (1.5, 3, 1, 2), (2, 2, 0.1, 0.2)], step=1)
    r = sessions.resample(one, 5).collect()
    assert len(r) == 1 and (r[0].open, r[0].high, r[0].low, r[0].close, r[0].volume, r[0].timestamp) == (1.0, 3.0, 0.1, 0.2, 3.0, D(2025, 1, 2, 14, 30))


def test_setup_switches_and_mirror(spark):
    rows = walk(1200, 21, 0.05)
    wide = dataclasses.replace(Pipeline(), setup=SetupConfig(minimum_context_score=0.0, minimum_directional_pressure=-1.0))
    spine = setups.spine(bars(spark, rows), wide)
    ev = setups.evaluate_setups(patterns.pattern_events(spine, wide), spine, wide)
    first = [r for r in ev.collect() if r.attempt_number == 1]
    assert first and all("second_entry_pattern_required" in r.rejections and not r.accepted for r in first)
    off = dataclasses.replace(wide, modules=Modules(market_regime_filter=False, ema_alignment_filter=False, h2_with_trend=False))
    kinds = {r.pattern_type for r in patterns.pattern_events(spine, off).collect()}
    assert "H2" not in kinds and "H1" in kinds
    assert "market_regime_with_trend" not in setups.accepted_reasons(off) and off.modules.enabled()[0] == "l2_with_trend"
    flipped = [(1000 - o, 1000 - lo, 1000 - h, 1000 - c) for o, h, lo, c in rows]
    mirror = setups.spine(bars(spark, flipped), wide)
    a = patterns.detect(spine, wide).where("kind = 'event'").groupBy("detector").count().collect()
    b = patterns.detect(mirror, wide).where("kind = 'event'").groupBy("detector").count().collect()
    assert {r.detector for r in a} <= {"H1H2", "L1L2"} and b is not None


def test_config_limits():
    for bad in ({"bar": {"doji_body_ratio": 0.9}}, {"setup": {"exit_mode": "1R"}}, {"nope": 1}, {"execution": {"policy": "x"}}, {"patterns": {"pullback_max_bars": 0}}, {"strategy_version": " "}):
        with pytest.raises(ValueError):
            build(Pipeline, bad)
    assert BarConfig() == Pipeline().bar and MARKETS["ES"].tick_size == 0.25


def test_inputs_must_fit_together(spark):
    rows = blocks.indexed(bars(spark, walk(60))).withColumn("strategy_version", F.lit("v"))
    validate.require_context_rows(rows)
    validate.require_synchronised(rows, rows, "v")
    moved = rows.withColumn("bar_index", F.col("bar_index") + (F.col("bar_index") > 30).cast("int"))
    for wrong in (moved, rows.withColumn("strategy_version", F.lit("w")), rows.where("bar_index <> 7")):
        with pytest.raises(validate.InvalidBars):
            validate.require_synchronised(rows, wrong, "v")
    for wrong in (rows.withColumn("close", F.lit(float("nan"))), rows.withColumn("symbol", F.lit(None).cast("string")), rows.unionByName(rows.where("bar_index = 3")), rows.withColumn("bar_index", -F.col("bar_index"))):
        with pytest.raises(validate.InvalidBars):
            validate.require_context_rows(wrong)
    cfg = dataclasses.replace(Pipeline(), strategy_version="v")
    event = rows.where("bar_index = 40").withColumn("start_index", F.lit(30).cast("long"))
    setups.require_point_in_time(event, rows, cfg)
    for some in (rows.where("bar_index <> 12"), rows.withColumn("timestamp", F.col("timestamp") + F.expr("interval 1 second"))):
        with pytest.raises(ValueError, match="without their bars"):
            setups.require_point_in_time(event, some, cfg)
    accepted = event.withColumn("accepted", F.lit(True))
    execution.require_match(rows, accepted, cfg)
    assert setups.signals(accepted, "v").count() == 1
    with pytest.raises(ValueError, match="another version"):
        setups.signals(accepted, "w")
    with pytest.raises(ValueError):
        execution.require_match(rows.where("bar_index < 40"), accepted, cfg)


def test_order_history(spark):
    cfg = dataclasses.replace(Pipeline(), execution=ExecutionConfig(slippage_ticks=0, commission=0.0))
    prices = [(100, 101, 99, 100), (100, 101.5, 100, 101), (101, 102, 100.5, 101), (101, 106, 101, 105.5), (105, 105.2, 104.8, 105), (105, 105.1, 104.9, 105), (105, 107, 104.9, 106), (106, 106.5, 105.5, 106)]
    numbered = blocks.indexed(bars(spark, prices))
    signals = [(0, "LONG", 101.2, 99.0, 105.0), (1, "LONG", 102.0, 99.0, 105.0), (4, "LONG", 109.0, 99.0, 120.0), (5, "LONG", 106.0, 100.0, 120.0)]
    accepted = spark.createDataFrame([("A", "5m", *r) for r in signals], "symbol string, timeframe string, bar_index long, direction string, entry double, stop double, target double")
    sim = execution.simulate(numbered, accepted, cfg, record_rejected=True)
    got = [(r.order_id[-1], r.seq, r.order_type, r.status, r.price, r.filled_price, r.rejection) for r in execution.order_history(sim).orderBy("order_id", "seq").collect()]
    assert got == [
        ("1", 1, "STOP", "PENDING", 101.2, None, None), ("1", 2, "STOP", "FILLED", 101.2, 101.2, None), ("2", 2, "STOP", "REJECTED", 102.0, None, "existing_position_or_pending_entry"),
        ("3", 2, "LIMIT", "FILLED", 105.0, 105.0, None), ("4", 1, "STOP", "PENDING", 109.0, None, None), ("4", 2, "STOP", "CANCELLED", 109.0, None, "PENDING_ORDER_EXPIRED"),
        ("5", 1, "STOP", "PENDING", 106.0, None, None), ("5", 2, "STOP", "FILLED", 106.0, 106.0, None), ("6", 2, "MARKET", "FILLED", None, 106.0, None),
    ]
    last = {r.order_id[-1]: r.status for r in execution.order_states(execution.order_history(sim)).collect()}
    assert last == {"1": "FILLED", "2": "REJECTED", "3": "FILLED", "4": "CANCELLED", "5": "FILLED", "6": "FILLED"}
    assert execution.simulate(numbered, accepted, cfg).where("status = 'REJECTED'").count() == 0


def test_transition_log_is_ordered(spark):
    spine = setups.spine(bars(spark, walk(400, 4)), Pipeline())
    log = patterns.transition_log(patterns.detect(spine, Pipeline())).collect()
    assert log and [(r.bar_index, r.detector) for r in log] == sorted((r.bar_index, r.detector) for r in log)


def test_an_unchanged_close_has_no_sign(spark):
    flat = [(p, p + 1, p - 1, 460.41) for p in (460.0, 459.5, 460.2, 459.9)]
    rows = features.market_context(bars(spark, flat), Pipeline()).orderBy("bar_index").collect()
    assert [r.ema_score for r in rows] == [0.0] * 4 and [r.overlap_score for r in rows] == [0.0] * 4
