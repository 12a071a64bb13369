"""The market stages over delivered bars, against a plain loop over each series."""

import datetime as dt
import math

import pytest
from test_market import Market, walk

import __spark_entry__ as entry
from barkeel.operators import patterns
from barkeel.plans.market import WIDE

T0 = dt.datetime(2025, 8, 4)
SCHEMA = "bar_id bigint, symbol string, timeframe string, timestamp timestamp, open double, high double, low double, close double, volume double, feed string, received_at timestamp"
SERIES = [("QVX7", "15m", 4700, 15, 5), ("QVX7", "30m", 400, 30, 6), ("LV9", "30m", 90, 30, 7)]


def waves(n, seed):
    """A walk that drifts up and down in turn, so that trends, patterns and signals come."""
    out, price = [], 100.0
    for k in range(0, n, 100):
        part = walk(min(100, n - k), seed + k, 0.35 if k // 100 % 2 else -0.3)
        shift = price - part[0][0]
        out += [tuple(round(x + shift, 2) for x in r) for r in part]
        price = max(out[-1][3], 60.0)
    return out


@pytest.fixture(scope="module")
def delivered(spark, tmp_path_factory):
    rows, want, n = [], {}, 0
    for symbol, frame, size, step, seed in SERIES:
        good = waves(size, seed)
        want[symbol, frame] = good
        for i, r in enumerate(good):
            at = T0 + dt.timedelta(minutes=step * i)
            add = lambda v, late: (n, symbol, frame, at, *v, 1.0, "f", at + dt.timedelta(minutes=late))
            for v, late in ([((1.0, 2.0, 0.5, 1.0), 1)] if i % 50 == 7 else []) + [(r, 5)] + ([((None, *r[1:]), 9), ((r[0], r[2] - 1, r[2], r[3]), 8)] if i % 60 == 3 else []):
                rows.append(add(v, late))
                n += 1
    folder = str(tmp_path_factory.mktemp("delivered"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/sample_ohlcv.parquet")
    return folder, want


def loop(bars):
    """Per bar trend score, regime and always-in state; events as (bar, pattern, start, bars)."""
    out, events, ema, emas, hist = [], [], None, [], []
    pend, run, state, flow = None, 0, "NEUTRAL", {"long": (0, 0), "short": (0, 0)}
    for i, (o, h, lo, c) in enumerate(bars):
        ema = c if ema is None else ema * (1 - 2 / 21) + c * 2 / 21
        emas.append(ema)
        rng, bull, bear = h - lo, c > o, c < o
        body, place = (abs(c - o) / rng, (c - lo) / rng) if rng else (0.0, 0.5)
        way = bull - bear
        strong = way if rng and body >= 0.65 and ((bull and place >= 0.75) or (bear and place <= 0.25)) else 0
        up = down = hl = lh = False
        overlap = 0.0
        if i:
            ph, pl = bars[i - 1][1:3]
            up, down, hl, lh = h > ph, lo < pl, lo > pl, h < ph
            joint = max(h, ph) - min(lo, pl)
            overlap = 1.0 if joint == 0 else max(min(h, ph) - max(lo, pl), 0.0) / joint
        slope = (ema - emas[i - 5]) / 5 if i >= 5 else 0.0
        es = 0.5 * math.tanh((c - ema) / abs(ema) / 0.01) + 0.5 * math.tanh(slope / abs(ema) / 0.001)
        follow = way if way and i and way == hist[-1][3] else 0
        press = body * place if bull else -body * (1 - place) if bear else 0.0
        hist.append(((up + hl - lh - down) / 2, press, (1 - overlap) * ((es > 0) - (es < 0)), strong, 0.5 * strong + 0.5 * follow))
        mean = lambda k, n: sum(x[k] for x in hist[-n:]) / len(hist[-n:])
        ss = mean(0, 5)
        ts = 0.2 * es + 0.25 * ss + 0.2 * mean(1, 10) + 0.15 * mean(2, 10) + 0.2 * mean(4, 10)
        cand = "ALWAYS_IN_LONG" if ts >= 0.45 and es > 0 and ss >= 0 else "ALWAYS_IN_SHORT" if ts <= -0.45 and es < 0 and ss <= 0 else "NEUTRAL"
        run = run + 1 if cand == pend else 1
        pend = cand
        if cand != "NEUTRAL" and run >= 2:
            state = cand
        bullish, bearish = ts >= 0.3, ts <= -0.3
        flags = {"long": (bullish or (state == "ALWAYS_IN_LONG" and not bearish), bear or down, up, down), "short": (bearish or (state == "ALWAYS_IN_SHORT" and not bullish), bull or up, down, up)}
        for k, f in flags.items():
            phase, age = flow[k]
            new_phase, new_age, _, fired = patterns.step(phase, age, *f, WIDE.patterns)
            flow[k] = new_phase, new_age
            if fired:
                events.append((i, patterns.NAMES[k][2][fired - 1], i - age, age + 1))
        out.append((round(ts, 6), state))
    return out, sorted(events)


def by_series(rows):
    out = {}
    for r in rows:
        out.setdefault((r.symbol, r.timeframe), []).append(r)
    return {k: sorted(v, key=lambda r: r.bar_index) for k, v in out.items()}


def test_delivered_bars_reach_scores_states_and_patterns(spark, delivered):
    folder, want = delivered
    q = entry.queries()
    scores, states, events = (by_series(q[f"ohlcv_{n}"](spark, folder).collect()) for n in ("context_scores", "always_in_state", "pattern_events"))
    assert scores.keys() == states.keys() == want.keys()
    for key, bars in want.items():
        rows, fired = loop(bars)
        assert [r.bar_index for r in scores[key]] == list(range(len(bars)))
        assert max(abs(r.trend_score - w[0]) for r, w in zip(scores[key], rows)) < 2e-6
        assert [r.always_in for r in states[key]] == [w[1] for w in rows]
        assert sorted((r.bar_index, r.pattern_type, r.start_index, r.pullback_bars) for r in events.get(key, [])) == fired
    assert any(r.bar_index > 4096 for r in events["QVX7", "15m"])


def test_delivered_bars_reach_the_broker(spark, delivered):
    folder, want = delivered
    q = entry.queries()
    signals = by_series(q["ohlcv_signals"](spark, folder).collect())
    got = {}
    for r in q["ohlcv_trade_log"](spark, folder).collect():
        got.setdefault((r.symbol, r.timeframe), []).append((r.signal_bar_index, round(r.entry_price, 6), round(r.exit_price, 6), r.exit_reason, round(r.pnl, 4)))
    assert len(signals["QVX7", "15m"]) > 20
    for key, bars in want.items():
        market = Market(WIDE.execution, WIDE.market)
        sig = {r.bar_index: (1 if r.direction == "LONG" else -1, r.entry, r.stop, r.target) for r in signals.get(key, [])}
        for i, bar in enumerate(bars):
            market.bar(i, *bar, sig.get(i))
        if market.pos:
            market.end(len(bars) - 1, bars[-1][3] - market.pos[0] * market.slip, "END_OF_DATA")
        assert sorted(got.get(key, [])) == sorted((at, e, p, why, pnl) for at, _, e, _, p, why, pnl in market.out)
