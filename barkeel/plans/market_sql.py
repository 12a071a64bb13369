"""The market queries as SQL for an independent engine; recursion takes the place of state."""

from __future__ import annotations

from barkeel.config import SetupConfig
from barkeel.plans.clock_sql import CLOCKS
from barkeel.plans.settings import SHIPPED, WIDE

_BARS = """
WITH RECURSIVE b AS MATERIALIZED (
  SELECT event_type AS symbol, '1h' AS timeframe, date_trunc('hour', ts) AS timestamp, arg_min(value + 100.0, row(ts, event_id)) AS open, max(value + 100.0) AS high,
         min(value + 100.0) AS low, arg_max(value + 100.0, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2, 3)
"""

_FEATURES = (
    _BARS
    + """, x AS MATERIALIZED (SELECT *, row_number() OVER w - 1 AS i, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM b WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
r AS (SELECT *, high - low AS rng, abs(close - open) AS bd, high - greatest(open, close) AS ut, least(open, close) - low AS lt FROM x),
f AS MATERIALIZED (SELECT *,
  CASE WHEN rng = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, bd / rng)) END AS br, CASE WHEN rng = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, ut / rng)) END AS utr,
  CASE WHEN rng = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, lt / rng)) END AS ltr, CASE WHEN rng = 0 THEN 0.5 ELSE least(1.0, greatest(0.0, (close - low) / rng)) END AS cl,
  close > open AS bull, close < open AS bear,
  coalesce(high <= ph AND low >= pl AND NOT (high = ph AND low = pl), false) AS inb, coalesce(high >= ph AND low <= pl AND NOT (high = ph AND low = pl), false) AS outb,
  coalesce(high > ph, false) AS hh, coalesce(low > pl, false) AS hl, coalesce(high < ph, false) AS lh, coalesce(low < pl, false) AS ll,
  CASE WHEN ph IS NULL THEN 0.0 WHEN greatest(high, ph) - least(low, pl) = 0 THEN 1.0
       ELSE greatest(least(high, ph) - greatest(low, pl), 0.0) / (greatest(high, ph) - least(low, pl)) END AS ov FROM r),
g AS MATERIALIZED (SELECT *, NOT (rng > 0) OR br <= 0.2 AS doji, rng > 0 AND br >= 0.65 AND ((bull AND cl >= 0.75) OR (bear AND cl <= 0.25)) AS tb FROM f)
"""
)

_EMA = (
    _FEATURES
    + """, e AS (SELECT symbol, i, close AS ema FROM g WHERE i = 0 UNION ALL SELECT g.symbol, g.i, e.ema * (1 - 2.0 / 21) + g.close * (2.0 / 21) FROM e JOIN g ON g.symbol = e.symbol AND g.i = e.i + 1),
h AS MATERIALIZED (SELECT g.*, e.ema, (e.ema - lag(e.ema, 5) OVER (PARTITION BY symbol ORDER BY i)) / 5 AS slope FROM g JOIN e USING (symbol, i))
"""
)

_SCORES = (
    _EMA
    + """, k AS (SELECT *, CAST(bull AS INT) - CAST(bear AS INT) AS dir, CASE WHEN tb THEN CAST(bull AS INT) - CAST(bear AS INT) ELSE 0 END AS bk,
  0.5 * tanh((close - ema) / abs(ema) / 0.01) + 0.5 * tanh(coalesce(slope, 0) / abs(ema) / 0.001) AS es FROM h),
l AS (SELECT *, 0.5 * bk + 0.5 * CASE WHEN dir <> 0 AND dir = coalesce(lag(bk) OVER (PARTITION BY symbol ORDER BY i), 0) THEN dir ELSE 0 END AS bu FROM k),
m AS (SELECT *, avg((CAST(hh AS INT) + CAST(hl AS INT) - CAST(lh AS INT) - CAST(ll AS INT)) / 2.0) OVER (PARTITION BY symbol ORDER BY i ROWS 4 PRECEDING) AS ss,
  avg(CASE WHEN bull THEN br * cl WHEN bear THEN -br * (1 - cl) ELSE 0 END) OVER w AS ps, avg((1 - ov) * sign(es)) OVER w AS os, avg(bu) OVER w AS bs
  FROM l WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 9 PRECEDING)),
n AS (SELECT *, greatest(-1, least(1, 0.2 * es + 0.25 * ss + 0.2 * ps + 0.15 * os + 0.2 * bs)) AS ts FROM m),
c AS MATERIALIZED (SELECT *, CASE WHEN ts >= 0.7 THEN 'STRONG_BULL_TREND' WHEN ts >= 0.3 THEN 'BULL_TREND' WHEN ts > 0.1 THEN 'WEAK_BULL_TREND' WHEN ts <= -0.7 THEN 'STRONG_BEAR_TREND'
  WHEN ts <= -0.3 THEN 'BEAR_TREND' WHEN ts < -0.1 THEN 'WEAK_BEAR_TREND' ELSE 'TRADING_RANGE' END AS regime,
  CASE WHEN ts >= 0.45 AND es > 0 AND ss >= 0 THEN 'ALWAYS_IN_LONG' WHEN ts <= -0.45 AND es < 0 AND ss <= 0 THEN 'ALWAYS_IN_SHORT' ELSE 'NEUTRAL' END AS cand FROM n)
"""
)

_STATES = (
    _SCORES
    + """, a AS (SELECT symbol, i, cand AS pend, 1 AS run, 'NEUTRAL' AS state FROM c WHERE i = 0
  UNION ALL SELECT c.symbol, c.i, c.cand, CASE WHEN c.cand = a.pend THEN a.run + 1 ELSE 1 END,
    CASE WHEN c.cand <> 'NEUTRAL' AND c.cand = a.pend AND a.run + 1 >= 2 THEN c.cand ELSE a.state END FROM a JOIN c ON c.symbol = a.symbol AND c.i = a.i + 1),
s AS MATERIALIZED (SELECT c.*, a.state AS always_in FROM c JOIN a USING (symbol, i)),
q AS MATERIALIZED (SELECT symbol, i, side, CASE side WHEN 1 THEN lc ELSE sc END AS ctx, CASE side WHEN 1 THEN bear OR ll ELSE bull OR hh END AS st, CASE side WHEN 1 THEN hh ELSE ll END AS up,
    CASE side WHEN 1 THEN ll ELSE hh END AS dn FROM (SELECT *,
  regime IN ('BULL_TREND', 'STRONG_BULL_TREND') OR (always_in = 'ALWAYS_IN_LONG' AND regime NOT IN ('BEAR_TREND', 'STRONG_BEAR_TREND')) AS lc,
  regime IN ('BEAR_TREND', 'STRONG_BEAR_TREND') OR (always_in = 'ALWAYS_IN_SHORT' AND regime NOT IN ('BULL_TREND', 'STRONG_BULL_TREND')) AS sc FROM s) CROSS JOIN (VALUES (1), (-1)) v(side)),
p AS (SELECT symbol, side, CAST(-1 AS BIGINT) AS i, 0 AS ph, 0 AS age, 0 AS fired, 0 AS bars FROM (SELECT DISTINCT symbol, side FROM q)
  UNION ALL SELECT z.symbol, z.side, z.i,
    CASE WHEN NOT z.ctx OR (z.ph > 0 AND z.age > 20) THEN 0 WHEN z.ph = 0 THEN CAST(z.st AS INT) WHEN z.ph = 1 THEN CASE WHEN z.up THEN 2 ELSE 1 END
         WHEN z.ph = 2 THEN CASE WHEN z.dn THEN 3 ELSE 2 END ELSE CASE WHEN z.up THEN 0 ELSE 4 END END,
    CASE WHEN z.ph = 0 THEN CAST(z.ctx AND z.st AS INT) WHEN NOT z.ctx OR z.age > 20 OR (z.ph >= 3 AND z.up) THEN 0 ELSE z.age END,
    CASE WHEN z.ctx AND z.age <= 20 AND z.up AND z.ph = 1 THEN 1 WHEN z.ctx AND z.age <= 20 AND z.up AND z.ph >= 3 THEN 2 ELSE 0 END, z.age
  FROM (SELECT q.*, p.ph, CASE WHEN p.ph > 0 THEN p.age + 1 ELSE 0 END AS age FROM p JOIN q ON q.symbol = p.symbol AND q.side = p.side AND q.i = p.i + 1) z),
ev AS MATERIALIZED (SELECT p.symbol, p.i, p.side, CASE p.side WHEN 1 THEN 'H' ELSE 'L' END || p.fired AS pattern_type, p.fired, p.i - p.bars + 1 AS si, p.bars, s.high, s.low, s.cl, s.br, s.bull, s.bear, s.ts, s.ps,
    s.regime, s.ema, s.slope, s.close FROM p JOIN s ON s.symbol = p.symbol AND s.i = p.i WHERE p.fired > 0)
"""
)

_MARKS = """, mk AS MATERIALIZED (SELECT symbol, i, i >= 9 AND (avg(rng) OVER w <= 0 OR (avg(ov) OVER (PARTITION BY symbol ORDER BY i ROWS 8 PRECEDING) >= 0.65 AND (max(high) OVER w - min(low) OVER w) / nullif(avg(rng) OVER w, 0) <= 4)) AS tight,
    i >= 9 AND sum(CAST(tb AND bull AS INT)) OVER w >= 4 AS bullc, i >= 9 AND sum(CAST(tb AND bear AS INT)) OVER w >= 4 AS bearc FROM s WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 9 PRECEDING))
"""

def _filters(x: SetupConfig) -> str:
    """Rejections and warnings of every event under some settings."""
    tight, climax, room = x.reject_tight_trading_range, x.reject_recent_climax, x.reject_insufficient_room
    return f"""e6 AS MATERIALIZED (SELECT *, list_filter([
    CASE WHEN fired <> 2 THEN 'second_entry_pattern_required' END,
    CASE WHEN NOT (CASE side WHEN 1 THEN regime IN ('BULL_TREND', 'STRONG_BULL_TREND') ELSE regime IN ('BEAR_TREND', 'STRONG_BEAR_TREND') END) THEN 'market_regime_not_with_trend' END,
    CASE WHEN NOT coalesce(side * (close - ema) > 0 AND side * slope > 0, false) THEN 'ema_not_aligned' END,
    CASE WHEN score < {x.minimum_pattern_score!r} THEN 'pattern_quality_below_minimum' END, CASE WHEN side * ts < {x.minimum_context_score!r} THEN 'context_score_below_minimum' END,
    CASE WHEN br < {x.minimum_signal_body_ratio!r} THEN 'signal_bar_body_too_small' END,
    CASE WHEN CASE side WHEN 1 THEN cl < {x.minimum_signal_close_location!r}::DOUBLE ELSE cl > {1.0 - x.minimum_signal_close_location!r}::DOUBLE END THEN 'signal_bar_close_too_weak' END,
    CASE WHEN side * ps < {x.minimum_directional_pressure!r} THEN 'opposite_or_insufficient_pressure' END,
    CASE WHEN depth > {x.maximum_pullback_depth_ranges!r} THEN 'pullback_too_deep' END, CASE WHEN {tight} AND tight THEN 'tight_trading_range' END, CASE WHEN {climax} AND climax THEN 'recent_climax' END,
    CASE WHEN risk <= 0 THEN 'non_positive_initial_risk' END, CASE WHEN {room} AND room < {x.minimum_room_to_target_r!r} THEN 'insufficient_room_to_target' END], lambda v: v IS NOT NULL) AS rej,
  list_filter([CASE WHEN NOT (CASE side WHEN 1 THEN bull ELSE bear END) THEN 'signal_bar_not_directional' END, CASE WHEN NOT {tight} AND tight THEN 'tight_trading_range' END,
    CASE WHEN NOT {climax} AND climax THEN 'recent_climax' END, CASE WHEN NOT {room} AND room < {x.minimum_room_to_target_r!r} THEN 'insufficient_room_to_target' END], lambda v: v IS NOT NULL) AS warn FROM e5)"""


_SETUPS = (
    _STATES
    + _MARKS
    + """, e1 AS (SELECT *, CASE side WHEN 1 THEN ceil(CAST(high + 0.01 AS DECIMAL(28,9)) * 100) / 100.0 ELSE floor(CAST(low - 0.01 AS DECIMAL(28,9)) * 100) / 100.0 END AS entry,
    least(1.0, greatest(0.0, 0.5 * greatest(0, side * ts) + 0.3 * CASE side WHEN 1 THEN cl ELSE 1 - cl END + 0.2 * CASE WHEN (side = 1 AND bull) OR (side = -1 AND bear) THEN br ELSE 0 END)) AS score FROM ev),
e2 AS (SELECT e1.symbol, e1.i, e1.side, max(s.high) FILTER (s.i >= e1.si) AS pbh, min(s.low) FILTER (s.i >= e1.si) AS pbl, avg(s.rng) FILTER (s.i >= e1.si) AS pbr,
    min(s.high) FILTER (s.i < e1.si AND s.high > e1.entry) AS res, max(s.low) FILTER (s.i < e1.si AND s.low < e1.entry) AS sup
  FROM e1 JOIN s ON s.symbol = e1.symbol AND s.i BETWEEN e1.si - 20 AND e1.i GROUP BY ALL),
e3 AS (SELECT e1.*, e2.pbh, e2.pbl, e2.pbr, e2.res, e2.sup, mk.tight, CASE e1.side WHEN 1 THEN mk.bullc ELSE mk.bearc END AS climax,
    CASE e1.side WHEN 1 THEN floor(CAST(pbl - 0.01 AS DECIMAL(28,9)) * 100) / 100.0 ELSE ceil(CAST(pbh + 0.01 AS DECIMAL(28,9)) * 100) / 100.0 END AS stop FROM e1 JOIN e2 USING (symbol, i, side) JOIN mk USING (symbol, i)),
e4 AS (SELECT *, abs(entry - stop) AS risk, CASE WHEN pbr > 0 THEN (pbh - pbl) / pbr ELSE 0 END AS depth FROM e3),
e5 AS (SELECT *, (round(CAST(entry AS DECIMAL(28,9)) * 100, 0) + side * 2 * round(CAST(risk AS DECIMAL(28,9)) * 100, 0)) / 100.0 AS target,
    CASE WHEN risk > 0 AND si > 0 THEN CASE side WHEN 1 THEN res - entry ELSE entry - sup END / risk END AS room FROM e4),
"""
    + _filters(WIDE.setup)
)

_MOVES = (
    _STATES
    + """, mv AS (SELECT b.symbol, b.side, b.i, a.ph AS was, b.ph AS now, b.fired, b.bars, q.ctx, q.dn FROM p b JOIN p a ON a.symbol = b.symbol AND a.side = b.side AND a.i = b.i - 1 JOIN q ON q.symbol = b.symbol AND q.side = b.side AND q.i = b.i),
tx AS (SELECT symbol, side, unnest(list_filter([CASE WHEN was > 0 AND NOT ctx THEN 'lost' END, CASE WHEN was > 0 AND ctx AND bars > 20 THEN 'expired' END, CASE WHEN was = 0 AND now = 1 THEN 'start' END, CASE WHEN was = 1 AND fired = 1 THEN 'first' END,
    CASE WHEN was = 2 AND now = 3 THEN 'leg' END, CASE WHEN was = 3 AND ctx AND bars <= 20 THEN 'arm' END, CASE WHEN fired = 2 THEN 'second' END], lambda v: v IS NOT NULL)) AS why FROM mv)
SELECT symbol, CASE side WHEN 1 THEN 'H1H2' ELSE 'L1L2' END AS detector, CASE why WHEN 'lost' THEN CASE side WHEN 1 THEN 'long' ELSE 'short' END || '_context_lost' WHEN 'expired' THEN 'pullback_expired' WHEN 'arm' THEN 'second_attempt_armed'
    WHEN 'start' THEN CASE side WHEN 1 THEN 'bear_bar_or_lower_low' ELSE 'bull_bar_or_higher_high' END WHEN 'leg' THEN CASE side WHEN 1 THEN 'new_down_leg_after_h1' ELSE 'new_up_leg_after_l1' END
    ELSE why || CASE side WHEN 1 THEN '_up_attempt' ELSE '_down_attempt' END END AS condition, count(*) AS n FROM tx GROUP BY ALL"""
)

# one step of the recursion is one bar: w is the waiting order, p the open position, o and t what ended on the bar
_BROKER = (
    _SETUPS
    + """, bb AS MATERIALIZED (SELECT s.symbol, s.i, s.timestamp AS tm, s.open AS o, s.high AS h, s.low AS l, s.close AS c, g.side, g.entry, g.stop, g.target, s.i = max(s.i) OVER (PARTITION BY s.symbol) AS final
    FROM s LEFT JOIN (SELECT * FROM e6 WHERE len(rej) = 0) g ON g.symbol = s.symbol AND g.i = s.i),
br AS (SELECT symbol, CAST(-1 AS BIGINT) AS i, CAST(100000.0 AS DOUBLE) AS cash, 0 AS ids, 0 AS deals, NULL::STRUCT(no INT, sig BIGINT, tm TIMESTAMP, side INT, qty DOUBLE, entry DOUBLE, stop DOUBLE, target DOUBLE) AS w,
    NULL::STRUCT(no INT, sig BIGINT, tm TIMESTAMP, side INT, qty DOUBLE, trig DOUBLE, stop DOUBLE, target DOUBLE, idx BIGINT, since TIMESTAMP, entry DOUBLE, mfe DOUBLE, mae DOUBLE) AS p, NULL::INT AS cancelled, NULL::VARCHAR AS why,
    NULL::STRUCT(no INT, sig BIGINT, tm TIMESTAMP, side INT, qty DOUBLE, entry DOUBLE, stop DOUBLE, target DOUBLE) AS gone, NULL::VARCHAR AS reason, NULL::DOUBLE AS px, NULL::DOUBLE AS pnl,
    NULL::STRUCT(no INT, sig BIGINT, tm TIMESTAMP, side INT, qty DOUBLE, trig DOUBLE, stop DOUBLE, target DOUBLE, idx BIGINT, since TIMESTAMP, entry DOUBLE, mfe DOUBLE, mae DOUBLE) AS done FROM (SELECT DISTINCT symbol FROM bb)
  UNION ALL SELECT symbol, i, cash, ids + CAST(entering AS INT), deals, CASE WHEN entering AND NOT final THEN nw END, CASE WHEN reason IS NULL THEN p END,
    CASE WHEN lapsed IS NOT NULL THEN lapsed.no WHEN final AND entering THEN nw.no END, CASE WHEN lapsed IS NOT NULL THEN 'PENDING_ORDER_EXPIRED' WHEN final AND entering THEN 'END_OF_DATA' END,
    CASE WHEN lapsed IS NOT NULL THEN lapsed WHEN final AND entering THEN nw END, reason, px, pnl, CASE WHEN reason IS NOT NULL THEN p END
  FROM (SELECT *, side IS NOT NULL AND (p IS NULL OR r0 IS NOT NULL) AND qty > 0 AS entering, {'no': ids + 1, 'sig': i, 'tm': tm, 'side': side, 'qty': qty, 'entry': entry, 'stop': stop, 'target': target} AS nw
    FROM (SELECT * REPLACE (ids + CAST(reason IS NOT NULL AS INT) AS ids, cash + coalesce(p.side * (px - p.entry) * p.qty - 0.25, 0) AS cash), p.side * (px - p.entry) * p.qty - 0.25 AS pnl,
        floor((cash + coalesce(p.side * (px - p.entry) * p.qty - 0.25, 0)) * 0.005 / abs(entry - stop)) AS qty
      FROM (SELECT *, CASE WHEN r0 IS NOT NULL THEN r0 WHEN final AND p IS NOT NULL THEN 'END_OF_DATA' END AS reason,
          CASE WHEN r0 IS NULL THEN CASE WHEN final AND p IS NOT NULL THEN c - p.side * 0.01 END WHEN fresh AND mo >= tg THEN p.side * (mo - 0.01)
               WHEN r0 = 'STOP_LOSS' THEN p.side * (CASE WHEN fresh THEN st ELSE least(mo, st) END - 0.01) ELSE p.side * (CASE WHEN fresh THEN tg ELSE greatest(mo, tg) END - 0.01) END AS px
        FROM (SELECT *, CASE WHEN p IS NULL THEN NULL WHEN fresh AND mo >= tg THEN 'TARGET' WHEN NOT fresh AND mo <= st THEN 'STOP_LOSS' WHEN NOT fresh AND mo >= tg THEN 'TARGET'
              WHEN least(mo, mw) <= st THEN 'STOP_LOSS' WHEN greatest(mo, mb) >= tg THEN 'TARGET' END AS r0
          FROM (SELECT * REPLACE (CASE WHEN p IS NOT NULL THEN {'no': p.no, 'sig': p.sig, 'tm': p.tm, 'side': p.side, 'qty': p.qty, 'trig': p.trig, 'stop': p.stop, 'target': p.target, 'idx': p.idx, 'since': p.since, 'entry': p.entry,
                'mfe': greatest(p.mfe, CASE p.side WHEN 1 THEN h - p.entry ELSE p.entry - l END), 'mae': greatest(p.mae, CASE p.side WHEN 1 THEN p.entry - l ELSE h - p.entry END)} END AS p),
              p.side * o AS mo, p.side * CASE p.side WHEN 1 THEN h ELSE l END AS mb, p.side * CASE p.side WHEN 1 THEN l ELSE h END AS mw, p.side * p.stop AS st, p.side * p.target AS tg
            FROM (SELECT bb.symbol, bb.i, bb.tm, bb.o, bb.h, bb.l, bb.c, bb.side, bb.entry, bb.stop, bb.target, bb.final, br.cash, br.ids, br.deals + CAST(hit AS INT) AS deals, hit AS fresh,
                CASE WHEN NOT hit AND br.w IS NOT NULL THEN br.w END AS lapsed, NULL::STRUCT(no INT, sig BIGINT, tm TIMESTAMP, side INT, qty DOUBLE, entry DOUBLE, stop DOUBLE, target DOUBLE) AS w,
                CASE WHEN hit THEN {'no': br.w.no, 'sig': br.w.sig, 'tm': br.w.tm, 'side': br.w.side, 'qty': br.w.qty, 'trig': br.w.entry, 'stop': br.w.stop, 'target': br.w.target, 'idx': bb.i, 'since': bb.tm,
                  'entry': CASE br.w.side WHEN 1 THEN greatest(bb.o, br.w.entry) ELSE least(bb.o, br.w.entry) END + br.w.side * 0.01, 'mfe': 0.0, 'mae': 0.0} ELSE br.p END AS p
              FROM (SELECT br.*, coalesce(CASE br.w.side WHEN 1 THEN n.h >= br.w.entry WHEN -1 THEN n.l <= br.w.entry END, false) AS hit FROM br JOIN bb n ON n.symbol = br.symbol AND n.i = br.i + 1) br
              JOIN bb ON bb.symbol = br.symbol AND bb.i = br.i + 1)))))) ),
od AS MATERIALIZED (SELECT symbol, 'CANCELLED' AS status, gone.no AS no, NULL::INT AS xno, gone.sig AS sig, gone.tm AS tm, gone.side AS side, gone.qty AS qty, gone.entry AS trig, why, NULL::INT AS deal, NULL::DOUBLE AS entry, NULL::DOUBLE AS px, NULL::VARCHAR AS reason, NULL::DOUBLE AS pnl, NULL::DOUBLE AS cash,
    NULL::DOUBLE AS mfe, NULL::DOUBLE AS mae, NULL::DOUBLE AS stop, NULL::DOUBLE AS target, NULL::BIGINT AS idx, NULL::BIGINT AS xi, NULL::TIMESTAMP AS since FROM br WHERE gone IS NOT NULL
  UNION ALL SELECT symbol, 'FILLED', done.no, done.no + 1, done.sig, done.tm, done.side, done.qty, done.trig, NULL, deals, done.entry, px, reason, pnl, cash, done.mfe, done.mae, done.stop, done.target, done.idx, i, done.since FROM br WHERE done IS NOT NULL),
tr AS (SELECT od.*, bb.tm AS xat, 'trade-' || lpad(CAST(deal AS VARCHAR), 6, '0') AS trade_id FROM od JOIN bb ON bb.symbol = od.symbol AND bb.i = od.xi WHERE status = 'FILLED'),
hs AS (SELECT symbol, no, 1 AS seq, tm, side, 'STOP' AS kind, qty, trig AS price, 'PENDING' AS status, NULL::TIMESTAMP AS fat, NULL::DOUBLE AS fpx, NULL::VARCHAR AS why FROM od
  UNION ALL SELECT symbol, no, 2, tm, side, 'STOP', qty, trig, status, since, entry, why FROM od
  UNION ALL SELECT symbol, xno, 2, xat, side, CASE reason WHEN 'STOP_LOSS' THEN 'STOP' WHEN 'TARGET' THEN 'LIMIT' ELSE 'MARKET' END, qty, CASE reason WHEN 'STOP_LOSS' THEN stop WHEN 'TARGET' THEN target END, 'FILLED', xat, px, NULL FROM tr)
"""
)

_REASONS = "second_entry_pattern; market_regime_with_trend; ema_aligned; context_and_pattern_quality_accepted; signal_bar_quality_accepted; directional_pressure_accepted; pullback_depth_accepted; trading_range_filter_passed; climax_filter_passed; room_to_target_accepted"

_REJECT = """CASE WHEN timestamp IS NULL THEN 'null_key' WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL OR isnan(open) OR isnan(high) OR isnan(low) OR isnan(close) OR isnan(volume)
  OR isinf(open) OR isinf(high) OR isinf(low) OR isinf(close) OR isinf(volume) THEN 'not_finite' WHEN high < low THEN 'high_below_low' WHEN high < greatest(open, close) THEN 'high_below_body'
  WHEN low > least(open, close) THEN 'low_above_body' WHEN volume < 0 THEN 'negative_volume' END"""

_CLEAN = f"""
WITH g AS (SELECT *, {_REJECT} AS reason FROM sample_ohlcv),
b AS (SELECT * FROM g WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY symbol, timeframe, timestamp ORDER BY received_at DESC NULLS LAST, bar_id DESC) = 1)
"""

def _conditions(rows: str) -> str:
    """Completed trades of ``rows`` with their buckets; the session is that of the instant which the text of the entry time denotes."""
    return f"""
WITH {CLOCKS}, l AS ({rows}),
t AS (SELECT l.*, CASE direction WHEN 'LONG' THEN 1 ELSE -1 END AS side, timezone('America/New_York', make_timestamptz(utc_us)) AS local FROM l LEFT JOIN clocks k ON k.rec_table = 'trade_log' AND k.rec_id = l.row_id AND k.readings = 1
  WHERE exit_time IS NOT NULL AND exit_price IS NOT NULL AND pnl IS NOT NULL AND pnl_r IS NOT NULL AND NOT isnan(pnl_r) AND NOT isnan(pnl)),
u AS (SELECT *, (0.5 * signal_body_ratio + 0.5 * CASE side WHEN 1 THEN signal_close_location ELSE 1 - signal_close_location END) / 1.0 AS sq, side * ema_slope_ratio AS sl,
    hour(local) * 60 + minute(local) AS mi FROM t),
c AS (SELECT *, CASE WHEN sq <= 0.5 THEN 'WEAK' WHEN sq >= 0.75 THEN 'STRONG' ELSE 'ACCEPTABLE' END AS signal_bar_quality,
    CASE WHEN sl < 0 THEN 'OPPOSING' WHEN sl <= 0.0001 THEN 'FLAT' WHEN sl >= 0.0005 THEN 'STRONG' ELSE 'MODERATE' END AS ema_slope_bucket,
    CASE WHEN mi IS NULL THEN 'UNKNOWN' WHEN mi < 570 THEN 'PREMARKET' WHEN mi < 630 THEN 'OPEN' WHEN mi < 900 THEN 'MIDDAY' WHEN mi < 960 THEN 'CLOSE' ELSE 'AFTER_HOURS' END AS session,
    CASE WHEN volatility_range_ratio <= 0.0025 THEN 'LOW' WHEN volatility_range_ratio >= 0.0075 THEN 'HIGH' ELSE 'NORMAL' END AS volatility_regime FROM u)
"""


_LOG = _conditions("SELECT * FROM trade_log QUALIFY trade_id IS NULL OR row_number() OVER (PARTITION BY trade_id ORDER BY row_id DESC) = 1")

_SCOPED = (
    _LOG
    + """, k AS (
  SELECT 'OVERALL' AS scope, NULL AS pt, NULL AS mr, NULL AS q, NULL AS es, NULL AS se, NULL AS vr, * FROM c UNION ALL SELECT 'PATTERN', pattern_type, NULL, NULL, NULL, NULL, NULL, * FROM c
  UNION ALL SELECT 'PATTERN_REGIME', pattern_type, market_regime, NULL, NULL, NULL, NULL, * FROM c UNION ALL SELECT 'PATTERN_SIGNAL_QUALITY', pattern_type, NULL, signal_bar_quality, NULL, NULL, NULL, * FROM c
  UNION ALL SELECT 'PATTERN_EMA_SLOPE', pattern_type, NULL, NULL, ema_slope_bucket, NULL, NULL, * FROM c UNION ALL SELECT 'PATTERN_SESSION', pattern_type, NULL, NULL, NULL, session, NULL, * FROM c
  UNION ALL SELECT 'PATTERN_VOLATILITY', pattern_type, NULL, NULL, NULL, NULL, volatility_regime, * FROM c),
o AS (SELECT *, sum(pnl) OVER w AS cum FROM k WINDOW w AS (PARTITION BY symbol, timeframe, strategy_version, scope, pt, mr, q, es, se, vr ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING)),
y AS (SELECT *, greatest(0, max(cum) OVER w) AS peak FROM o WINDOW w AS (PARTITION BY symbol, timeframe, strategy_version, scope, pt, mr, q, es, se, vr ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING)),
z AS (SELECT symbol, timeframe, strategy_version, scope, pt AS pattern_type, mr AS market_regime, q AS signal_bar_quality, es AS ema_slope_bucket, se AS session, vr AS volatility_regime,
  count(*) AS total, count(*) FILTER (pnl_r > 0) AS wins, count(*) FILTER (pnl_r < 0) AS losses, avg(pnl_r) FILTER (pnl_r > 0) AS aw, avg(pnl_r) FILTER (pnl_r < 0) AS al, avg(pnl_r) AS ar,
  sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS gp, -sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END) AS gl, max(peak - cum) AS dd, median(mfe) AS a, median(mae) AS b, median(mfe_r) AS c, median(mae_r) AS d FROM y GROUP BY ALL)
"""
)

_f = "SELECT symbol, i AS bar_index"

ORACLE = {
    "ohlcv_bars": _BARS + "SELECT * FROM b",
    "ohlcv_validate_rejects": f"SELECT bar_id, reason FROM (SELECT bar_id, {_REJECT} AS reason FROM sample_ohlcv) WHERE reason IS NOT NULL",
    "ohlcv_duplicate_keys": "SELECT symbol, timeframe, epoch_us(timestamp) AS ts_us, count(*) AS copies FROM sample_ohlcv GROUP BY ALL HAVING count(*) > 1",
    "ohlcv_dedupe_keep_last": "SELECT bar_id FROM sample_ohlcv QUALIFY row_number() OVER (PARTITION BY symbol, timeframe, timestamp ORDER BY received_at DESC NULLS LAST, bar_id DESC) = 1",
    "session_resample": _CLEAN
    + """, o AS (SELECT *, CAST(timezone('America/New_York', timestamp) AS DATE) AS sd, epoch_us(timestamp) AS u FROM b WHERE timeframe = '30m'),
m AS (SELECT *, min(u) OVER (PARTITION BY symbol, timeframe, sd) AS og FROM o), n AS (SELECT *, (u - og) // 3600000000 AS bin FROM m)
SELECT symbol, '60m' AS timeframe, (og + bin * 3600000000) // 1000000 AS ts_s, arg_min(open, u) AS open, max(high) AS high, min(low) AS low, arg_max(close, u) AS close, round(sum(volume), 4) AS volume
FROM n GROUP BY symbol, sd, og, bin""",
    "session_coverage": _CLEAN + "SELECT symbol, timeframe, epoch_us(min(timestamp)) AS first_us, epoch_us(max(timestamp)) AS last_us, arg_max(close, timestamp) AS last_close, count(*) AS n_bars, round(avg(volume), 4) AS mean_volume FROM b GROUP BY ALL",
    "bar_features": _FEATURES
    + _f
    + """, round(rng, 9) AS range, round(bd, 9) AS body, round(br, 9) AS body_ratio, round(ut, 9) AS upper_tail, round(lt, 9) AS lower_tail, round(utr, 9) AS upper_tail_ratio, round(ltr, 9) AS lower_tail_ratio,
  round(cl, 9) AS close_location, bull AS bull_bar, bear AS bear_bar, doji, tb AS trend_bar, inb AS inside_bar, outb AS outside_bar, hh AS higher_high, hl AS higher_low, lh AS lower_high, ll AS lower_low, round(ov, 9) AS overlap_previous FROM g""",
    "sample_bar_features": _CLEAN
    + """, x AS (SELECT *, lag(high) OVER w AS ph, lag(low) OVER w AS pl, high - low AS rng, abs(close - open) AS bd FROM b WINDOW w AS (PARTITION BY symbol, timeframe ORDER BY timestamp))
SELECT symbol, timeframe, count(*) AS bars,
  count(*) FILTER (rng > 0 AND bd / rng >= 0.65 AND ((close > open AND (close - low) / rng >= 0.75) OR (close < open AND (close - low) / rng <= 0.25))) AS n_trend_bar, count(*) FILTER (rng = 0 OR bd / rng <= 0.2) AS n_doji,
  count(*) FILTER (high <= ph AND low >= pl AND NOT (high = ph AND low = pl)) AS n_inside_bar, count(*) FILTER (high >= ph AND low <= pl AND NOT (high = ph AND low = pl)) AS n_outside_bar,
  count(*) FILTER (high > ph) AS n_higher_high, count(*) FILTER (low < pl) AS n_lower_low FROM x GROUP BY ALL""",
    "bar_class_counts": _FEATURES + "SELECT symbol, count(*) AS bars, count(*) FILTER (tb) AS n_trend_bar, count(*) FILTER (doji) AS n_doji, count(*) FILTER (inb) AS n_inside_bar, count(*) FILTER (outb) AS n_outside_bar FROM g GROUP BY symbol",
    "ema_slope": _EMA + _f + ", round(ema, 6) AS ema20, round(close - ema, 6) AS distance_to_ema, round(slope, 6) AS ema_slope FROM h",
    "context_scores": _SCORES + _f + ", round(es, 6) AS ema_score, round(ss, 6) AS structure_score, round(ps, 6) AS pressure_score, round(os, 6) AS overlap_score, round(bs, 6) AS breakout_score, round(ts, 6) AS trend_score FROM c",
    "regime_labels": _SCORES + "SELECT symbol, regime, count(*) AS bars FROM c GROUP BY ALL",
    "always_in_state": _STATES + _f + ", always_in FROM s",
    "pattern_events": _SETUPS + _f + ", pattern_type, CASE side WHEN 1 THEN 'LONG' ELSE 'SHORT' END AS direction, si AS start_index, bars AS pullback_bars, round(CASE side WHEN 1 THEN high ELSE low END, 6) AS trigger_price, round(score, 6) AS pattern_score FROM e1",
    "setup_evaluations": _SETUPS
    + _f
    + ", pattern_type, len(rej) = 0 AS accepted, array_to_string(rej, ',') AS rejections, array_to_string(warn, ',') AS warnings, round(entry, 6) AS entry, round(stop, 6) AS stop, round(target, 6) AS target, round(depth, 6) AS pullback_depth, round(room, 6) AS room_r FROM e6",
    "setup_rejection_counts": _SETUPS + "SELECT symbol, reason, count(*) AS n FROM (SELECT symbol, unnest(rej) AS reason FROM e6) GROUP BY ALL",
    "tight_range_flags": _STATES + _MARKS + _f + " FROM mk WHERE tight",
    "climax_flags": _STATES + _MARKS + _f + ", bullc AS bull_climax, bearc AS bear_climax FROM mk WHERE bullc OR bearc",
    "signals": _SETUPS + _f + f", CASE side WHEN 1 THEN 'LONG' ELSE 'SHORT' END AS direction, round(entry, 6) AS entry, round(stop, 6) AS stop, round(target, 6) AS target, '{_REASONS}' AS reasons FROM e6 WHERE len(rej) = 0",
    "expected_values": _SETUPS
    + _f
    + ", round(risk, 6) AS risk, round(abs(target - entry), 6) AS reward, round(abs(target - entry) / risk, 6) AS ratio, round(0.5 * abs(target - entry) - 0.5 * risk - 0.02, 6) AS ev, round((0.5 * abs(target - entry) - 0.5 * risk - 0.02) / risk, 6) AS ev_r FROM e6 WHERE len(rej) = 0",
    "pattern_transitions": _MOVES,
    "orders": _BROKER + "SELECT symbol, status, coalesce(reason, why) AS reason, count(*) AS n FROM od GROUP BY ALL",
    "order_history": _BROKER
    + """SELECT symbol, 'order-' || lpad(CAST(no AS VARCHAR), 6, '0') AS order_id, seq, epoch_us(tm) // 1000000 AS at_s, CASE side WHEN 1 THEN 'LONG' ELSE 'SHORT' END AS direction, kind AS order_type, qty AS quantity, round(price, 6) AS price, status,
  epoch_us(fat) // 1000000 AS filled_s, round(fpx, 6) AS filled_price, why AS rejection FROM hs""",
    "order_latest_state": _BROKER + "SELECT symbol, 'order-' || lpad(CAST(no AS VARCHAR), 6, '0') AS order_id, kind AS order_type, status, why AS rejection FROM hs QUALIFY row_number() OVER (PARTITION BY symbol, no ORDER BY seq DESC) = 1",
    "trade_log": _BROKER
    + """SELECT trade_id, symbol, CASE side WHEN 1 THEN 'H2' ELSE 'L2' END || '_WITH_TREND' AS setup, CASE side WHEN 1 THEN 'LONG' ELSE 'SHORT' END AS direction, round(entry, 6) AS entry_price, round(px, 6) AS exit_price, qty AS quantity,
  round(pnl, 6) AS pnl, round(pnl / (abs(entry - stop) * qty), 6) AS pnl_r, round(mfe, 6) AS mfe, round(mae, 6) AS mae, CAST(xi - idx + 1 AS INT) AS bars_held, sig AS signal_bar_index, reason AS exit_reason FROM tr""",
    "equity_curve": _BROKER + "SELECT symbol, trade_id, round(pnl, 6) AS pnl, round(cash, 6) AS cash FROM tr",
    "mfe_mae_excursion": _BROKER
    + "SELECT tr.symbol, '1h' AS timeframe, deal AS trade_no, round(greatest(0, max(CASE side WHEN 1 THEN s.high - entry ELSE entry - s.low END)), 6) AS mfe, round(greatest(0, max(CASE side WHEN 1 THEN entry - s.low ELSE s.high - entry END)), 6) AS mae FROM tr JOIN s ON s.symbol = tr.symbol AND s.i BETWEEN idx AND xi GROUP BY ALL",
    "chart_markers": _BROKER
    + "SELECT symbol, trade_id, kind, epoch_us(t) // 1000000 AS at_s, round(v, 6) AS price FROM (SELECT symbol, trade_id, 'entry' AS kind, since AS t, entry AS v FROM tr UNION ALL SELECT symbol, trade_id, 'exit', xat, px FROM tr) m JOIN (SELECT symbol AS y, min(timestamp) AS since0, max(timestamp) AS till FROM s JOIN (SELECT symbol AS x, max(i) AS top FROM s GROUP BY 1) ON symbol = x AND i > top - 2000 GROUP BY 1) ON y = symbol AND t BETWEEN since0 AND till",
    "trade_condition_buckets": _conditions("SELECT * FROM trade_log") + "SELECT row_id, signal_bar_quality, ema_slope_bucket, session, volatility_regime FROM c",
    "setup_statistics_7_scopes": _SCOPED
    + """SELECT symbol, timeframe, strategy_version, scope, pattern_type, market_regime, signal_bar_quality, ema_slope_bucket, session, volatility_regime, total, wins, losses, total - wins - losses AS breakevens,
  wins / total AS win_rate, CASE WHEN total >= 30 THEN wins / total END AS probability_win, round(aw * wins, 6) / nullif(wins, 0) AS avg_win_r, round(al * losses, 6) / nullif(losses, 0) AS avg_loss_r,
  round(ar * total, 6) / total AS avg_r, round(ar * total, 6) / total AS expectancy_r,
  round(CASE WHEN gl > 0 THEN gp / gl END, 9) AS profit_factor, round(dd, 9) AS max_drawdown, round(a, 9) AS median_mfe, round(b, 9) AS median_mae, round(c, 9) AS median_mfe_r, round(d, 9) AS median_mae_r FROM z""",
    "setup_statistics_grouping_sets": _LOG
    + """, g AS (SELECT symbol, timeframe, strategy_version, pattern_type, market_regime, count(*) AS total, count(*) FILTER (pnl_r > 0) AS wins,
  grouping_id(symbol, timeframe, strategy_version, pattern_type, market_regime, signal_bar_quality, ema_slope_bucket, session, volatility_regime) AS bits FROM c
  GROUP BY GROUPING SETS ((symbol, timeframe, strategy_version), (symbol, timeframe, strategy_version, pattern_type), (symbol, timeframe, strategy_version, pattern_type, market_regime),
    (symbol, timeframe, strategy_version, pattern_type, signal_bar_quality), (symbol, timeframe, strategy_version, pattern_type, ema_slope_bucket), (symbol, timeframe, strategy_version, pattern_type, session),
    (symbol, timeframe, strategy_version, pattern_type, volatility_regime)))
SELECT symbol, timeframe, pattern_type, market_regime, CAST(sum(total) AS BIGINT) AS total, CAST(sum(wins) AS BIGINT) AS wins FROM g GROUP BY symbol, timeframe, pattern_type, market_regime, bits""",
    "backtest_metrics": _LOG
    + """, o AS (SELECT *, sum(pnl) OVER w AS cum FROM c WINDOW w AS (PARTITION BY symbol ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING)),
y AS (SELECT *, greatest(0, max(cum) OVER w) AS peak FROM o WINDOW w AS (PARTITION BY symbol ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING)),
z AS (SELECT symbol, count(*) AS n, count(*) FILTER (pnl > 0) AS w, count(*) FILTER (pnl < 0) AS l, sum(pnl) AS p, avg(pnl_r) AS r, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS gp, -sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END) AS gl, max(peak - cum) AS dd FROM y GROUP BY symbol)
SELECT symbol, n AS total_trades, w AS wins, l AS losses, w / n AS win_rate, round(p, 9) AS net_pnl, round(p / 100000, 9) AS total_return, round(r * n, 6) / n AS expectancy_r,
  round(CASE WHEN gl > 0 THEN gp / gl WHEN gp > 0 THEN 'inf'::DOUBLE END, 9) AS profit_factor, round(dd, 9) AS max_drawdown FROM z""",
    "empirical_probability": _LOG
    + """, g AS (SELECT symbol, timeframe, strategy_version, pattern_type, market_regime, count(*) AS n, count(*) FILTER (pnl_r > 0) AS w,
  pattern_type IS NOT NULL AND market_regime IS NOT NULL AS known FROM c GROUP BY symbol, timeframe, strategy_version, pattern_type, market_regime)
SELECT symbol, timeframe, strategy_version, pattern_type, market_regime, CASE WHEN known THEN n END AS total, CASE WHEN known AND n >= 30 THEN w / n END AS probability_win,
  CASE WHEN NOT known THEN 'NO_MATCHING_STATISTICS' WHEN n < 30 THEN 'INSUFFICIENT_SAMPLE' ELSE 'AVAILABLE' END AS evidence FROM g""",
    "trade_coverage": _LOG + "SELECT symbol, timeframe, epoch_us(min(exit_time)) AS first_us, epoch_us(max(exit_time)) AS last_us, count(*) AS n_trades, round(sum(pnl), 6) AS pnl, count(*) FILTER (pnl > 0) / count(*) AS win_rate FROM c GROUP BY ALL",
    "chart_window": _BARS + ", x AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS bar_index, count(*) OVER (PARTITION BY symbol) AS n FROM b) SELECT symbol, bar_index, close FROM x WHERE bar_index >= n - 50",
    "dimension_values": "SELECT DISTINCT market_regime FROM trade_log WHERE market_regime IS NOT NULL",
    "filtered_statistics": _SCOPED + "SELECT symbol, timeframe, strategy_version, pattern_type, total, wins FROM z WHERE scope = 'PATTERN_REGIME' AND market_regime = 'BULL_TREND'",
    "session_minutes": """WITH d AS (SELECT CAST(unnest(generate_series(DATE '2025-08-01', DATE '2025-11-30', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT strftime(day, '%Y-%m-%d') AS session_date, CASE WHEN day = DATE '2025-11-28' THEN 210 ELSE 390 END AS minutes, CAST(epoch(timezone('America/New_York', day + INTERVAL 570 MINUTE)) AS BIGINT) AS open_s
FROM d WHERE isodow(day) < 6 AND day NOT IN (DATE '2025-09-01', DATE '2025-11-27')""",
    "session_minute_gaps": f"""WITH b AS (SELECT DISTINCT symbol, timeframe, date_trunc('minute', timestamp) AS m FROM (SELECT *, {_REJECT} AS reason FROM sample_ohlcv) WHERE reason IS NULL AND timeframe LIKE '%m'),
d AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT min(CAST(timezone('America/New_York', m) AS DATE)) AS lo, max(CAST(timezone('America/New_York', m) AS DATE)) AS hi FROM b)),
s AS (SELECT timezone('America/New_York', day + to_minutes(CAST(570 + k AS INT))) AS m FROM d, range(390) r(k) WHERE isodow(day) < 6 AND day NOT IN (DATE '2025-07-04', DATE '2025-09-01', DATE '2025-11-27', DATE '2025-12-25')
  AND (k < 210 OR day NOT IN (DATE '2025-07-03', DATE '2025-11-28', DATE '2025-12-24'))),
w AS (SELECT symbol, timeframe, m FROM (SELECT DISTINCT symbol, timeframe FROM b), s)
SELECT symbol, timeframe, 'missing' AS kind, count(*) AS n FROM (SELECT * FROM w EXCEPT SELECT * FROM b) GROUP BY ALL UNION ALL SELECT symbol, timeframe, 'extra', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM w) GROUP BY ALL""",
    "ohlcv_minute_gaps": f"""WITH b AS (SELECT DISTINCT symbol, timeframe, epoch(timestamp) // 60 AS m FROM (SELECT *, {_REJECT} AS reason FROM sample_ohlcv) WHERE reason IS NULL AND timeframe = '1m'),
w AS (SELECT DISTINCT symbol, timeframe, unnest(generate_series(CAST(epoch(open_ts) AS BIGINT) // 60, CAST(epoch(close_ts) AS BIGINT) // 60 - 1)) AS m FROM session_plan WHERE timeframe = '1m'),
g AS (SELECT symbol, timeframe, m, 'missing' AS kind FROM (SELECT * FROM w EXCEPT SELECT * FROM b) UNION ALL SELECT symbol, timeframe, m, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM w))
SELECT symbol, timeframe, strftime(make_timestamp(CAST(m * 60000000 AS BIGINT)), '%Y-%m-%d') AS day, kind, count(*) AS n FROM g GROUP BY ALL""",
    "ohlcv_resample": _CLEAN
    + """, o AS (SELECT *, CAST(timezone('America/New_York', timestamp) AS DATE) AS sd, epoch_us(timestamp) AS u, CAST(regexp_extract(timeframe, '^(\\d+)m$', 1) AS INT) AS f FROM b WHERE regexp_matches(timeframe, '^\\d+m$')),
m AS (SELECT *, min(u) OVER (PARTITION BY symbol, timeframe, sd) AS og FROM o), n AS (SELECT m.*, w, (u - og) // (w * 60000000) AS bin FROM m, (VALUES (5::BIGINT), (15), (30), (60)) v(w) WHERE w > f AND w % f = 0)
SELECT symbol, timeframe AS source_timeframe, w || 'm' AS timeframe, (og + bin * w * 60000000) // 1000000 AS ts_s, arg_min(open, u) AS open, max(high) AS high, min(low) AS low, arg_max(close, u) AS close, round(sum(volume), 4) AS volume
FROM n GROUP BY symbol, timeframe, w, sd, og, bin""",
    "stats_labels": """SELECT DISTINCT pattern_type, market_regime, concat_ws(' / ', pattern_type, market_regime) AS label,
  substr(regexp_replace(regexp_replace(lower(concat_ws(' / ', pattern_type, market_regime)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 100) AS slug FROM trade_log""",
}

# the delivered bars in the place of the bars of the events, a series as one name
_DELIVERED = f"""
WITH RECURSIVE raw AS (SELECT *, {_REJECT} AS reason FROM sample_ohlcv),
kept AS (SELECT * FROM raw WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY symbol, timeframe, timestamp ORDER BY received_at DESC NULLS LAST, bar_id DESC) = 1),
b AS MATERIALIZED (SELECT symbol || '|' || timeframe AS symbol, timeframe, CAST(timestamp AS TIMESTAMP) AS timestamp, open, high, low, close, volume FROM kept)
"""


def delivered(sql: str) -> str:
    """A stage's SQL over the delivered bars and with the shipped settings."""
    inner = sql.replace(_BARS, _DELIVERED).replace(_filters(WIDE.setup), _filters(SHIPPED.setup)).replace("'1h' AS timeframe", "NULL AS timeframe")
    kept = "q.* EXCLUDE (symbol, timeframe)" if "NULL AS timeframe" in inner else "q.* EXCLUDE (symbol)"
    return f"SELECT split_part(q.symbol, '|', 1) AS symbol, split_part(q.symbol, '|', 2) AS timeframe, {kept} FROM ({inner}) q"
