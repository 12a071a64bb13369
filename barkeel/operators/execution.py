"""Simulated execution of signals on later bars, sized from running cash.

A fold runs along each series in bar order, batch by batch (``ordered_stream``):
cash and the one open position make a series sequential by nature, but the fold
holds a few numbers only and jumps over bars that cannot matter.  A bar first
meets the waiting order, then the position; a signal of a bar is taken after
that, so it can fill on the next bar at the earliest.  Orders have running numbers
per series, an exit's after its entry's; ``order_history`` lists every state that an
order had, ``order_states`` the last one of each.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import floor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barkeel.config import ExecutionConfig, MarketConfig, Pipeline
from barkeel.operators.blocks import SERIES
from barkeel.shards import ordered_stream


@dataclass
class Position:
    order: dict
    sign: int
    quantity: float
    stop: float
    target: float
    entry_index: int
    entry_time: object
    entry: float
    mfe: float = 0.0
    mae: float = 0.0


def entry_fill(sign: int, open_: float, trigger: float, slip: float) -> float:
    return (max(open_, trigger) if sign > 0 else min(open_, trigger)) + sign * slip


def exit_fill(sign: int, open_: float, high: float, low: float, pos: Position, entered: bool, policy: str, slip: float) -> tuple[str, float] | None:
    """Reason and price of an exit on this bar, or None; prices are mirrored so that up is good."""
    o, best, worst = sign * open_, sign * (high if sign > 0 else low), sign * (low if sign > 0 else high)
    stop, target = sign * pos.stop, sign * pos.target
    if entered and o >= target:
        return "TARGET", sign * (o - slip)
    hit_stop, hit_target = min(o, worst) <= stop, max(o, best) >= target
    if not entered and o <= stop:
        reason = "STOP_LOSS"
    elif not entered and o >= target:
        reason = "TARGET"
    elif hit_stop and hit_target:
        reason = "STOP_LOSS" if policy == "adverse" else "TARGET"
    elif hit_stop or hit_target:
        reason = "STOP_LOSS" if hit_stop else "TARGET"
    else:
        return None
    base = stop if reason == "STOP_LOSS" else target
    if not entered:
        base = min(o, base) if reason == "STOP_LOSS" else max(o, base)
    return reason, sign * (base - slip)


# Names of a trade's facts, as far as the trade log has them.
TRADE = [
    ("trade_no", pa.int32()), ("signal_bar_index", pa.int64()), ("sign", pa.int32()), ("quantity", pa.float64()), ("stop_price", pa.float64()), ("target_price", pa.float64()),
    ("entry_index", pa.int64()), ("entry_time", pa.timestamp("us", "UTC")), ("entry_price", pa.float64()), ("exit_index", pa.int64()), ("exit_time", pa.timestamp("us", "UTC")),
    ("exit_price", pa.float64()), ("exit_reason", pa.string()), ("mfe", pa.float64()), ("mae", pa.float64()), ("pnl", pa.float64()), ("cash", pa.float64()),
    ("order_no", pa.int32()), ("exit_no", pa.int32()), ("signal_time", pa.timestamp("us", "UTC")), ("trigger_price", pa.float64()), ("status", pa.string()), ("rejection", pa.string()),
]


class BrokerFold:
    """Orders and trades of one series: a row per order, filled (with its trade) or cancelled."""

    def __init__(self, x: ExecutionConfig, market: MarketConfig, record_rejected: bool = False) -> None:
        self.x, self.m, self.record_rejected = x, market, record_rejected
        self.slip = x.slippage_ticks * market.tick_size
        self.cash, self.orders, self.trades = x.initial_cash, 0, 0
        self.waiting: dict | None = None
        self.position: Position | None = None
        self.last: tuple | None = None
        self.keys: tuple | None = None

    def _row(self, **values) -> dict:
        return {"symbol": self.keys[0], "timeframe": self.keys[1], **{n: None for n, _ in TRADE}, **values}

    def _close(self, i: int, ts, price: float, reason: str) -> dict:
        p, w = self.position, self.position.order
        self.position = None
        self.orders += 1
        pnl = p.sign * (price - p.entry) * p.quantity * self.m.point_value - self.x.commission
        self.cash += pnl
        return self._row(
            trade_no=self.trades, order_no=w["number"], exit_no=self.orders, signal_time=w["time"], trigger_price=w["entry"], status="FILLED", signal_bar_index=w["signal"], sign=p.sign, quantity=p.quantity, stop_price=p.stop, target_price=p.target,
            entry_index=p.entry_index, entry_time=p.entry_time, entry_price=p.entry, exit_index=i, exit_time=ts, exit_price=price, exit_reason=reason, mfe=p.mfe, mae=p.mae, pnl=pnl, cash=self.cash,
        )

    def _cancel(self, why: str) -> dict:
        w, self.waiting = self.waiting, None
        return self._order(w, "CANCELLED", why)

    def _order(self, w: dict, status: str, why: str) -> dict:
        return self._row(order_no=w["number"], signal_time=w["time"], trigger_price=w["entry"], status=status, rejection=why, signal_bar_index=w["signal"], sign=w["sign"], quantity=w["quantity"])

    def _table(self, rows: list[dict]) -> pa.Table | None:
        return pa.Table.from_pylist(rows, schema=pa.schema([("symbol", pa.string()), ("timeframe", pa.string()), *TRADE])) if rows else None

    def _excursion(self, high: float, low: float) -> None:
        p = self.position
        up, down = (high - p.entry, p.entry - low) if p.sign > 0 else (p.entry - low, high - p.entry)
        p.mfe, p.mae = max(p.mfe, up, 0.0), max(p.mae, down, 0.0)

    def feed(self, t: pa.Table) -> pa.Table | None:
        get = lambda c: t.column(c).to_pylist()
        idx, ts, o, h, lo, c = (get(n) for n in ("bar_index", "timestamp", "open", "high", "low", "close"))
        sign, entry, stop, target = (get(n) for n in ("_sign", "_entry", "_stop", "_target"))
        self.keys = (t.column("symbol")[0].as_py(), t.column("timeframe")[0].as_py())
        marked = [k for k, s in enumerate(sign) if s is not None]
        out, k, nxt, n = [], 0, 0, len(idx)
        while k < n:
            if self.waiting is None and self.position is None:
                while nxt < len(marked) and marked[nxt] < k:
                    nxt += 1
                if nxt == len(marked):
                    break
                k = marked[nxt]
            entered = False
            w = self.waiting
            if w is not None:
                hit = h[k] >= w["entry"] if w["sign"] > 0 else lo[k] <= w["entry"]
                if hit and idx[k] <= w["expires"]:
                    self.trades += 1
                    self.position = Position(w, w["sign"], w["quantity"], w["stop"], w["target"], idx[k], ts[k], entry_fill(w["sign"], o[k], w["entry"], self.slip))
                    self.waiting, entered = None, True
                elif idx[k] >= w["expires"]:
                    out.append(self._cancel("PENDING_ORDER_EXPIRED"))
            if self.position is not None:
                self._excursion(h[k], lo[k])
                done = exit_fill(self.position.sign, o[k], h[k], lo[k], self.position, entered, self.x.policy, self.slip)
                if done:
                    out.append(self._close(idx[k], ts[k], done[1], done[0]))
            free = self.waiting is None and self.position is None
            if sign[k] is not None and (free or self.record_rejected):
                risk = abs(entry[k] - stop[k]) * self.m.point_value
                size = float(max(0, floor(self.cash * self.x.risk_per_trade / risk))) if risk > 0 else 0.0
                if size > 0:
                    self.orders += 1
                    order = {"number": self.orders, "signal": idx[k], "time": ts[k], "sign": sign[k], "quantity": size, "entry": entry[k], "stop": stop[k], "target": target[k], "expires": idx[k] + self.x.expiry_bars}
                    if free:
                        self.waiting = order
                    else:
                        out.append(self._order(order, "REJECTED", "existing_position_or_pending_entry"))
            k += 1
        self.last = (idx[-1], ts[-1], h[-1], lo[-1], c[-1])
        return self._table(out)

    def close(self) -> pa.Table | None:
        out = []
        if self.last is None or not self.x.close_at_end:
            return None
        if self.waiting is not None:
            out.append(self._cancel("END_OF_DATA"))
        if self.position is not None:
            self._excursion(self.last[2], self.last[3])
            out.append(self._close(self.last[0], self.last[1], self.last[4] - self.position.sign * self.slip, "END_OF_DATA"))
        return self._table(out)


def require_match(rows: DataFrame, accepted: DataFrame, cfg: Pipeline) -> None:
    """Signals must be of the pipeline's version and of bars that exist; others are an error that names up to ten."""
    at = [*SERIES, "bar_index"]
    foreign = accepted.where(~F.col("strategy_version").eqNullSafe(F.lit(cfg.strategy_version))).select(*at)
    lost = accepted.join(rows.select(*at, "timestamp"), [*at, "timestamp"], "left_anti").select(*at)
    first = foreign.unionByName(lost).limit(10).collect()
    if first:
        raise ValueError(f"signals of another version or without their bar: {[tuple(r) for r in first]}")


def simulate(rows: DataFrame, accepted: DataFrame, cfg: Pipeline = Pipeline(), record_rejected: bool = False) -> DataFrame:
    """One row per entry order of every series: cancelled, or filled with its closed trade.

    Signals that come while an order waits or a position is open submit nothing; with
    ``record_rejected`` they come out as REJECTED orders.
    """
    sig = accepted.select(*SERIES, "bar_index", F.when(F.col("direction") == "LONG", 1).otherwise(-1).alias("_sign"), F.col("entry").alias("_entry"), F.col("stop").alias("_stop"), F.col("target").alias("_target"))
    bars = rows.select(*SERIES, "bar_index", "timestamp", "open", "high", "low", "close").join(sig, [*SERIES, "bar_index"], "left")
    kinds = {pa.int32(): "int", pa.int64(): "bigint", pa.float64(): "double", pa.string(): "string"}
    schema = "symbol string, timeframe string, " + ", ".join(f"{n} {kinds.get(k, 'timestamp')}" for n, k in TRADE)
    return ordered_stream(bars, SERIES, ["bar_index"], BrokerFold, (cfg.execution, cfg.market, record_rejected), schema)


def trade_log(simulated: DataFrame, accepted: DataFrame, cfg: Pipeline = Pipeline()) -> DataFrame:
    """Closed trades with the facts of their signal; ids count within a series."""
    t = simulated.where("status = 'FILLED'")
    points = F.abs(F.col("entry_price") - F.col("stop_price"))
    risk = points * F.col("quantity") * cfg.market.point_value
    facts = accepted.select(
        *SERIES, F.col("bar_index").alias("signal_bar_index"), "pattern_type", "direction", F.col("regime").alias("market_regime"), "pattern_score", "context_score",
        F.col("body_ratio").alias("signal_body_ratio"), F.col("close_location").alias("signal_close_location"), "ema_slope_ratio", "volatility_range_ratio",
        F.concat(F.col("pattern_type"), F.lit("_WITH_TREND")).alias("setup"), F.array_join("reasons", "; ").alias("entry_reason"), "strategy_version",
        F.to_json(F.struct("always_in", "bar_index", "regime", "trend_score")).alias("market_state"),
        F.to_json(F.struct("attempt_number", F.col("bar_index").alias("pattern_signal_index"), F.col("start_index").alias("pattern_start_index"), "pattern_type", "pullback_bars", "state_before")).alias("pattern_metadata"),
    )
    return t.join(facts, [*SERIES, "signal_bar_index"]).select(
        F.concat(F.lit("trade-"), F.lpad(F.col("trade_no").cast("string"), 6, "0")).alias("trade_id"), *SERIES, "setup", "pattern_type", "direction", "market_regime",
        "pattern_score", "context_score", "signal_body_ratio", "signal_close_location", "ema_slope_ratio", "volatility_range_ratio", "entry_time", "entry_price", "quantity",
        F.lit(cfg.market.point_value).alias("point_value"), F.lit(cfg.execution.slippage_ticks).alias("slippage_ticks"), "stop_price", "target_price", "exit_time", "exit_price",
        risk.alias("initial_risk"), (F.col("pnl") + cfg.execution.commission).alias("gross_pnl"), "pnl", F.lit(cfg.execution.commission).alias("commission"),
        F.coalesce(F.try_divide(F.col("pnl"), risk), F.lit(0.0)).alias("pnl_r"), "mfe", "mae", F.try_divide("mfe", points).alias("mfe_r"), F.try_divide("mae", points).alias("mae_r"),
        (F.col("exit_index") - F.col("entry_index") + 1).cast("int").alias("bars_held"), "signal_bar_index", "market_state", "pattern_metadata", "entry_reason", "exit_reason", "strategy_version",
    )


def equity_curve(trades: DataFrame, cfg: Pipeline = Pipeline()) -> DataFrame:
    """Realised result and cash after each trade, per series."""
    w = W.partitionBy(*SERIES).orderBy("exit_time", "trade_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return trades.select(*SERIES, "trade_id", "exit_time", "pnl", (F.lit(cfg.execution.initial_cash) + F.sum("pnl").over(w)).alias("cash"))


def order_history(simulated: DataFrame) -> DataFrame:
    """Every state of every order: series, order_id, seq, at, direction, order_type, quantity, price, status, filled_at, filled_price, rejection.

    An entry is a STOP order that is PENDING and then FILLED, CANCELLED or, at once,
    REJECTED; an exit is FILLED when it appears, as STOP at the stop, LIMIT at the
    target, or MARKET at the end of the data.
    """
    number = lambda n: F.concat(F.lit("order-"), F.lpad(n.cast("string"), 6, "0"))
    none = lambda kind: F.lit(None).cast(kind)

    def state(no: str, seq: int, at: str, kind: Column, price: Column, status: Column, filled: bool, fill: str = "entry_price", when: str = "entry_time") -> Column:
        done = F.lit(filled) & (status == "FILLED")
        return F.struct(
            number(F.col(no)).alias("order_id"), F.lit(seq).alias("seq"), F.col(at).alias("at"), kind.alias("order_type"), price.alias("price"), status.alias("status"),
            F.when(done, F.col(when)).alias("filled_at"), F.when(done, F.col(fill)).alias("filled_price"), F.when(F.lit(seq > 1), F.col("rejection")).otherwise(none("string")).alias("rejection"),
        )

    stop, ended = F.lit("STOP"), F.col("status") == "FILLED"
    kind = F.when(F.col("exit_reason") == "STOP_LOSS", "STOP").when(F.col("exit_reason") == "TARGET", "LIMIT").otherwise("MARKET")
    level = F.when(kind == "STOP", F.col("stop_price")).when(kind == "LIMIT", F.col("target_price"))
    states = F.array_compact(F.array(
        F.when(F.col("status") != "REJECTED", state("order_no", 1, "signal_time", stop, F.col("trigger_price"), F.lit("PENDING"), False)),
        state("order_no", 2, "signal_time", stop, F.col("trigger_price"), F.col("status"), True),
        F.when(ended, state("exit_no", 2, "exit_time", kind, level, F.col("status"), True, "exit_price", "exit_time")),
    ))
    each = simulated.select(*SERIES, F.when(F.col("sign") > 0, "LONG").otherwise("SHORT").alias("direction"), "quantity", F.explode(states).alias("s"))
    return each.select(*SERIES, "direction", "quantity", "s.*")


def order_states(history: DataFrame) -> DataFrame:
    """The last state of each order."""
    kept = [c for c in history.columns if c not in (*SERIES, "order_id", "seq")]
    return history.groupBy(*SERIES, "order_id").agg(F.max_by(F.struct(*kept), "seq").alias("s")).select(*SERIES, "order_id", "s.*")
