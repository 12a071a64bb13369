"""Irregular readings onto the regular grid of planned sessions (problem 4).

Each planned session of a series is one shard.  Readings find their shard by an
equi-join on the UTC days that a session touches and are reduced to one a slot by
a partial aggregate, before anything is gathered.  A shard's summary is its first
and its last reading.  The carry states (last reading before a shard, first one
after it) run over the summaries alone, by a prefix scan per series in either
direction; after that every shard fills its own slots, none looks at another: its
readings and the carried one become runs of slots that share a carried reading,
and the runs are unfolded.  Work is in proportion to readings plus slots.

Defined results: rows with null series, timestamp or close are no readings; of
several readings in a slot the latest timestamp holds, then the later
received_at, then the larger bar_id; a session whose close is not after its open
has no slots; slots before a series' first reading stay missing; a timeframe
that cannot be read makes the session one slot; repeated plan rows count once;
an empty plan gives an empty grid, and plan rows without readings a missing one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barkeel.operators.spikes import slot_seconds

SHARD = ["symbol", "timeframe", "open_ts", "close_ts"]


def _sessions(plan: DataFrame) -> DataFrame:
    """Distinct sessions with slot length and slot count (in microseconds from the open)."""
    usable = F.col("symbol").isNotNull() & F.col("timeframe").isNotNull() & (F.col("close_ts") > F.col("open_ts"))
    span = F.unix_micros("close_ts") - F.unix_micros("open_ts")
    slot = slot_seconds(F.col("timeframe")) * 1_000_000
    slot = F.when(slot.isNull() | (slot >= 86_400_000_000), span).otherwise(slot)
    s = plan.where(usable).select(*SHARD, "session_date").groupBy(*SHARD).agg(F.min("session_date").alias("session_date"))
    return s.withColumn("slot_us", slot.cast("bigint")).withColumn("slots", F.ceil(span / F.col("slot_us")).cast("int"))


def shard_summaries(bars: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per session: slots, and sorted (slot, ts, close) of the occupied ones."""
    sessions = _sessions(plan)
    days = F.sequence(F.to_date("open_ts"), F.to_date(F.col("close_ts") - F.expr("interval 1 microsecond")))
    reach = sessions.withColumn("_day", F.explode(days))
    ok = F.col("symbol").isNotNull() & F.col("timeframe").isNotNull() & F.col("timestamp").isNotNull() & F.col("close").isNotNull()
    read = bars.where(ok & ~F.isnan(F.col("close").cast("double"))).select(
        F.col("symbol").alias("_s"), F.col("timeframe").alias("_t"), F.to_date("timestamp").alias("_d"),
        F.col("timestamp").alias("_ts"), F.col("close").cast("double").alias("_close"), F.col("received_at").alias("_received"), F.col("bar_id").alias("_id"),
    )
    inside = (reach["symbol"] == read["_s"]) & (reach["timeframe"] == read["_t"]) & (reach["_day"] == read["_d"]) & (read["_ts"] >= reach["open_ts"]) & (read["_ts"] < reach["close_ts"])
    slot = F.floor((F.unix_micros("_ts") - F.unix_micros("open_ts")) / F.col("slot_us")).cast("int")
    hit = reach.join(read, inside).select(*SHARD, F.struct(slot.alias("slot"), F.col("_ts").alias("ts"), "_received", "_id", F.col("_close").alias("close")).alias("r"))
    by_slot = hit.select(*SHARD, "r.slot", F.struct("r.ts", "r._received", "r._id", "r.close").alias("r")).groupBy(*SHARD, "slot").agg(F.max("r").alias("r"))
    per_shard = by_slot.groupBy(*SHARD).agg(F.sort_array(F.collect_list(F.struct("slot", "r.ts", "r.close"))).alias("read"))  # one a slot at most
    joined = sessions.join(per_shard, SHARD, "left")
    return joined.withColumn("read", F.coalesce("read", F.array().cast(per_shard.schema["read"].dataType)))


def _carried(shards: DataFrame) -> DataFrame:
    """Boundary states: the last reading before and the first one after each shard."""
    first = F.when(F.size("read") > 0, F.element_at("read", 1))
    last = F.when(F.size("read") > 0, F.element_at("read", -1))
    ends = shards.select(*SHARD, first.alias("_first"), last.alias("_last"))
    scan = lambda *order: W.partitionBy("symbol", "timeframe").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    back = scan(F.col("open_ts").desc(), F.col("close_ts").desc())
    return ends.select(*SHARD, F.last("_last", ignorenulls=True).over(scan("open_ts", "close_ts")).alias("before"), F.last("_first", ignorenulls=True).over(back).alias("after"))


def _slot_start(slot: Column) -> Column:
    return F.timestamp_micros(F.unix_micros("open_ts") + slot.cast("bigint") * F.col("slot_us"))


def regular_grid(bars: DataFrame, plan: DataFrame, max_fill_seconds: int | None = None) -> DataFrame:
    """Every slot of every planned session once, with its close or filled or missing.

    Out: symbol, timeframe, session_date, slot, slot_ts, close, status, age_s and
    gap_s.  status is observed, filled (the last earlier reading carried on) or
    missing (no earlier reading, or one older than ``max_fill_seconds``); close is
    null if missing; age_s is the age of a carried reading at the slot's start;
    gap_s, for slots without a reading, is the time between the readings on either
    side of them, null where there is none on one side.
    """
    shards = shard_summaries(bars, plan)
    full = shards.join(_carried(shards), SHARD)
    reading = lambda r: [r["ts"].alias("ts"), r["close"].alias("close")]
    following = lambda i: F.get("read", i + 1)
    until = lambda i: F.coalesce(following(i)["slot"], F.col("slots")) - 1
    own = F.transform("read", lambda r, i: F.struct(r["slot"].alias("from"), until(i).alias("to"), F.lit(True).alias("own"), *reading(r), F.coalesce(following(i)["ts"], F.col("after")["ts"]).alias("next_ts")))
    first = F.get("read", F.lit(0))
    inherited = F.struct(F.lit(0).alias("from"), (F.coalesce(first["slot"], F.col("slots")) - 1).alias("to"), F.lit(False).alias("own"), *reading(F.col("before")), F.coalesce(first["ts"], F.col("after")["ts"]).alias("next_ts"))
    runs = F.filter(F.concat(F.array(inherited), own), lambda r: r["to"] >= r["from"])
    rows = full.select(*SHARD, "session_date", "slot_us", F.explode(runs).alias("_r")).select("*", F.explode(F.sequence("_r.from", "_r.to")).alias("slot"))
    observed = F.col("_r.own") & (F.col("slot") == F.col("_r.from"))
    rows = rows.select("symbol", "timeframe", "session_date", "slot", _slot_start(F.col("slot")).alias("slot_ts"), "_r", observed.alias("_o"))
    age = (F.unix_micros("slot_ts") - F.unix_micros("_r.ts")) / 1e6
    usable = F.col("_r.ts").isNotNull() if max_fill_seconds is None else F.col("_r.ts").isNotNull() & (age <= max_fill_seconds)
    status = F.when(F.col("_o"), "observed").when(usable, "filled").otherwise("missing")
    return rows.select(
        "symbol", "timeframe", "session_date", "slot", "slot_ts",
        F.when(status != "missing", F.col("_r.close")).alias("close"), status.alias("status"), F.when(status == "filled", age).alias("age_s"),
        F.when(~F.col("_o"), (F.unix_micros("_r.next_ts") - F.unix_micros("_r.ts")) / 1e6).alias("gap_s"),
    )
