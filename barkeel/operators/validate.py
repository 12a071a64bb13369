"""Canonical OHLCV frames: names, timestamps, row checks, duplicates.

Defined results: a row fails the first check that it breaks; rows with null keys or
numbers fail as not_finite or null_key; duplicates of (series, timestamp) all
count as duplicates in a check, and the one received last stays in ``keep_last``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barkeel.operators.blocks import SERIES
from barkeel.operators.clock import readings
from barkeel.session import durable

NUMBERS = ["open", "high", "low", "close", "volume"]
REQUIRED = ["timestamp", *NUMBERS]


class InvalidBars(ValueError):
    """A frame that cannot be made canonical, with its first offenders."""


def canonical_names(df: DataFrame, renames: Mapping[str, str] | None = None) -> DataFrame:
    """Lower-case, trimmed names; the six required columns and any series columns."""
    named = df.withColumnsRenamed(dict(renames or {}))
    clean = [c.strip().lower() for c in named.columns]
    twice = sorted({c for c in clean if clean.count(c) > 1})
    if twice:
        raise InvalidBars(f"duplicate column names: {twice}")
    missing = [c for c in REQUIRED if c not in clean]
    if missing:
        raise InvalidBars(f"missing columns: {missing}")
    return named.toDF(*clean).select(*[c for c in SERIES if c in clean], *REQUIRED)


def parse_timestamp(df: DataFrame, unit: str | None = None) -> Column:
    """The timestamp column as an instant; numbers need a unit."""
    kind = df.schema["timestamp"].dataType.typeName()
    ts = F.col("timestamp")
    if kind in ("long", "integer", "short", "double", "float", "decimal"):
        scale = {"s": 1_000_000, "ms": 1_000, "us": 1}
        if unit == "ns":
            return F.timestamp_micros(F.expr("cast(timestamp as bigint) div 1000"))
        if unit not in scale:
            raise InvalidBars("numeric timestamps need a unit: s, ms, us or ns")
        return F.timestamp_micros((ts * scale[unit]).cast("bigint"))
    if kind == "string":
        raise InvalidBars("texts are read by typed")
    return ts.cast("timestamp")


def reject_reason() -> Column:
    """Why a row is no bar, or null; expects canonical names and typed columns."""
    o, h, lo, c, v = (F.col(n) for n in NUMBERS)
    finite = F.lit(True)
    for n in NUMBERS:
        finite = finite & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    return (
        F.when(F.col("timestamp").isNull(), "null_key").when(~finite, "not_finite").when(h < lo, "high_below_low")
        .when(h < F.greatest(o, c), "high_below_body").when(lo > F.least(o, c), "low_above_body").when(v < 0, "negative_volume")
    )


def typed(df: DataFrame, unit: str | None = None) -> DataFrame:
    """Canonical names with instants and doubles; what cannot be cast is null.

    Texts of any notation that denotes exactly one instant are read, UTC where they
    name no zone; bare numbers need a unit and a numeric column.
    """
    if df.schema["timestamp"].dataType.typeName() == "string":
        feeds = df.sparkSession.createDataFrame([], "feed string, zone_name string, date_order string")
        read = readings(df.withColumn("_text", F.when(~F.col("timestamp").rlike(r"^\s*\d+\s*$"), F.col("timestamp"))).withColumn("feed", F.lit(None).cast("string")), "_text", "feed", feeds, keep=df.columns)
        df = durable(read)  # the reading is a large expression: evaluated once, not wherever the time is used
        ts = F.when(F.size("_readings") == 1, F.timestamp_micros(F.get("_readings", F.lit(0))["utc_us"])).alias("timestamp")
    else:
        ts = parse_timestamp(df, unit).alias("timestamp")
    return df.select(*[c for c in SERIES if c in df.columns], ts, *(F.col(n).try_cast("double").alias(n) for n in NUMBERS))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that are bars, and the others with their reason."""
    judged = df.withColumn("reason", reject_reason())
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def duplicates(df: DataFrame) -> DataFrame:
    """Keys that occur more than once."""
    keys = [*[c for c in SERIES if c in df.columns], "timestamp"]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def keep_last(df: DataFrame, *order: str) -> DataFrame:
    """One row per (series, timestamp): the last one by ``order``."""
    keys = [*[c for c in SERIES if c in df.columns], "timestamp"]
    w = W.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def normalize(df: DataFrame, renames: Mapping[str, str] | None = None, unit: str | None = None) -> DataFrame:
    """Strict form: an empty frame, a bad row or a duplicate is an error that names up to ten offenders."""
    rows = durable(typed(canonical_names(df, renames), unit))  # judged several times, read once
    good, bad = split_valid(rows)
    first = bad.limit(10).collect()
    if first:
        raise InvalidBars(f"invalid rows: {[r.asDict() for r in first]}")
    if rows.isEmpty():
        raise InvalidBars("no rows")
    twice = duplicates(good).limit(10).collect()
    if twice:
        raise InvalidBars(f"duplicate timestamps: {[r.asDict() for r in twice]}")
    return good


def require_context_rows(rows: DataFrame) -> None:
    """Rows that enter the context engine need keys, finite numbers and a time that rises with the bar number; else an error that names up to ten."""
    numbers = [c for c in ("open", "high", "low", "close", "ema20", "body_ratio", "close_location", "overlap_previous") if c in rows.columns]
    broken = F.col("symbol").isNull() | F.col("timeframe").isNull() | F.col("timestamp").isNull()
    for c in numbers:
        broken = broken | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    first = rows.where(broken).select(*SERIES, "timestamp").limit(10).collect()
    if first:
        raise InvalidBars(f"rows without keys or finite numbers: {[tuple(r) for r in first]}")
    twice = duplicates(rows).limit(10).collect()
    if twice:
        raise InvalidBars(f"times that do not rise: {[r.asDict() for r in twice]}")
    if "bar_index" in rows.columns:
        span = W.partitionBy(*SERIES, F.floor(F.col("bar_index") / 4096)).orderBy("bar_index")
        late = rows.withColumn("_before", F.lag("timestamp").over(span)).where("_before >= timestamp").select(*SERIES, "bar_index").limit(10).collect()
        if late:
            raise InvalidBars(f"times that do not rise: {[tuple(r) for r in late]}")


def require_synchronised(bars: DataFrame, rows: DataFrame, version: str) -> None:
    """Each bar must have its context row of the same number, time and version, and the other way round; else an error that names up to ten."""
    at = [*SERIES, "timestamp"]
    left = bars.select(*at, F.col("bar_index").alias("_bar"))
    right = rows.select(*at, F.col("bar_index").alias("_row"), F.col("strategy_version").alias("_version"))
    wrong = left.join(right, at, "full").where(~F.col("_bar").eqNullSafe(F.col("_row")) | ~F.col("_version").eqNullSafe(F.lit(version)))
    first = wrong.limit(10).collect()
    if first:
        raise InvalidBars(f"bars and context rows do not match: {[tuple(r) for r in first]}")
