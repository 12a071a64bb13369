"""Exchange sessions: resampling inside them, expected minutes, coverage."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barkeel.operators.blocks import SERIES

ZONE = "America/New_York"


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th weekday of a month; n = -1 is the last."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)
    return last - dt.timedelta(days=(last.weekday() - weekday) % 7)


def _easter(year: int) -> dt.date:
    """Easter Sunday of the Gregorian calendar."""
    golden, century = year % 19, year // 100
    epact = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    epact -= epact // 28 * (1 - 29 // (epact + 1) * ((21 - golden) // 11))
    sunday = (year + year // 4 + epact + 2 - century + century // 4) % 7
    day = epact - sunday
    month = 3 + (day + 40) // 44
    return dt.date(year, month, day + 28 - 31 * (month // 4))


def us_holidays(year: int) -> set[dt.date]:
    """Full-day closures of the New York exchanges, by rule."""

    def seen(day: dt.date) -> dt.date:
        return day - dt.timedelta(days=1) if day.weekday() == 5 else day + dt.timedelta(days=1) if day.weekday() == 6 else day

    new_year = dt.date(year, 1, 1)
    fixed = [dt.date(year, 7, 4), dt.date(year, 12, 25)] + ([dt.date(year, 6, 19)] if year >= 2022 else [])
    days = {seen(d) for d in fixed} | {_nth(year, 1, 0, 3), _nth(year, 2, 0, 3), _easter(year) - dt.timedelta(days=2), _nth(year, 5, 0, -1), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4)}
    if new_year.weekday() != 5:  # on a Saturday it is not moved into the old year
        days.add(seen(new_year))
    return days


# Closures that follow no rule.
EXTRA_CLOSURES = {dt.date(2018, 12, 5), dt.date(2025, 1, 9)}


def early_closes(year: int) -> set[dt.date]:
    """Days that end at 13:00: before Independence Day, after Thanksgiving, Christmas Eve."""
    days = {_nth(year, 11, 3, 4) + dt.timedelta(days=1)}
    days |= {d for d in (dt.date(year, 7, 3), dt.date(year, 12, 24)) if d.weekday() < 5}
    return days - us_holidays(year)


def us_sessions(start: dt.date, end: dt.date) -> Iterator[tuple[dt.date, int, int]]:
    """Session dates with opening and closing minute of the local day."""
    day = start
    while day <= end:
        if day.weekday() < 5 and day not in us_holidays(day.year) and day not in EXTRA_CLOSURES:
            yield day, 570, 780 if day in early_closes(day.year) else 960
        day += dt.timedelta(days=1)


def session_table(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """session_date, open_ts, close_ts (instants); one row per session, some 250 a year."""
    rows = spark.createDataFrame(list(us_sessions(start, end)), "session_date date, open_min int, close_min int")
    at = lambda m: F.to_utc_timestamp(F.timestamp_seconds(F.unix_date("session_date") * 86400 + F.col(m) * 60), ZONE)
    return rows.select("session_date", at("open_min").alias("open_ts"), at("close_min").alias("close_ts"))


def expected_minutes(sessions: DataFrame) -> DataFrame:
    """Every minute of every session: session_date, timestamp."""
    last = F.col("close_ts") - F.expr("interval 1 minute")
    return sessions.select("session_date", F.explode(F.sequence("open_ts", last, F.expr("interval 1 minute"))).alias("timestamp"))


def _differences(want: DataFrame, have: DataFrame) -> DataFrame:
    missing = want.join(have, [*SERIES, "timestamp"], "left_anti").select(*SERIES, "timestamp", F.lit("missing").alias("kind"))
    extra = have.join(want.select(*SERIES, "timestamp"), [*SERIES, "timestamp"], "left_anti").select(*SERIES, "timestamp", F.lit("extra").alias("kind"))
    return missing.unionByName(extra)


def minute_differences(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Minutes that lack a bar (missing) and bars outside the sessions (extra), per series."""
    series = bars.select(*SERIES).distinct()
    return _differences(expected_per_series(series, sessions), bars.select(*SERIES, "timestamp").distinct())


def planned_differences(bars: DataFrame, plan: DataFrame) -> DataFrame:
    """The same against the planned sessions of each series; a bar counts for the minute that holds it, and a planned series without bars lacks all."""
    last = F.col("close_ts") - F.expr("interval 1 minute")
    spans = plan.where(F.col("open_ts") <= last)
    want = spans.select(*SERIES, F.explode(F.sequence("open_ts", last, F.expr("interval 1 minute"))).alias("timestamp")).distinct()
    return _differences(want, bars.select(*SERIES, F.date_trunc("minute", "timestamp").alias("timestamp")).distinct())


def expected_per_series(series: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each series with every expected minute: series take the calendar's dates and meet its sessions by date."""
    first, last_day = sessions.agg(F.min("session_date"), F.max("session_date")).first()
    if first is None:
        return series.select(*SERIES, F.lit(None).cast("date").alias("session_date"), F.lit(None).cast("timestamp").alias("timestamp")).where("false")
    days = series.select(*SERIES, F.explode(F.sequence(F.lit(first), F.lit(last_day), F.expr("interval 1 day"))).alias("session_date"))
    last = F.col("close_ts") - F.expr("interval 1 minute")
    return days.join(sessions, "session_date").select(*SERIES, "session_date", F.explode(F.sequence("open_ts", last, F.expr("interval 1 minute"))).alias("timestamp"))


def missing_session_dates(differences: DataFrame) -> DataFrame:
    """Local session dates with a missing minute, in order."""
    return differences.where("kind = 'missing'").select(*SERIES, F.to_date(F.from_utc_timestamp("timestamp", ZONE)).alias("session_date")).distinct()


def resample(bars: DataFrame, minutes: int, zone: str = ZONE) -> DataFrame:
    """Bars of ``minutes`` counted from the first bar of each local session date; empty bins do not appear.

    Two aggregations on (series, session[, bin]); the first one is tiny, and partial
    aggregation runs before either shuffle.
    """
    return _binned(bars, F.array(F.lit(minutes)), zone).drop("source_timeframe")


def resample_each(bars: DataFrame, targets: Sequence[int] = (5, 15, 30, 60), zone: str = ZONE) -> DataFrame:
    """Every series of minute bars (1m, 5m, ...) to each target that its own length divides, with source_timeframe."""
    source = F.regexp_extract("timeframe", r"^(\d+)m$", 1).try_cast("int")
    fine = bars.withColumn("_source", source).where("_source > 0")
    return _binned(fine, F.filter(F.array(*map(F.lit, targets)), lambda n: (n > F.col("_source")) & (n % F.col("_source") == 0)), zone)


def _binned(bars: DataFrame, minutes: Column, zone: str) -> DataFrame:
    day = F.to_date(F.from_utc_timestamp("timestamp", zone))
    rows = bars.withColumn("session_date", day)
    origins = rows.groupBy(*SERIES, "session_date").agg(F.min("timestamp").alias("_origin"))
    joined = rows.join(origins, [*SERIES, "session_date"]).withColumn("_minutes", F.explode(minutes))
    width = F.col("_minutes").cast("bigint") * 60_000_000
    number = F.floor((F.unix_micros("timestamp") - F.unix_micros("_origin")) / width).cast("bigint")
    at = F.timestamp_micros(F.unix_micros("_origin") + F.col("_bin") * width)
    first = lambda c: F.min_by(c, F.struct("timestamp", c))
    final = lambda c: F.max_by(c, F.struct("timestamp", c))
    binned = joined.withColumn("_bin", number).groupBy(*SERIES, "session_date", "_minutes", "_bin", "_origin").agg(
        first("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), final("close").alias("close"), F.sum("volume").alias("volume")
    )
    label = F.concat(F.col("_minutes").cast("string"), F.lit("m"))
    return binned.select("symbol", F.col("timeframe").alias("source_timeframe"), label.alias("timeframe"), at.alias("timestamp"), "open", "high", "low", "close", "volume", "session_date")


def tick_bars(ticks: DataFrame, symbol: str, ts: str, price: str, tie: str, every: str, timeframe: str) -> DataFrame:
    """OHLCV bars of single prints: price extremes, first and last by (ts, tie), volume the count."""
    t = ticks.select(F.col(symbol).alias("symbol"), F.date_trunc(every, F.col(ts)).alias("timestamp"), F.struct(ts, tie, F.col(price).cast("double").alias("p")).alias("k"))
    return t.groupBy("symbol", "timestamp").agg(
        F.min("k")["p"].alias("open"), F.max("k.p").alias("high"), F.min("k.p").alias("low"), F.max("k")["p"].alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    ).withColumn("timeframe", F.lit(timeframe))
