"""Queries behind the read-only pages: chart windows, markers, filters, formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barkeel.operators.blocks import SERIES


def chart_window(rows: DataFrame, bars: int) -> DataFrame:
    """The last ``bars`` bars of each series, by bar number: one small aggregate and an equi-join, no sort."""
    ends = rows.groupBy(*SERIES).agg(F.max("bar_index").alias("_end"))
    return rows.join(ends, SERIES).where(F.col("bar_index") > F.col("_end") - bars).drop("_end")


def trade_markers(trades: DataFrame, window: DataFrame) -> DataFrame:
    """Entry and exit of each trade whose time lies inside its series' window."""
    span = window.groupBy(*SERIES).agg(F.min("timestamp").alias("_a"), F.max("timestamp").alias("_b"))
    points = F.array(
        F.struct(F.lit("entry").alias("kind"), F.col("entry_time").alias("at"), F.col("entry_price").alias("price")),
        F.struct(F.lit("exit").alias("kind"), F.col("exit_time").alias("at"), F.col("exit_price").alias("price")),
    )
    each = trades.select(*SERIES, "trade_id", "direction", F.explode(points).alias("m")).select(*SERIES, "trade_id", "direction", "m.*")
    return each.join(span, SERIES).where("at between _a and _b").drop("_a", "_b")


def dimension_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column without null, in order."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def filter_statistics(stats: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows with the wanted dimension values; None or "All" means any."""
    for name, value in wanted.items():
        if value is not None and value != "All":
            stats = stats.where(F.col(name) == value)
    return stats


def format_number(x: Column, digits: int = 2) -> Column:
    """A number with separators, or a dash."""
    return F.coalesce(F.format_number(x, digits), F.lit("-"))


def format_ratio(x: Column, digits: int = 1) -> Column:
    """A share as a percentage, or a dash."""
    return F.coalesce(F.concat(F.format_number(x * 100, digits), F.lit("%")), F.lit("-"))


def format_time(x: Column, zone: str = "UTC") -> Column:
    """An instant to the minute in a zone, or a dash."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(x, zone), "yyyy-MM-dd HH:mm"), F.lit("-"))
