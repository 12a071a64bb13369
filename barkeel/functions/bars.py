"""Column expressions of one bar: no neighbour is needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barkeel.config import BarConfig


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def safe_ratio(n: Column, d: Column, empty: float) -> Column:
    """n/d within [0, 1]; ``empty`` where d is 0."""
    return clip(F.coalesce(F.try_divide(n, d), F.lit(empty)), 0.0, 1.0)


def bar_columns(cfg: BarConfig) -> dict[str, Column]:
    """Shape columns by name, each from open, high, low and close."""
    o, h, lo, c = (F.col(n) for n in ("open", "high", "low", "close"))
    rng, body = h - lo, F.abs(c - o)
    upper, lower = h - F.greatest(o, c), F.least(o, c) - lo
    ratio, place = safe_ratio(body, rng, 0.0), safe_ratio(c - lo, rng, 0.5)
    valid = (rng > 0) & (rng >= cfg.minimum_range)
    bull, bear = c > o, c < o
    strong = cfg.strong_close_threshold
    return {
        "range": rng, "body": body, "body_ratio": ratio, "upper_tail": upper, "lower_tail": lower,
        "upper_tail_ratio": safe_ratio(upper, rng, 0.0), "lower_tail_ratio": safe_ratio(lower, rng, 0.0),
        "close_location": place, "bull_bar": bull, "bear_bar": bear,
        "doji": ~valid | (ratio <= cfg.doji_body_ratio),
        "trend_bar": valid & (ratio >= cfg.strong_body_ratio) & ((bull & (place >= strong)) | (bear & (place <= 1 - strong))),
    }


def to_tick(price: Column, tick: float, up: bool) -> Column:
    """Price moved up or down to the tick grid, in exact decimal arithmetic."""
    step = F.lit(str(tick)).cast("decimal(18,9)")
    ticks = price.cast("decimal(28,9)") / step
    whole = (F.ceil(ticks) if up else F.floor(ticks)).cast("decimal(28,0)")
    return (whole * step).cast("double")


def slug(text: Column, length: int = 100) -> Column:
    """Lower case, runs of other characters as one dash, trimmed."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, length)


def label(*dimensions: Column) -> Column:
    """The dimensions that are not null, joined by ' / '."""
    return F.concat_ws(" / ", *dimensions)


def expected_value(probability: Column, reward: Column, risk: Column, cost: Column) -> tuple[Column, Column]:
    """Expected value and the same in units of risk; null if the probability is."""
    ev = probability * reward - (F.lit(1.0) - probability) * risk - cost
    return ev, F.try_divide(ev, risk)


def risk_reward(entry: Column, stop: Column, target: Column) -> tuple[Column, Column, Column]:
    """Risk, reward and their ratio; null without a target."""
    risk, reward = F.abs(entry - stop), F.abs(target - entry)
    return risk, reward, F.try_divide(reward, risk)


def json_or_raw(text: Column) -> Column:
    """A JSON object as it is; other text as {"raw": text}."""
    parsed = F.try_parse_json(text)
    return F.when(parsed.isNotNull() & F.ltrim(text).startswith("{"), text).otherwise(F.to_json(F.struct(text.alias("raw"))))
