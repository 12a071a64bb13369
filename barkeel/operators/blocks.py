"""Series in bounded blocks, so that no window ever holds a whole series.

``indexed`` numbers the bars of each series without gathering it: counts per time
span give offsets, and only a span is numbered by a window.  ``blocked`` cuts the
numbered series into blocks of equal length, each with a halo of the bars before
it; window functions partition by block, and ``core`` drops the halo again.  A
frame that fits into the halo gives the same value as over the whole series.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SERIES = ["symbol", "timeframe"]


@dataclass(frozen=True)
class Blocks:
    rows: int = 4096
    halo: int = 512
    span_seconds: int = 14 * 86400

    def __post_init__(self) -> None:
        if not 0 <= self.halo <= self.rows:
            raise ValueError("a halo comes from one block, so it cannot be longer than one")

    def for_period(self, period: int) -> Blocks:
        """Blocks in which an average of this period can be carried by powers of its decay."""
        decay = -math.log(1 - 2 / (period + 1)) if period > 1 else 40.0
        halo = max(64, math.ceil(40 / decay))
        rows = max(halo, min(self.rows, math.floor(600 / decay) - halo))
        return Blocks(rows=rows, halo=min(rows, max(halo, min(self.halo, math.floor(300 / decay)))), span_seconds=self.span_seconds)


def indexed(bars: DataFrame, blocks: Blocks = Blocks()) -> DataFrame:
    """Add bar_index, the 0-based position in the series by timestamp."""
    spanned = bars.withColumn("_span", F.floor(F.unix_seconds("timestamp") / blocks.span_seconds))
    counts = spanned.groupBy(*SERIES, "_span").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*SERIES).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*SERIES, "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*SERIES, "_span").orderBy("timestamp")
    joined = spanned.join(offsets, [*SERIES, "_span"])
    return joined.withColumn("bar_index", F.row_number().over(inside) - 1 + F.col("_offset")).drop("_span", "_offset")


def blocked(numbered: DataFrame, blocks: Blocks = Blocks()) -> DataFrame:
    """Add _blk and _core; bars near a block's end appear again as the next one's halo."""
    own = F.floor(F.col("bar_index") / blocks.rows)
    places = F.array_compact(
        F.array(
            F.struct(own.alias("b"), F.lit(True).alias("core")),
            F.when(F.col("bar_index") % blocks.rows >= blocks.rows - blocks.halo, F.struct((own + 1).alias("b"), F.lit(False).alias("core"))),
        )
    )
    return numbered.withColumn("_p", F.explode(places)).select(*numbered.columns, F.col("_p.b").alias("_blk"), F.col("_p.core").alias("_core"))


def core(df: DataFrame) -> DataFrame:
    return df.where("_core").drop("_core", "_blk")


def over_block():
    return W.partitionBy(*SERIES, "_blk").orderBy("bar_index")
