"""Exact percentiles per group by a full distributed sort (problem 5).

Values are first reduced to *runs* (group, measure, value, count): ties, however
many, collapse on the map side, so no value is hot.  Runs are range-partitioned
and sorted by (group, measure, value), which cuts a hot group at value borders,
and written once with the number of their partition.  Counts per partition give
each group's offsets, target positions are looked up in the offsets, and only
the partitions that hold a target are numbered row by row and interpolated.  The
error is zero.

Runs are also the form that combines: runs of two days or files are added by
``merge_runs`` and give the percentiles of both.  ``rank_summary`` is the bounded
form: about ``size`` buckets a group, mergeable by union, with a stated bound on
the rank error.

Defined results: null and NaN values are not counted, -0.0 equals 0.0, infinities
are values; a null group key is a group; groups without values do not appear; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barkeel.session import durable


def _join(a: DataFrame, b: DataFrame, keys: Sequence[str], also: Column | None = None) -> DataFrame:
    """Inner join on equal keys, nulls included; the left side's keys and all other columns."""
    right = b.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in b.columns))
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + ([] if also is None else [also])
    return a.join(right, reduce(lambda x, y: x & y, on)).drop(*(f"_r_{k}" for k in keys))


def latest_rows(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """``columns`` of the row with the largest ``order`` per key; rows with a null key all stay."""
    newest = F.max(F.struct(order, *columns)).alias("r")
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(newest).select("r.*")
    return kept.select(*columns).unionByName(df.where(F.col(key).isNull()).select(*columns))


def value_runs(df: DataFrame, groups: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Runs (groups, measure, value, n) of all usable values."""
    pairs = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures))
    long = df.select(*groups, F.explode(pairs).alias("p")).select(*groups, "p.measure", "p.value")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("value", F.col("value") + F.lit(0.0))
    return long.groupBy(*groups, "measure", "value").agg(F.count(F.lit(1)).alias("n"))


def merge_runs(parts: Sequence[DataFrame], groups: Sequence[str]) -> DataFrame:
    """The runs of all parts together."""
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.groupBy(*groups, "measure", "value").agg(F.sum("n").alias("n"))


def percentiles_of_runs(runs: DataFrame, groups: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Interpolated percentiles: groups, measure, p, n_values, percentile, rank_error (0)."""
    keys = [*groups, "measure"]
    ordered = runs.repartitionByRange(*keys, "value").sortWithinPartitions(*keys, "value")
    kept = durable(ordered.withColumn("part", F.spark_partition_id()))

    counts = kept.groupBy(*keys, "part").agg(F.sum("n").alias("size"))
    by_part = W.partitionBy(*keys).orderBy("part")
    offsets = counts.select(
        *keys, "part", "size",
        (F.sum("size").over(by_part.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")).alias("before"),
        F.sum("size").over(W.partitionBy(*keys)).alias("n_values"),
    )
    at = F.col("p") * (F.col("n_values") - 1)
    targets = offsets.select("*", F.explode(F.array(*(F.lit(float(p)) for p in probs))).alias("p"))
    targets = targets.select("*", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("position"))
    wanted = targets.where((F.col("position") >= F.col("before")) & (F.col("position") < F.col("before") + F.col("size")))

    parts = wanted.select(*keys, "part", "before").distinct()
    inside = _join(kept, parts, [*keys, "part"])
    upto = F.sum("n").over(W.partitionBy(*keys, "part").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow))
    numbered = inside.select(*keys, "part", "value", (F.col("before") + upto).alias("upto"), (F.col("before") + upto - F.col("n")).alias("from"))
    hit = (F.col("position") >= F.col("from")) & (F.col("position") < F.col("upto"))
    found = _join(wanted.select(*keys, "part", "p", "n_values", "position"), numbered, [*keys, "part"], hit)
    share = F.first("p") * (F.first("n_values") - 1) - F.min("position")
    low, high = F.min_by("value", "position"), F.max_by("value", "position")
    value = F.when(low == high, low).otherwise(low + share * (high - low))
    return found.groupBy(*keys, "p", "n_values").agg(value.alias("percentile")).withColumn("rank_error", F.lit(0).cast("bigint"))


def rank_summary(runs: DataFrame, groups: Sequence[str], size: int = 200) -> DataFrame:
    """Buckets (groups, measure, lo, hi, n) of at most about n/size values, or one run.

    The summary of a union is the union of the summaries.  Buckets are formed inside
    the partitions of the sorted runs, so no group is gathered in one task.
    """
    keys = [*groups, "measure"]
    total = runs.groupBy(*keys).agg(F.sum("n").alias("_all"))
    sized = _join(runs, total, keys)
    kept = durable(sized.repartitionByRange(*keys, "value").withColumn("part", F.spark_partition_id()))
    upto = F.sum("n").over(W.partitionBy(*keys, "part").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow))
    step = F.greatest(F.floor(F.col("_all") / size), F.lit(1))
    bucket = F.floor((upto - 1) / step)
    return kept.select(*keys, "part", "value", "n", bucket.alias("_b")).groupBy(*keys, "part", "_b").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("n")).drop("part", "_b")


def compact_summary(summary: DataFrame, groups: Sequence[str], size: int = 200) -> DataFrame:
    """The same with about ``size`` buckets a group again, for summaries that were merged day by day.

    Neighbours by their low end are joined until they hold n/size values, so bounds
    stay true and widen by one such bucket at most for each time of compacting.
    """
    keys = [*groups, "measure"]
    w = W.partitionBy(*keys)
    upto = F.sum("n").over(w.orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, W.currentRow))
    step = F.greatest(F.floor(F.sum("n").over(w) / size), F.lit(1))
    numbered = summary.select(*keys, "lo", "hi", "n", F.floor((upto - 1) / step).alias("_b"))
    return numbered.groupBy(*keys, "_b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).drop("_b")


def percentiles_of_summaries(summary: DataFrame, groups: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Percentiles of merged summaries: groups, measure, p, n_values, lower, upper.

    The value at the nearest rank lies in [lower, upper]: that many buckets end
    below, or begin above, the wanted rank.  A group's buckets are few, some
    ``size`` for each part that was merged.
    """
    keys = [*groups, "measure"]
    whole = W.partitionBy(*keys)
    upper_rank = F.sum("n").over(whole.orderBy("hi").rangeBetween(W.unboundedPreceding, W.currentRow))
    begun = F.sum("n").over(whole.orderBy("lo").rangeBetween(W.unboundedPreceding, W.currentRow))
    ranked = summary.select(*keys, "lo", "hi", upper_rank.alias("_u"), begun.alias("_l"), F.sum("n").over(whole).alias("n_values"))
    each = ranked.select("*", F.explode(F.array(*(F.lit(float(p)) for p in probs))).alias("p"))
    rank = F.greatest(F.ceil(F.col("p") * F.col("n_values")), F.lit(1))
    return each.groupBy(*keys, "p", "n_values").agg(
        F.min(F.when(F.col("_l") >= rank, F.col("lo"))).alias("lower"), F.min(F.when(F.col("_u") >= rank, F.col("hi"))).alias("upper")
    )
