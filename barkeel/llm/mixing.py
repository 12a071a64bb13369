"""Mixing sources to target shares of all tokens (problem 9).

Tokens per record are counted once and written with a hash of the record id.  The
largest mix in which every source keeps its share and no record is used more
than its source allows follows from the source totals.  A source then gives
whole copies of all its records plus those records whose hash lies below a
threshold; the threshold comes from nested histograms: tokens by source and hash
bucket, the bucket in which the budget ends, and then only that bucket again in
finer buckets, until hashes are told apart.  Nothing is sorted, and the records
are filtered by one comparison.

Defined results: null text has no tokens; records of a source that is null or has
no target are used 0 times and reported with a target of 0; sources with a target
but without tokens cannot contribute, and the others' shares are scaled up to
sum to 1; a null max_repeats means 1; records with one id (repeated rows) go
together; empty tables give empty results.  A source's tokens miss their budget by
half of the tokens of one hash at most, usually by half a record.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barkeel.session import durable


@dataclass(frozen=True)
class MixRule:
    """Tokenizer file (None: the public 50k byte-level BPE), hash bits per level, levels, wanted tokens.

    Without ``tokens`` the mix is the largest one in which all sources keep their
    shares.  With it, each source gets its share of that many tokens, and a source
    that is too small for its share gives all it may and falls short of it.
    """

    vocabulary: str | None = None
    bits: int = 12
    levels: int = 5
    tokens: int | None = None


_ENCODERS: dict[str | None, object] = {}


def encoder(vocabulary: str | None):
    """The tokenizer of a rank file; made once per process."""
    if vocabulary not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def count_tokens(df: DataFrame, record: str = "doc_id", source: str = "source", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """record_id, source, n_tokens."""
    kind = df.schema[record].dataType.simpleString()
    rows = df.select(F.col(record).alias("record_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("record_id"), b.column("source"), pa.array(sizes, pa.int64())], names=["record_id", "source", "n_tokens"])

    return rows.mapInArrow(work, f"record_id {kind}, source string, n_tokens bigint")


def budgets(counted: DataFrame, targets: DataFrame, rule: MixRule = MixRule()) -> DataFrame:
    """Per source with tokens and a target: share, budget, copies of all, rest below a threshold."""
    totals = counted.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("total"))
    wish = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy("source").agg(
        F.max("target_share").alias("share"), F.max(F.coalesce(F.col("max_repeats"), F.lit(1))).cast("bigint").alias("cap")
    )
    both = totals.where("total > 0").join(wish.where("cap > 0"), "source")
    all_ = W.partitionBy(F.lit(0))
    both = both.withColumn("share", F.col("share") / F.sum("share").over(all_))
    largest = F.min(F.col("cap") * F.col("total") / F.col("share")).over(all_)
    both = both.withColumn("mix", largest if rule.tokens is None else F.lit(float(rule.tokens)))
    budget = F.least(F.col("share") * F.col("mix"), (F.col("cap") * F.col("total")).cast("double"))
    both = both.withColumn("budget", F.floor(budget + 1e-6).cast("bigint"))
    return both.withColumn("copies", F.expr("budget div total")).withColumn("rest", F.expr("budget % total"))


def _bucket(level: int, rule: MixRule) -> Column:
    """The record's bucket number at a level: the hash's leading bits."""
    return F.shiftright("hash", rule.bits * (rule.levels - level - 1))


def thresholds(counted: DataFrame, wanted: DataFrame, rule: MixRule) -> DataFrame:
    """Per source the hash below which its tokens sum to the rest, or to the nearer one of the two sums beside it."""
    level = wanted.select("source", "rest", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("spent"))
    for k in range(rule.levels):
        mine = counted.withColumnRenamed("source", "_source")
        parent = F.lit(0).cast("bigint") if k == 0 else _bucket(k - 1, rule)
        inside = mine.join(level, (mine["_source"] == level["source"]) & (parent == level["prefix"]))
        sums = inside.groupBy("source", "rest", "spent", _bucket(k, rule).alias("bucket")).agg(F.sum("n_tokens").alias("tokens"))
        run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
        upto = sums.withColumn("upto", F.col("spent") + F.sum("tokens").over(run))
        over = upto.where(F.col("upto") > F.col("rest"))
        if k == rule.levels - 1:  # the records of the last hash are taken whole or not at all
            nearer = (F.col("rest") > 0) & (F.col("upto") - F.col("rest") < F.col("rest") - (F.col("upto") - F.col("tokens")))
            over = over.withColumn("bucket", F.col("bucket") + F.when(nearer, 1).otherwise(0)).withColumn("tokens", F.when(nearer, 0).otherwise(F.col("tokens")))
        level = over.groupBy("source", "rest").agg(F.min_by(F.struct(F.col("bucket").alias("prefix"), (F.col("upto") - F.col("tokens")).alias("spent")), "bucket").alias("b")).select("source", "rest", "b.prefix", "b.spent")
    return level.select("source", F.col("prefix").alias("threshold"), F.col("spent").alias("expected"))


def mix_sources(docs: DataFrame, targets: DataFrame, rule: MixRule = MixRule()) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    mix: record_id, source, n_tokens, copies; one row per record of ``docs``.
    report: source, target_share, share, tokens, records, most_copies.
    """
    top = rule.bits * rule.levels
    hashed = count_tokens(docs, vocabulary=rule.vocabulary).withColumn("hash", F.shiftrightunsigned(F.xxhash64(F.col("record_id")), 64 - top))
    counted = durable(hashed)
    plan = durable(budgets(counted, targets, rule).select("source", "share", "copies", "rest"))
    limits = thresholds(counted, plan, rule)
    chosen = plan.join(limits, "source", "left").select(F.col("source").alias("_s"), "copies", F.coalesce("threshold", F.lit(0)).alias("threshold"))
    mix = counted.join(chosen, counted["source"] == chosen["_s"], "left").select(
        "record_id", "source", "n_tokens",
        F.coalesce(F.col("copies") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0), F.lit(0)).cast("bigint").alias("copies"),
    )
    used = mix.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count_if(F.col("copies") > 0).alias("records"), F.max("copies").alias("most_copies")
    )
    wish = targets.where(F.col("source").isNotNull()).groupBy(F.col("source").alias("_t")).agg(F.max("target_share").alias("target_share"))
    full = used.join(wish, used["source"] == wish["_t"], "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    report = full.select(
        F.coalesce("source", "_t").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(W.partitionBy(F.lit(0)))), F.lit(0.0)).alias("share"),
        zero("tokens"), zero("records"), zero("most_copies"),
    )
    return mix, report
