"""Exact top-k by inner product: a stated set of queries against all vectors, in blocks.

Queries are taken in blocks of a bounded number of vectors, each block is
broadcast and multiplied with every Arrow batch of vectors; a batch keeps only
its own best k per query, so what is shuffled is small and the final ranking sees
k rows per batch and query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def top_k(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, block: int = 4096, digits: int = 6) -> DataFrame:
    """query_id, key, score, rank: the k best vectors of each query.

    Scores are rounded to ``digits`` before ranking and ties go to the smaller key,
    so the ranking does not hang on the order of a sum.  Null keys and vectors are
    left out; vectors of another length than the query's are an error.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    asked = queries.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector)
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector)
    blocks = max(1, -(-asked.count() // block))
    out = []
    for b in range(blocks):
        part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)).collect()
        shared = spark.sparkContext.broadcast(([r[0] for r in part], np.array([r[1] for r in part], dtype=np.float64)))
        out.append(rows.mapInArrow(_scorer(shared, key, vector, k, digits), f"query_id {kind}, {key} {kind}, score double"))
    near = reduce(lambda a, b: a.unionByName(b), out)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key)))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def _scorer(shared, key: str, vector: str, k: int, digits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = shared.value
        for b in batches:
            if not len(ids) or not b.num_rows:
                continue
            keys = b.column(key)
            order = pa.compute.sort_indices(keys).to_numpy()  # ties then go to the smaller key
            scores = np.round(_matrix(b.column(vector))[order] @ asked.T, digits) + 0.0
            if len(scores) > k:
                # no full sort: what is above the k-th best of a query, and of its equals the first ones
                least = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
                above, equal = scores > least, scores == least
                keep = above | (equal & (np.cumsum(equal, axis=0) <= k - above.sum(axis=0)))
            else:
                keep = np.ones_like(scores, dtype=bool)
            at, col = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array([ids[c] for c in col], keys.type), keys.take(pa.array(order[at])), pa.array(scores[at, col])], names=["query_id", key, "score"])

    return work
