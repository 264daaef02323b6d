"""Packing by optimal length buckets.

The lengths of all documents give a histogram on a bounded grid; dynamic
programming over it chooses the bucket bounds with the least padding, and
batches of a fixed token budget form inside each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.llm.words import word_count

BUCKETS = 16
TOKEN_BUDGET = 32_768
FINE = 9  # lengths keep their 9 leading bits, so that the grid has at most 256 points per power of two
SHARD_ROWS = 50_000
SEED = 77


def grid_length(length: Column) -> Column:
    """The smallest grid length that is not below ``length`` (exact up to 512, within 0.4 % beyond)."""
    bits = F.length(F.bin(length))
    step = F.when(bits > FINE, F.call_function("shiftleft", F.lit(1).cast("bigint"), (bits - FINE).cast("int"))).otherwise(
        F.lit(1).cast("bigint")
    )
    return F.when(length <= 0, F.lit(0).cast("bigint")).otherwise(
        F.call_function("div", length + step - 1, step) * step
    )


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> tuple[list[int], int]:
    """Bucket bounds with the least padded total, and that total.

    ``lengths`` ascending. A bucket over the points i..j costs ``lengths[j]`` for
    each of its documents. The cost obeys the quadrangle inequality, so each
    layer is solved by divide and conquer in O(n log n).
    """
    n = len(lengths)
    if n == 0:
        return [], 0
    lengths = np.asarray(lengths, dtype=np.float64)
    sums = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64))])
    best = lengths * sums[1:]
    choice: list[np.ndarray] = [np.zeros(n, dtype=np.int64)]
    for _ in range(1, min(buckets, n)):
        new, first = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
        stack = [(0, n - 1, 0, n - 1)]
        while stack:
            low, high, a, b = stack.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            starts = np.arange(a, min(mid, b) + 1)
            cost = np.where(starts > 0, best[starts - 1], 0.0) + lengths[mid] * (sums[mid + 1] - sums[starts])
            k = int(np.argmin(cost))
            new[mid], first[mid] = cost[k], starts[k]
            stack += [(low, mid - 1, a, int(starts[k])), (mid + 1, high, int(starts[k]), b)]
        choice.append(first)
        best = new
    total, at, bounds = int(best[n - 1]), n - 1, []
    for first in reversed(choice):
        bounds.append(int(lengths[at]))
        at = int(first[at]) - 1
        if at < 0:
            break
    return bounds[::-1], total


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """Assign every row a bucket, a batch and a place in it.

    Added: length, bucket, padded_length (the bucket's bound), shard, batch
    (numbered inside bucket and shard), slot, batch_rows, batch_tokens (padded).
    A batch holds ``budget div padded_length`` rows, at least one: a document
    longer than the budget is a batch of its own. Null and empty texts have
    length 0 and fill batches of at most ``budget`` rows. An empty table gives
    no rows. Columns with these names are replaced.

    The histogram has a bounded number of rows; the bucket bounds are literals
    of the second pass. Rows of a bucket are dealt out to shards of about
    ``SHARD_ROWS``, so no bucket is numbered in a single task.
    """
    own = ["length", "bucket", "padded_length", "shard", "batch", "slot", "batch_rows", "batch_tokens"]
    measured = docs.drop(*own).withColumn("length", word_count(F.col("text")) if length is None else length)
    histogram = (
        measured.groupBy(grid_length(F.col("length")).alias("g")).agg(F.count(F.lit(1)).alias("n")).orderBy("g").collect()
    )
    bounds, _ = optimal_bounds(np.array([r["g"] for r in histogram]), np.array([r["n"] for r in histogram]), buckets)
    total = sum(r["n"] for r in histogram)
    shards = max(1, -(-total // SHARD_ROWS))
    edges = F.array(*[F.lit(int(b)).cast("bigint") for b in bounds]) if bounds else F.array(F.lit(0).cast("bigint"))
    bucket = F.size(F.filter(edges, lambda e: e < F.col("length")))
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded_length"), F.lit(1)))).cast("bigint")
    dealt = (
        measured.withColumn("bucket", bucket.cast("int"))
        .withColumn("padded_length", F.element_at(edges, F.col("bucket") + 1))
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(shards)).cast("int"))
    )
    order = Window.partitionBy("bucket", "shard").orderBy("doc_id", "length")
    numbered = (
        dealt.withColumn("_at", F.row_number().over(order) - 1)
        .withColumn("batch", F.floor(F.col("_at") / capacity).cast("bigint"))
        .withColumn("slot", F.pmod(F.col("_at"), capacity).cast("bigint"))
        .drop("_at")
    )
    batch = Window.partitionBy("bucket", "shard", "batch")
    return numbered.withColumn("batch_rows", F.count(F.lit(1)).over(batch)).withColumn(
        "batch_tokens", F.col("batch_rows") * F.col("padded_length")
    )
