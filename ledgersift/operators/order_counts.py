"""Exact quantiles of a column under additions and removals, without reading it whole.

Values are kept with their counts in blocks of a sixteenth of an octave. A quantile takes
the small table of block totals to find its block and reads only that block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.config import ScaleLimits
from ledgersift.operators.quantiles import value_blocks
from ledgersift.session import materialize

PER_OCTAVE = 16
_SHIFT = 32 * 1024  # beyond every exponent of a double times PER_OCTAVE


def block_of(value: Column) -> Column:
    """A whole number that does not fall as the value rises; at most some 70,000 of them."""
    size = (F.floor(F.log2(F.abs(value)) * PER_OCTAVE) + _SHIFT).cast("int")
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0))


def value_counts(df: DataFrame, value: str, sign: int = 1) -> DataFrame:
    """(block, value, n) of the non-null values; ``sign`` -1 takes them away."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("value"))
    return rows.groupBy("value").agg((F.count(F.lit(1)) * sign).alias("n")).select(
        block_of(F.col("value")).alias("block"), "value", "n"
    )


def block_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("block").agg(F.sum("n").alias("n"))


def counted_quantiles(
    counts: DataFrame, totals: DataFrame, probs: list[float], limits: ScaleLimits
) -> list[float | None]:
    """Linear-interpolated quantiles; nulls where nothing is counted.

    ``counts`` (block, value, n) and ``totals`` (block, n) may list a value or block several
    times, with negative n for what has gone. Only the blocks that hold a wanted position
    are read from ``counts``: partitioned by block, the others are not opened.
    """
    sizes = {r["block"]: r["n"] for r in block_totals(totals).where("n > 0").collect()}
    rows = sum(sizes.values())
    if not rows:
        return [None] * len(probs)
    starts, at = {}, 0
    for block in sorted(sizes):
        starts[block] = at
        at += sizes[block]

    def home(position: int) -> int:
        return max(b for b, start in starts.items() if start <= position)

    wanted = sorted({f(p * (rows - 1)) for p in probs for f in (math.floor, math.ceil)})
    opened = sorted({home(position) for position in wanted})
    held = (
        counts.where(F.col("block").isin(opened)).groupBy("block", "value").agg(F.sum("n").alias("n"))
    )
    held = materialize(held.where("n > 0"))
    placed = value_blocks(held, ["block"], "value", limits, held.count(), weight="n")
    # Positions count within the opened blocks only.
    local, before = {}, 0
    for block in opened:
        for position in wanted:
            if home(position) == block:
                local[before + position - starts[block]] = position
        before += sizes[block]
    spots = F.explode(F.array(*[F.lit(spot).cast("long") for spot in local]))
    hits = placed.withColumn("spot", spots).where(
        (F.col("_first") <= F.col("spot")) & (F.col("spot") < F.col("_first") + F.col("_count"))
    )
    value = {local[r["spot"]]: r["value"] for r in hits.select("spot", "value").collect()}
    out = []
    for p in probs:
        target = p * (rows - 1)
        low, high = value[math.floor(target)], value[math.ceil(target)]
        out.append(low + (high - low) * (target - math.floor(target)))
    return out
