"""Building blocks that keep any single key from landing in one task.

Every operator that orders or joins by a business key goes through here. The
size of the largest key is measured first (one scalar, computed with partial
aggregation). Ordinary data keep the plain Spark plan; data with an oversized
key are laid out by range, so that the key is cut into contiguous *slices*, and
what crosses a slice edge travels in a table with at most two rows per slice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.config import ScaleLimits
from ledgersift.session import brief_shuffles, materialize

SLICE = "_slice"
_measured: dict[tuple, tuple[int, int, int, float]] = {}


def has_all(keys: list[str]) -> Column:
    """True where none of the keys is null."""
    test = F.lit(True)
    for key in keys:
        test = test & F.col(key).isNotNull()
    return test


def _sizes(df: DataFrame, keys: list[Column | str]) -> tuple[int, int, int, float]:
    """Rows of the biggest non-null key, rows lacking a key, all rows, sum of the squared rows of non-null keys.

    Remembered per plan and keys.
    """
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    named = df.select(*[c.alias(f"k{i}") for i, c in enumerate(columns)])
    token = (id(df.sparkSession), named.semanticHash())
    if token not in _measured:
        whole = has_all(named.columns)
        with brief_shuffles(df.sparkSession):
            row = named.groupBy(*named.columns).count().agg(
                F.max(F.when(whole, F.col("count"))).alias("n"),
                F.sum(F.when(~whole, F.col("count"))).alias("missing"),
                F.sum("count").alias("total"),
                F.sum(F.when(whole, F.col("count").cast("double") * F.col("count"))).alias("squares"),
            ).first()
        _measured[token] = (row["n"] or 0, row["missing"] or 0, row["total"] or 0, row["squares"] or 0.0)
    return _measured[token]


def largest_group(df: DataFrame, keys: list[Column | str]) -> int:
    """Rows of the biggest non-null key (remembered per plan and keys)."""
    return _sizes(df, keys)[0]


def mean_group(df: DataFrame, keys: list[Column | str]) -> float:
    """Rows that the key of a row has on average over the rows with a key (remembered per plan and keys)."""
    _, missing, total, squares = _sizes(df, keys)
    return squares / max(1, total - missing)


def nulls_crowd(df: DataFrame, keys: list[str], limits: ScaleLimits) -> bool:
    """Whether rows lacking a key would crowd one task: over ``group_rows`` or a 32nd of all rows."""
    _, missing, total, _ = _sizes(df, keys)
    return missing > limits.group_rows or missing * 32 > total


def slice_count(df: DataFrame, limits: ScaleLimits) -> int:
    return limits.slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread_nulls(keys: list[str], limits: ScaleLimits, unique: str = "id") -> Column:
    """Slice number for an ordinary layout: 0, except that null keys are scattered."""
    return F.when(has_all(keys), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(unique), F.lit(limits.salt)).cast("int")
    )


def range_slices(
    df: DataFrame, order: list[str], limits: ScaleLimits, write: Callable[[DataFrame], DataFrame] = materialize
) -> DataFrame:
    """Lay rows out by range of ``order`` and number the ranges.

    Rows equal on ``order`` share a slice and slice numbers follow the order, so
    a key that leads ``order`` becomes a run of consecutive slices.
    """
    laid = df.repartitionByRange(slice_count(df, limits), *order)
    return write(laid.withColumn(SLICE, F.spark_partition_id()))


def carry_before(ends: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """For each (key, slice): ``value`` of the closest earlier slice of that key that has one.

    Only keys cut by a slice edge produce rows, so the result has at most one
    row per slice and may be broadcast.
    """
    w = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ends.withColumn(name, F.last(value, ignorenulls=True).over(w))
        .where(F.col(name).isNotNull())
        .select(*keys, SLICE, name)
    )


def carry_after(ends: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """As :func:`carry_before`, looking at later slices."""
    w = (
        Window.partitionBy(*keys)
        .orderBy(F.desc(SLICE))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ends.withColumn(name, F.last(value, ignorenulls=True).over(w))
        .where(F.col(name).isNotNull())
        .select(*keys, SLICE, name)
    )


def join_dealt(left: DataFrame, right: DataFrame, keys: list[str], rows: int, limits: ScaleLimits) -> DataFrame:
    """Left join whose tasks grow in number with the ``rows`` on the left, not in size.

    The session's shuffle partitions are a fixed number, and adaptive execution merges them by
    compressed bytes, which tell little of the memory that sorts and windows over whole rows need.
    """
    tasks = -(-rows // limits.task_rows)
    if tasks > left.sparkSession.sparkContext.defaultParallelism:
        # Both sides: a side without an explicit number would impose the session's.
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return left.join(right, keys, "left")


def attach(
    rows: DataFrame,
    stats: DataFrame,
    keys: list[str],
    largest: int,
    limits: ScaleLimits,
    unique: str = "id",
    nulls: bool = True,
    dealt: bool = False,
) -> DataFrame:
    """Left-join per-key ``stats`` (one row per key) without a hot task.

    Rows with a null key match nothing and are scattered where they are many. If some key exceeds
    the limit, keys holding at least 1/4096 of the rows (hence never more than
    4096 keys) are cut into pieces and their stats row is repeated per piece.
    ``nulls`` is false where no key can be null. ``dealt`` is for keys that are many, or that the
    rows are ordered by later on: a small ``stats`` is not broadcast then, see :func:`join_dealt`.
    """
    size = _sizes(rows, keys)[2] if dealt and largest <= limits.task_rows else 0
    salt = F.pmod(F.xxhash64(unique), F.lit(limits.salt)).cast("int")
    if largest <= limits.group_rows:
        if not nulls or not nulls_crowd(rows, keys, limits):
            return join_dealt(rows, stats, keys, size, limits)
        left = rows.withColumn("_salt", F.when(has_all(keys), F.lit(0)).otherwise(salt))
        # Always 0, yet no literal: the optimizer would take a literal out of the
        # join keys, and all rows without a key would meet in one task.
        right = stats.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int"))
        return join_dealt(left, right, [*keys, "_salt"], size, limits).drop("_salt")

    counts = rows.where(has_all(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("n")).first()["n"]
    floor = max(limits.group_rows, total // 4096)
    pieces = max(2, -(-largest // limits.group_rows))
    pieces = min(pieces, 4096)
    hot = counts.where(F.col("_n") > floor).select(*keys, F.lit(pieces).alias("_pieces"))
    piece = F.pmod(F.xxhash64(unique), F.lit(pieces)).cast("int")
    left = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn(
            "_salt",
            F.when(F.col("_pieces").isNotNull(), piece)
            .when(has_all(keys), F.lit(0))
            .otherwise(salt),
        )
        .drop("_pieces")
    )
    right = (
        stats.join(F.broadcast(hot), keys, "left")
        .withColumn(
            "_salt",
            F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1)),
        )
        .drop("_pieces")
    )
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


def previous_value(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str, limits: ScaleLimits
) -> DataFrame:
    """Add ``name``: ``value`` of the preceding row of the same key (null for null keys)."""
    if largest_group(df, keys) <= limits.group_rows:
        laid = df.withColumn(SLICE, spread_nulls(keys, limits))
        w = Window.partitionBy(*keys, SLICE).orderBy(*order)
        return laid.withColumn(name, F.when(has_all(keys), F.lag(value).over(w))).drop(SLICE)

    laid = range_slices(df, [*keys, *order], limits)
    w = Window.partitionBy(*keys, SLICE).orderBy(*order)
    inside = laid.withColumn(name, F.when(has_all(keys), F.lag(value).over(w)))
    ends = (
        laid.where(has_all(keys))
        .groupBy(*keys, SLICE)
        .agg(F.max_by(value, F.struct(*order)).alias("_end"))
    )
    carry = carry_before(ends, keys, F.col("_end"), "_carry")
    return (
        inside.join(F.broadcast(carry), [*keys, SLICE], "left")
        .withColumn(name, F.coalesce(F.col(name), F.col("_carry")))
        .drop("_carry", SLICE)
    )


def number_rows(
    df: DataFrame,
    order: list[str],
    name: str,
    size: int,
    limits: ScaleLimits,
    write: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """Add ``name``: 1, 2, 3, ... in ``order`` (unique per row), without a one-task sort at scale.

    ``write`` writes the ranges, which the result reads.
    """
    inside = Window.partitionBy(SLICE).orderBy(*order)
    if size <= limits.group_rows:
        return df.withColumn(SLICE, F.lit(0)).withColumn(name, F.row_number().over(inside)).drop(SLICE)
    laid = range_slices(df, order, limits, write)
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        laid.groupBy(SLICE)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(SLICE, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        laid.join(F.broadcast(offsets), SLICE)
        .withColumn(name, F.row_number().over(inside) + F.col("_offset"))
        .drop(SLICE, "_offset")
    )
