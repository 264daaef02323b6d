"""Look-back statistics over time, linear in the rows whatever their density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.config import ScaleLimits
from ledgersift.operators.skew import (
    SLICE,
    has_all,
    largest_group,
    mean_group,
    range_slices,
    spread_nulls,
)

MOMENTS = "struct<n:double,s:double,m2:double>"


def _merge(a: Column, b: Column) -> Column:
    """Combine two (count, sum, squared-deviation) triples."""
    gap = a["s"] / a["n"] - b["s"] / b["n"]
    both = F.struct(
        (a["n"] + b["n"]).alias("n"),
        (a["s"] + b["s"]).alias("s"),
        (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / (a["n"] + b["n"])).alias("m2"),
    )
    lacks_a, lacks_b = a.isNull() | (a["n"] == 0), b.isNull() | (b["n"] == 0)
    return F.when(lacks_a, F.coalesce(b, a)).when(lacks_b, a).otherwise(both)


def _moments(value: str, w) -> Column:
    n = F.count(value).over(w)
    return F.struct(
        n.cast("double").alias("n"),
        F.coalesce(F.sum(value).over(w), F.lit(0.0)).alias("s"),
        F.coalesce(F.var_pop(value).over(w) * n, F.lit(0.0)).alias("m2"),
    )


def lookback(
    df: DataFrame,
    keys: list[str],
    value: str,
    length_us: int,
    prior_only: bool,
    limits: ScaleLimits,
) -> DataFrame:
    """Add ``_n``, ``_s``, ``_m2``: count, sum and squared deviations of ``value`` looking back.

    ``df`` has ``id`` (unique) and ``_us``. With ``prior_only`` the window is the
    rows before this one in (``_us``, ``id``) order, back to ``_us - length``
    inclusive. Otherwise it is every row in ``(_us - length, _us]``. Rows with a
    null key get nulls.
    """
    if largest_group(df, keys) <= limits.group_rows:
        return _by_frames(df, keys, value, length_us, prior_only, limits)
    sums = _by_cells(df, keys, value, length_us, prior_only, limits)
    return df.join(sums, "id", "left")


def _sparse(df: DataFrame, keys: list[str], length_us: int, limits: ScaleLimits) -> bool:
    """Whether sliding frames of that length are short, the longest and on average."""
    group = [*keys, F.floor(F.col("_us") / F.lit(length_us))]
    keyed = df.where(has_all(keys))
    return largest_group(keyed, group) <= limits.frame_rows and mean_group(keyed, group) <= limits.frame_mean


def _by_frames(df, keys, value, length_us, prior_only, limits) -> DataFrame:
    laid = df.withColumn(SLICE, spread_nulls(keys, limits))
    part = Window.partitionBy(*keys, SLICE)
    # Earlier timestamps by range, equal timestamps by position.
    first, last = (-length_us, -1) if prior_only else (1 - length_us, 0)
    if _sparse(df, keys, length_us, limits):
        laid = laid.withColumn("_past", _moments(value, part.orderBy("_us").rangeBetween(first, last)))
    else:
        laid = _past_by_halves(laid, keys, value, length_us, prior_only)
    if prior_only:
        peers = _moments(
            value,
            Window.partitionBy(*keys, SLICE, "_us")
            .orderBy("id")
            .rowsBetween(Window.unboundedPreceding, -1),
        )
        laid = laid.withColumn("_peers", peers)
        total = _merge(F.col("_past"), F.col("_peers"))
    else:
        total = F.col("_past")
    return (
        laid.withColumn("_sum", F.when(has_all(keys), total))
        .withColumns({"_n": F.col("_sum.n"), "_s": F.col("_sum.s"), "_m2": F.col("_sum.m2")})
        .drop("_sum", "_past", "_peers", SLICE)
    )


def _past_by_halves(laid: DataFrame, keys: list[str], value: str, length_us: int, prior_only: bool) -> DataFrame:
    """Add ``_past``, the moments of the range that a sliding frame would cover, from cumulative frames.

    Time is cut into cells as long as the window, whose range is then a head of its row's cell and a
    tail of the cell before. A probe stands where the range begins and finds the tail; heads and tails
    depend on the time alone and meet among the rows of one time. All windows keep to ``keys`` and
    slice, so rows laid out by them stay where they are.
    """
    fixed = [*keys, SLICE]
    cell = F.floor(F.col("_us") / F.lit(length_us))

    def entry(is_row: bool, at: Column, within: Column, amount: Column) -> Column:
        return F.struct(
            F.lit(is_row).alias("_is_row"), F.col("_us").alias("_time"), at.alias("_at"),
            within.alias("_cell"), amount.cast("double").alias("_v"),
        )

    own = entry(True, F.col("_us"), cell, F.col(value))
    probe = entry(False, F.col("_us") - F.lit(length_us), cell - 1, F.lit(None))
    # Without key or time there is nothing to find.
    entries = F.when(has_all([*keys, "_us"]), F.array(own, probe)).otherwise(F.array(own))
    # Probes carry no row, and column by column, so that unused columns are still left out.
    both = laid.select("*", F.inline(entries)).withColumns(
        {c: F.when(F.col("_is_row"), F.col(c)) for c in laid.columns if c not in fixed}
    )
    part = Window.partitionBy(*fixed, "_cell")
    upto, beyond = (-1, 0) if prior_only else (0, -1)
    head = _moments("_v", part.orderBy("_at").rangeBetween(Window.unboundedPreceding, upto))
    tail = _moments("_v", part.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, beyond))
    found = F.max(F.when(~F.col("_is_row"), F.col("_tail"))).over(Window.partitionBy(*fixed, "_time"))
    whole = both.withColumns({"_head": head, "_tail": tail}).withColumn("_tail", found).where("_is_row")
    return whole.select(*laid.columns, _merge(F.col("_head"), F.col("_tail")).alias("_past"))


def _by_cells(df, keys, value, length_us, prior_only, limits) -> DataFrame:
    """The same sums from cumulative frames only.

    Time is cut into cells as long as the window, so a window is a prefix of its
    row's cell plus a suffix of the cell before. Each row enters its own cell
    with its value and the cell before as a probe. Cells are laid out by range
    and may be cut into slices; totals of other slices of a cell are carried.
    """
    rows = df.where(has_all(keys)).select("id", "_us", F.col(value).alias("_v"), *keys)
    cell = F.floor(F.col("_us") / F.lit(length_us))
    own = rows.withColumns({"_cell": cell, "_probe": F.lit(0)})
    probe = rows.withColumns(
        {
            "_us": F.col("_us") - F.lit(length_us),
            "_v": F.lit(None).cast("double"),
            "_cell": cell - 1,
            "_probe": F.lit(1),
        }
    )
    group = [*keys, "_cell"]
    laid = range_slices(own.unionByName(probe), [*group, "_us"], limits)
    part = Window.partitionBy(*group, SLICE)
    if prior_only:
        # Positions within equal timestamps; the far edge of the window is included.
        head = part.orderBy("_us", "_probe", "id").rowsBetween(Window.unboundedPreceding, -1)
        back = part.orderBy(F.desc("_us"), F.asc("_probe"))
    else:
        head = part.orderBy("_us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        back = part.orderBy(F.desc("_us"), F.desc("_probe"))
    tail = back.rangeBetween(Window.unboundedPreceding, Window.currentRow)

    totals = laid.groupBy(*group, SLICE).agg(
        F.struct(
            F.count("_v").cast("double").alias("n"),
            F.coalesce(F.sum("_v"), F.lit(0.0)).alias("s"),
            F.coalesce(F.var_pop("_v") * F.count("_v"), F.lit(0.0)).alias("m2"),
        ).alias("_part")
    )
    # Cells cut by a slice edge: merge what lies in their earlier and later slices.
    around = Window.partitionBy(*group).orderBy(SLICE)
    earlier = F.collect_list("_part").over(around.rowsBetween(Window.unboundedPreceding, -1))
    later = F.collect_list("_part").over(around.rowsBetween(1, Window.unboundedFollowing))
    spread = totals.withColumn("_pieces", F.count(F.lit(1)).over(Window.partitionBy(*group))).where(
        "_pieces > 1"
    )
    nothing = F.lit(None).cast(MOMENTS)
    carried = spread.select(
        *group,
        SLICE,
        F.aggregate(earlier, nothing, _merge).alias("_earlier"),
        F.aggregate(later, nothing, _merge).alias("_later"),
    )
    inside = laid.withColumns({"_head": _moments("_v", head), "_tail": _moments("_v", tail)})
    whole = inside.join(F.broadcast(carried), [*group, SLICE], "left").select(
        "id",
        F.when(F.col("_probe") == 0, _merge(F.col("_head"), F.col("_earlier"))).alias("_a"),
        F.when(F.col("_probe") == 1, _merge(F.col("_tail"), F.col("_later"))).alias("_b"),
    )
    sums = whole.groupBy("id").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    total = _merge(F.col("_a"), F.col("_b"))
    return sums.select(
        "id", total["n"].alias("_n"), total["s"].alias("_s"), total["m2"].alias("_m2")
    )


