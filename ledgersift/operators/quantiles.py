"""Exact quantiles and ranks, per key or over the whole table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.config import ScaleLimits
from ledgersift.operators.skew import SLICE, largest_group, range_slices

BINS = 4096  # parts of an interval in one round of a histogram


def value_blocks(
    df: DataFrame,
    keys: list[str],
    value: str,
    limits: ScaleLimits,
    distinct: int,
    weight: str | None = None,
) -> DataFrame:
    """Distinct non-null values per key with their occurrence count and global position.

    Adds ``_count``, ``_first`` (zero-based position of the first occurrence in
    the order keys-then-value) and ``_slice``. Identical rows are merged before
    the shuffle; a value list too long for one task is laid out by range and
    numbered from per-slice totals.
    """
    blocks = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_count"))
    )
    if distinct <= limits.group_rows:
        laid = blocks.withColumn(SLICE, F.lit(0))
    else:
        laid = range_slices(blocks, [*keys, value], limits)
    totals = laid.groupBy(SLICE).agg(F.sum("_count").alias("_rows"))
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        SLICE, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    inside = (
        Window.partitionBy(SLICE)
        .orderBy(*keys, value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = laid.withColumn("_first", F.sum("_count").over(inside) - F.col("_count"))
    if distinct <= limits.group_rows:
        return counted
    return (
        counted.join(F.broadcast(offsets), SLICE)
        .withColumn("_first", F.col("_first") + F.col("_offset"))
        .drop("_offset")
    )


def quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: list[float],
    name: str,
    limits: ScaleLimits,
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per key as an array column ``name``.

    A row counts ``weight`` times (an integer column). ``keys`` may be empty for quantiles of the whole column. The built-in
    aggregate buffers the distinct values of a key in one task; when a key has
    too many of them the positions come from :func:`value_blocks` instead.
    """
    kept = df.where(F.col(value).isNotNull())
    for key in keys:
        kept = kept.where(F.col(key).isNotNull())
    if keys:
        distinct = largest_group(kept, keys)
    else:
        distinct = distinct_values(kept, value)
    if distinct <= limits.group_rows:
        times = F.col(weight) if weight else F.lit(1)
        exact = F.percentile(value, F.array(*[F.lit(p) for p in probs]), times).alias(name)
        return kept.groupBy(*keys).agg(exact)

    blocks = value_blocks(kept, keys, value, limits, distinct, weight)
    pairs = blocks.groupBy(*keys, SLICE).agg(
        F.sum("_count").alias("_rows"), F.min("_first").alias("_low")
    )
    whole = Window.partitionBy(*keys)
    spans = pairs.select(
        *keys,
        SLICE,
        F.sum("_rows").over(whole).alias("_rows"),
        F.min("_low").over(whole).alias("_low"),
    )
    placed = blocks.join(spans, [*keys, SLICE]).withColumn("_pos", F.col("_first") - F.col("_low"))

    def holds(position):
        return (F.col("_pos") <= position) & (position < F.col("_pos") + F.col("_count"))

    parts = []
    for i, p in enumerate(probs):
        target = F.lit(float(p)) * (F.col("_rows") - 1)
        parts += [
            F.max(F.when(holds(F.floor(target)), F.col(value))).alias(f"_lo{i}"),
            F.max(F.when(holds(F.ceil(target)), F.col(value))).alias(f"_hi{i}"),
            F.max(target - F.floor(target)).alias(f"_fr{i}"),
        ]
    picked = placed.groupBy(*keys).agg(*parts)
    return picked.select(
        *keys,
        F.array(
            *[
                F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_fr{i}")
                for i in range(len(probs))
            ]
        ).alias(name),
    )


def column_quantiles(
    df: DataFrame, wanted: dict[str, list[float]], weight: str | None = None, bins: int = BINS
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of many columns at once, exact and without sorting.

    Each round is one scan for all columns: the rows of the interval that holds a
    wanted position are counted in ``bins`` equal parts, of which each keeps its
    smallest and largest value; the part with the position is the next interval.
    Both ends of an interval always part, and a position is found once the two
    are equal, commonly after three or four scans. What is shuffled and held is
    one row per part and interval, whatever the number of rows or values.

    Nulls are skipped, a column without values gives nulls. Order is that of a
    sort: infinities at the ends, NaN last. A row counts ``weight`` times (an
    integer column, null or below 1: not at all).
    """
    columns = list(wanted)
    times = F.greatest(F.coalesce(F.col(weight).cast("long"), F.lit(0)), F.lit(0)) if weight else F.lit(1).cast("long")
    counted = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)], times.alias("_w")).where("_w > 0")
    found = counted.agg(*[e for i in range(len(columns)) for e in _outline(i)]).first() if columns else None

    spans: dict[tuple, set[int]] = {}      # (column, low, high, rows before) -> positions among the finite values
    settled: dict[tuple[int, int], float] = {}
    places: dict[str, list[tuple[int, int, float]]] = {}
    for i, c in enumerate(columns):
        low, high = found[f"lo{i}"], found[f"hi{i}"]
        below, finite, above, odd = (found[f"{part}{i}"] or 0 for part in ("below", "finite", "above", "odd"))
        total = below + finite + above + odd
        places[c] = []
        for p in wanted[c] if total else []:
            at = float(p) * (total - 1)
            first, second = math.floor(at), math.ceil(at)
            places[c].append((first, second, at - first))
            for r in (first, second):
                if r < below:
                    settled[i, r] = -math.inf
                elif r >= below + finite:
                    settled[i, r] = math.inf if r < below + finite + above else math.nan
                elif low == high:
                    settled[i, r] = low
                else:
                    spans.setdefault((i, low, high, below), set()).add(r)
    while spans:
        spans = _narrowed(counted, spans, settled, bins)

    def between(i: int, first: int, second: int, share: float) -> float:
        a, b = settled[i, first], settled[i, second]
        return a if share == 0 or a == b else a + (b - a) * share

    return {
        c: [between(i, *place) for place in places[c]] or [None] * len(wanted[c]) for i, c in enumerate(columns)
    }


def _outline(i: int) -> list[Column]:
    """Ends of the finite values of a column and counts of finite, infinite and odd ones."""
    x, w = F.col(f"c{i}"), F.col("_w")
    odd, infinite = F.isnan(x), F.abs(x) == float("inf")
    plain = x.isNotNull() & ~odd & ~infinite
    return [
        F.min(F.when(plain, x)).alias(f"lo{i}"), F.max(F.when(plain, x)).alias(f"hi{i}"),
        F.sum(F.when(plain, w)).alias(f"finite{i}"), F.sum(F.when(odd, w)).alias(f"odd{i}"),
        F.sum(F.when(infinite & (x < 0), w)).alias(f"below{i}"), F.sum(F.when(infinite & (x > 0), w)).alias(f"above{i}"),
    ]


def _narrowed(counted: DataFrame, spans: dict, settled: dict, bins: int) -> dict:
    """One scan: the parts of the spans that hold the positions; what is found goes to ``settled``."""
    order = list(spans)
    entries = []
    for number, (i, low, high, _) in enumerate(order):
        x = F.col(f"c{i}")
        # Halves, so that the width of a span cannot overflow.
        share = F.try_divide(x / 2 - F.lit(low / 2), F.lit(high / 2 - low / 2))
        part = F.when(x <= low, 0).when(x >= high, bins - 1).otherwise(
            F.least(F.floor(share * bins), F.lit(bins - 1))
        )
        entry = F.struct(F.lit(number).alias("span"), part.cast("int").alias("part"), x.alias("x"))
        entries.append(F.when((x >= low) & (x <= high), entry))
    kept = F.filter(F.array(*entries), lambda e: e.isNotNull())
    parts = (
        counted.select("_w", F.explode(kept).alias("e")).groupBy("e.span", "e.part")
        .agg(F.sum("_w").alias("rows"), F.min("e.x").alias("low"), F.max("e.x").alias("high"))
    )
    upto = Window.partitionBy("span").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumn("before", F.sum("rows").over(upto) - F.col("rows"))
    asked = counted.sparkSession.createDataFrame(
        [(number, r, r - span[3]) for number, span in enumerate(order) for r in sorted(spans[span])],
        "span int, position long, inside long",
    )
    hits = placed.join(F.broadcast(asked), "span").where("inside >= before and inside < before + rows")
    narrower: dict[tuple, set[int]] = {}
    for hit in hits.collect():
        i, _, _, before = order[hit["span"]]
        if hit["low"] == hit["high"]:
            settled[i, hit["position"]] = hit["low"]
        else:
            narrower.setdefault((i, hit["low"], hit["high"], before + hit["before"]), set()).add(hit["position"])
    return narrower


def table_quantiles(
    df: DataFrame,
    value: str,
    probs: list[float],
    limits: ScaleLimits,
    weight: str | None = None,
) -> list[float | None]:
    """Quantiles of a whole column as plain numbers (nulls if there are no values)."""
    if distinct_values(df, value) > limits.group_rows:
        return column_quantiles(df, {value: probs}, weight)[value]
    row = quantiles(df, [], value, probs, "q", limits, weight).first()
    return list(row["q"]) if row and row["q"] else [None] * len(probs)


_distinct: dict[tuple, int] = {}


def distinct_values(df: DataFrame, value: str) -> int:
    """An estimate of the distinct values of a column, used only to choose a plan."""
    column = df.select(value)
    token = (id(df.sparkSession), column.semanticHash())
    if token not in _distinct:
        _distinct[token] = column.agg(F.approx_count_distinct(value).alias("n")).first()["n"]
    return _distinct[token]
