"""Four fraud patterns and their combination."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.config import DEFAULT, HOUR_US, AuditConfig
from ledgersift.functions.temporal import micros
from ledgersift.operators.quantiles import table_quantiles
from ledgersift.operators.rolling import lookback
from ledgersift.operators.skew import SLICE, carry_after, join_dealt, largest_group, range_slices
from ledgersift.session import materialize

# Two values whose ln(1+x) fall into one band of this width differ by less than
# 1 %, and values within 1 % are at most two bands apart.
BAND_SHARE = 0.99  # of the tolerance: two rows of one band always match
# Two-sided 10 % critical points of Spearman's rho for n = 5, 6
# (t distribution, n-2 degrees of freedom); from n = 7 on they lie below 0.70.
RHO_CRITICAL = {5: 0.80538, 6: 0.72930}


def _narrow(df: DataFrame) -> DataFrame:
    return df.select("id", "user_id", "supplier_id", "amount", micros("created_at").alias("_us"))


def splitting(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Several payments of a user to one supplier within a day that add up to a large sum.

    Returns (id, fraud_splitting_score) for the rows that score.
    """
    p75 = F.lit(table_quantiles(df, "amount", [0.75], cfg.limits)[0])
    rows = _narrow(df).where(F.col("supplier_id").isNotNull() & F.col("user_id").isNotNull())
    keys = ["user_id", "supplier_id"]
    summed = lookback(rows, keys, "amount", cfg.splitting_hours * HOUR_US, True, cfg.limits)
    total = F.col("_s") + F.col("amount")
    limited = summed.where(F.col("_n") >= 2).withColumn("_total", total)
    by_count = F.least(F.col("_n") / 10.0, F.lit(1.0))
    by_sum = F.least(F.col("_total") / (p75 * 3), F.lit(1.0))
    return limited.where(F.col("_total") > p75).select(
        "id", ((by_count + by_sum) / 2).alias("fraud_splitting_score")
    )


def near_duplicates(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """A user pays nearly the same amount again within two days; the later row scores.

    Amounts are put into logarithmic bands narrow enough that two rows of one
    band always match. The most recent match of a row therefore lies after the
    row's predecessor in its own band, so every row is a candidate for only one
    row per nearby band: the next one to come. Candidates grow with the rows, not
    with pairs of rows. Returns (id, fraud_duplicate_score) for rows that match.
    """
    tolerance = cfg.duplicate_tolerance
    if not 0 < tolerance < 1:
        raise ValueError("the tolerance must lie between 0 and 1")
    # exp(width) - 1 stays below the tolerance; a match lies within reach of the logarithm.
    width, reach = BAND_SHARE * math.log1p(tolerance), -math.log1p(-tolerance) * 1.0009
    span = cfg.duplicate_hours * HOUR_US
    log = F.log1p("amount")
    rows = _narrow(df).where(F.col("user_id").isNotNull()).drop("supplier_id")
    band = F.floor(log / width)
    near = F.sequence(F.floor((log - reach) / width), F.floor((log + reach) / width))
    spread = rows.withColumns({"_home": band, "_band": F.explode(near)})

    keys = ["user_id", "_band"]
    # Home bands are a lower bound on group sizes; each row comes to so many bands at most.
    crowded = largest_group(rows, ["user_id", band]) * (2 + math.ceil(2 * reach / width))
    if crowded <= cfg.limits.group_rows:
        laid = spread.withColumn(SLICE, F.lit(0))
    else:
        laid = range_slices(spread, [*keys, "_us", "id"], cfg.limits)
    here = F.when(
        F.col("_home") == F.col("_band"), F.struct("id", "_us", "amount")
    )
    after = (
        Window.partitionBy(*keys, SLICE)
        .orderBy(F.desc("_us"), F.desc("id"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    paired = laid.withColumn("_next", F.last(here, ignorenulls=True).over(after))
    if crowded > cfg.limits.group_rows:
        first = (
            laid.where("_home = _band")
            .groupBy(*keys, SLICE)
            .agg(F.min_by(F.struct("id", "_us", "amount"), F.struct("_us", "id")).alias("_first"))
        )
        # Slices without a home row still need to see past themselves.
        every = laid.select(*keys, SLICE).distinct().join(first, [*keys, SLICE], "left")
        carry = carry_after(every, keys, F.col("_first"), "_later")
        paired = paired.join(F.broadcast(carry), [*keys, SLICE], "left").withColumn(
            "_next", F.coalesce("_next", "_later")
        )
    nxt = F.col("_next")
    alike = F.abs(nxt["amount"] - F.col("amount")) / (nxt["amount"] + 1) < tolerance
    recent = F.col("_us") >= nxt["_us"] - F.lit(span)
    hours = F.min(nxt["_us"] - F.col("_us")) / F.lit(float(HOUR_US))
    return (
        paired.where(alike & recent)
        .groupBy(nxt["id"].alias("id"))
        .agg((1.0 - hours / float(cfg.duplicate_hours)).alias("fraud_duplicate_score"))
    )


def ghost_suppliers(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """A supplier seen exactly once, with an amount above the ninth decile.

    Grouping by supplier carries the single row along, so nothing is joined back.
    """
    p90 = F.lit(table_quantiles(df, "amount", [0.90], cfg.limits)[0])
    single = (
        df.where(F.col("supplier_id").isNotNull())
        .groupBy("supplier_id")
        .agg(
            F.count(F.lit(1)).alias("_uses"),
            F.min("id").alias("id"),
            F.max("amount").alias("_amount"),
        )
        .where("_uses = 1")
    )
    return single.where(F.col("_amount") > p90).select(
        "id", F.least(F.col("_amount") / p90, F.lit(1.0)).alias("fraud_ghost_supplier_score")
    )


def inflation(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """The latest amounts of a user rise with time (rank correlation over the last ten).

    The tail filter is applied per task before the shuffle, so each user sends
    few rows however many they have.
    """
    latest = Window.partitionBy("user_id").orderBy(F.desc("_us"), F.desc("id"))
    tail = (
        _narrow(df)
        .where(F.col("user_id").isNotNull())
        .select("id", "user_id", "amount", "_us")
        .withColumn("_back", F.row_number().over(latest))
        .where(F.col("_back") <= cfg.inflation_tail)
    )
    user = Window.partitionBy("user_id")
    equal = F.count(F.lit(1)).over(Window.partitionBy("user_id", "amount"))
    ranked = tail.withColumns(
        {
            "_rank": F.rank().over(user.orderBy("amount")) + (equal - 1) / 2.0,
            "_time": -F.col("_back").cast("double"),
            "_min": F.min("amount").over(user),
            "_max": F.max("amount").over(user),
        }
    ).where(F.col("_min") < F.col("_max"))
    rho = F.corr("_time", "_rank")
    users = ranked.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_n"),
        rho.alias("_rho"),
        F.collect_list("id").alias("_ids"),
    )
    critical = F.lit(cfg.inflation_rho)
    for n, limit in RHO_CRITICAL.items():
        critical = F.when(F.col("_n") == n, F.greatest(F.lit(limit), F.lit(cfg.inflation_rho))).otherwise(critical)
    rising = (F.col("_n") >= cfg.inflation_min_tx) & (F.col("_rho") > critical)
    score = (F.col("_rho") - cfg.inflation_rho) / (1 - cfg.inflation_rho)
    return users.where(rising).select(
        F.explode("_ids").alias("id"), score.alias("fraud_inflation_score")
    )


PATTERNS = {
    "fraud_splitting_score": splitting,
    "fraud_duplicate_score": near_duplicates,
    "fraud_ghost_supplier_score": ghost_suppliers,
    "fraud_inflation_score": inflation,
}


def pattern_hits(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """One row per id with at least one pattern: (id, four scores, fraud_score_combined).

    Hits are a small part of the ledger; they are merged by id among themselves
    so the ledger is joined once.
    """
    parts = None
    for name, detect in PATTERNS.items():
        hit = detect(df, cfg).select(
            "id",
            *[(F.col(n) if n == name else F.lit(0.0)).alias(n) for n in PATTERNS],
        )
        parts = hit if parts is None else parts.unionByName(hit)
    merged = parts.groupBy("id").agg(*[F.max(n).alias(n) for n in PATTERNS])
    return merged.withColumn("fraud_score_combined", F.greatest(*PATTERNS))


def fraud_threshold(scored: DataFrame, cfg: AuditConfig = DEFAULT) -> float:
    """The 60th percentile of the non-zero combined scores (0.40 when there are none)."""
    positive = scored.where(F.col("fraud_score_combined") > 0).select("fraud_score_combined")
    cut = table_quantiles(positive, "fraud_score_combined", [cfg.fraud_quantile], cfg.limits)[0]
    return cfg.fraud_fallback if cut is None else cut


def add_patterns(
    df: DataFrame, cfg: AuditConfig = DEFAULT, base: DataFrame | None = None
) -> DataFrame:
    """Add the four pattern scores, their maximum and ``is_fraud_pattern``.

    ``base`` may name the narrower ledger the rows come from; the detectors read
    only its id, user, supplier, amount and creation time. The hits are written
    once because both the threshold and the join need them.
    """
    hits = materialize(pattern_hits(base or df, cfg))
    limit = fraud_threshold(hits, cfg)
    names = [*PATTERNS, "fraud_score_combined"]
    # Few hits are left to a broadcast.
    rows = df.count() if hits.count() > cfg.limits.broadcast_rows else 0
    joined = join_dealt(df, hits, ["id"], rows, cfg.limits)
    filled = joined.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})
    return filled.withColumn(
        "is_fraud_pattern", (F.col("fraud_score_combined") >= limit).cast("int")
    )
