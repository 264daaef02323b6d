"""Per-row audit features: calendar, amount, behaviour, profile and supplier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.config import DAY_US, DEFAULT, AuditConfig
from ledgersift.functions.scalar import ratio_or
from ledgersift.functions.temporal import micros, temporal_columns
from ledgersift.operators.quantiles import quantiles, table_quantiles
from ledgersift.operators.rolling import lookback
from ledgersift.operators.skew import attach, largest_group, previous_value


def add_temporal(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    return df.withColumns(temporal_columns(cfg))


def outside_fence(value: Column, q1: Column, q3: Column, factor: float) -> Column:
    """1 where ``value`` lies outside the Tukey fence around the quartiles."""
    reach = factor * (q3 - q1)
    return ((value < q1 - reach) | (value > q3 + reach)).cast("int")


def _most_common(df: DataFrame, value: str, name: str) -> DataFrame:
    """Most frequent value per user, ties to the smallest, by counting before ranking; nulls do not count."""
    counts = df.where(F.col(value).isNotNull()).groupBy("user_id", value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy("user_id").agg(
        F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name)
    )


def user_statistics(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Every per-user figure from a single grouping (one row per non-null user)."""
    own = df.where(F.col("user_id").isNotNull())
    us = micros("created_at")
    days = F.floor((F.max(us) - F.min(us)) / F.lit(DAY_US))
    hour = F.hour("created_at")
    parts = [
        F.avg("amount").alias("user_amount_mean"),
        F.stddev_samp("amount").alias("user_amount_std"),
        F.count("id").alias("user_tx_count"),
        F.greatest(days, F.lit(1)).cast("long").alias("user_active_days"),
        F.avg(hour).alias("user_hour_mean"),
        F.coalesce(F.stddev_samp(hour), F.lit(0.0)).alias("user_hour_std"),
    ]
    if largest_group(df, ["user_id"]) <= cfg.limits.group_rows:
        quartiles = F.percentile("amount", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        return own.groupBy("user_id").agg(
            *parts,
            quartiles.alias("_q"),
            F.mode("source", True).alias("user_typical_source"),
            F.mode("expense_type", True).alias("user_typical_expense_type"),
        )
    stats = own.groupBy("user_id").agg(*parts)
    for extra in (
        quantiles(own, ["user_id"], "amount", [0.25, 0.5, 0.75], "_q", cfg.limits),
        _most_common(own, "source", "user_typical_source"),
        _most_common(own, "expense_type", "user_typical_expense_type"),
    ):
        stats = stats.join(extra, "user_id", "left")
    return stats


def attach_users(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Join the per-user statistics onto the rows."""
    largest = largest_group(df, ["user_id"])
    return attach(df, user_statistics(df, cfg), ["user_id"], largest, cfg.limits, dealt=True)


def overall_amounts(df: DataFrame, cfg: AuditConfig = DEFAULT) -> dict[str, float | None]:
    """Mean, deviation and quartiles of all amounts."""
    moments = df.agg(F.avg("amount").alias("mean"), F.stddev_samp("amount").alias("std")).first()
    q1, q3 = table_quantiles(df, "amount", [0.25, 0.75], cfg.limits)
    return {"mean": moments["mean"], "std": moments["std"], "q1": q1, "q3": q3}


def add_amount_global(
    df: DataFrame, cfg: AuditConfig = DEFAULT, overall: dict[str, float | None] | None = None
) -> DataFrame:
    """log amount, global z-score and global Tukey flag.

    The four table-wide numbers are computed first (or given as ``overall``) and enter the
    plan as literals, so later steps do not drag their sub-plans along.
    """
    known = overall or overall_amounts(df, cfg)
    q1, q3 = known["q1"], known["q3"]
    z = F.lit(0.0)
    if known["std"] and known["std"] > 0:
        z = (F.col("amount") - known["mean"]) / known["std"]
    return df.withColumns(
        {
            "amount_log": F.log1p("amount"),
            "amount_zscore_global": z,
            "amount_iqr_flag_global": outside_fence(
                F.col("amount"), F.lit(q1), F.lit(q3), cfg.iqr_factor
            ),
        }
    )


def add_amount_user(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Amount against the user's own mean, deviation, quartiles and median."""
    amount, mean, std = F.col("amount"), F.col("user_amount_mean"), F.col("user_amount_std")
    median = F.col("_q")[1]
    return df.withColumns(
        {
            "amount_zscore_per_user": ratio_or(amount - mean, std, 0.0),
            "amount_vs_user_mean_ratio": ratio_or(amount, mean, 1.0),
            "amount_iqr_flag_per_user": outside_fence(
                amount, F.col("_q")[0], F.col("_q")[2], cfg.iqr_factor
            ),
            "user_typical_amount_median": median,
            "amount_deviation_from_user_median": ratio_or(amount, median, 1.0),
        }
    )


def add_profile(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Departures from the user's usual hour, source, expense type and pace."""
    hours = F.abs(F.col("hour_of_day") - F.col("user_hour_mean"))

    def unusual(column: str, typical: str) -> Column:
        return (~F.col(column).eqNullSafe(F.col(typical)) | F.col(typical).isNull()).cast("int")

    return df.withColumns(
        {
            "hour_deviation_from_user_norm": ratio_or(hours, F.col("user_hour_std"), 0.0),
            "is_unusual_source_for_user": unusual("source", "user_typical_source"),
            "is_unusual_type_for_user": unusual("expense_type", "user_typical_expense_type"),
            "user_tx_per_day": F.col("user_tx_count") / F.col("user_active_days"),
        }
    )


def add_daily_count(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Rows of the same user on the same calendar day."""
    day = F.to_date("created_at")
    dated = df.withColumn("_day", day)
    if largest_group(dated, ["user_id"]) <= cfg.limits.group_rows:
        counted = F.count("id").over(Window.partitionBy("user_id", "_day", "_scatter"))
        scatter = F.when(
            F.col("user_id").isNull(), F.pmod(F.xxhash64("id"), F.lit(cfg.limits.salt))
        ).otherwise(F.lit(0))
        out = dated.withColumn("_scatter", scatter).withColumn("tx_daily_count", counted)
        out = out.drop("_scatter").withColumn(
            "tx_daily_count", F.when(F.col("user_id").isNotNull(), F.col("tx_daily_count"))
        )
    else:
        counts = (
            dated.where(F.col("user_id").isNotNull())
            .groupBy("user_id", "_day")
            .agg(F.count("id").alias("tx_daily_count"))
        )
        largest = largest_group(dated, ["user_id", "_day"])
        out = attach(dated, counts, ["user_id", "_day"], largest, cfg.limits)
    return out.drop("_day").withColumn(
        "tx_daily_count_flag",
        F.coalesce((F.col("tx_daily_count") > cfg.max_daily).cast("int"), F.lit(0)),
    )


def add_rolling(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Seven-day look-back mean and deviation per user, and the spike flag."""
    timed = df.withColumn("_us", micros("created_at"))
    summed = lookback(timed, ["user_id"], "amount", cfg.rolling_days * DAY_US, False, cfg.limits)
    mean = F.col("_s") / F.col("_n")
    spread = F.when(F.col("_n") > 1, F.sqrt(F.col("_m2") / (F.col("_n") - 1))).when(
        F.col("_n") == 1, F.lit(0.0)
    )
    out = summed.withColumns({"user_rolling_mean_7d": mean, "user_rolling_std_7d": spread})
    out = out.withColumn(
        "amount_vs_rolling_mean_ratio",
        ratio_or(F.col("amount"), F.col("user_rolling_mean_7d"), 1.0),
    )
    return out.withColumn(
        "rolling_amount_spike_flag",
        (F.col("amount_vs_rolling_mean_ratio") > cfg.spike_ratio).cast("int"),
    ).drop("_us", "_n", "_s", "_m2")


def add_days_since_last(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    timed = df.withColumn("_us", micros("created_at"))
    linked = previous_value(timed, ["user_id"], ["_us", "id"], "_us", "_before", cfg.limits)
    gap = (F.col("_us") - F.col("_before")) / F.lit(float(DAY_US))
    return linked.withColumn("days_since_last_tx", F.coalesce(gap, F.lit(0.0))).drop(
        "_us", "_before"
    )


def supplier_statistics(df: DataFrame) -> DataFrame:
    own = df.where(F.col("supplier_id").isNotNull())
    return own.groupBy("supplier_id").agg(F.count("id").alias("_uses"), F.avg("amount").alias("_mean"))


def add_supplier(
    df: DataFrame, cfg: AuditConfig = DEFAULT, stats: DataFrame | None = None
) -> DataFrame:
    """Supplier usage, rarity and the amount against the supplier's mean.

    ``stats`` are the suppliers' figures where the rows are not all there are.
    """
    stats = supplier_statistics(df) if stats is None else stats
    largest = largest_group(df, ["supplier_id"])
    out = attach(df, stats, ["supplier_id"], largest, cfg.limits, dealt=True)
    rare = F.col("supplier_id").isNotNull() & (F.col("_uses") < cfg.rare_supplier)
    out = out.withColumns(
        {
            "supplier_usage_count": F.coalesce("_uses", F.lit(0)),
            "is_rare_supplier": F.coalesce(rare, F.lit(False)).cast("int"),
            "supplier_avg_amount": F.coalesce("_mean", "amount"),
        }
    ).drop("_uses", "_mean")
    return out.withColumn(
        "amount_vs_supplier_avg", ratio_or(F.col("amount"), F.col("supplier_avg_amount"), 1.0)
    )


def enrich(
    df: DataFrame,
    cfg: AuditConfig = DEFAULT,
    overall: dict[str, float | None] | None = None,
    suppliers: DataFrame | None = None,
) -> DataFrame:
    """All features of a cleaned, normalised ledger.

    The steps that group by user follow each other, so that in an ordinary
    layout they share one shuffle of the rows. ``overall`` and ``suppliers`` replace the
    figures of the table where ``df`` holds only the rows of some users.
    """
    out = add_temporal(df, cfg)
    out = add_amount_global(out, cfg, overall)
    out = attach_users(out, cfg)
    out = add_amount_user(out, cfg)
    out = add_daily_count(out, cfg)
    out = add_rolling(out, cfg)
    out = add_days_since_last(out, cfg)
    out = add_profile(out, cfg)
    out = add_supplier(out, cfg, suppliers)
    return out.drop("_q")
