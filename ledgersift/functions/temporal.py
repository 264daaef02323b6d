"""Column expressions over timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgersift.config import DAY_US, AuditConfig


def micros(column: str) -> Column:
    """Microseconds from 1970-01-01 to a local timestamp, whatever the session time zone."""
    since = F.col(column).cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    days, hours, minutes, seconds = (
        F.extract(F.lit(unit), since) for unit in ("DAY", "HOUR", "MINUTE", "SECOND")
    )
    whole = (days.cast("long") * 24 + hours) * 60 + minutes
    return whole * 60_000_000 + (seconds * 1_000_000).cast("long")


def weekday(column: str) -> Column:
    """Monday is 0."""
    return F.weekday(F.col(column)).cast("int")


def temporal_columns(cfg: AuditConfig) -> dict[str, Column]:
    """The calendar features of one ledger row."""
    hour = F.hour("created_at")
    outside = (hour < cfg.business_start) | (hour >= cfg.business_end)
    delay = (micros("paid_at") - micros("created_at")) / F.lit(float(DAY_US))
    return {
        "hour_of_day": hour,
        "day_of_week": weekday("created_at"),
        "is_weekend": weekday("created_at").isin(5, 6).cast("int"),
        "month": F.month("created_at"),
        "year": F.year("created_at"),
        "is_outside_hours": outside.cast("int"),
        "payment_delay_days": F.round(delay, 2),
        "is_future_due": F.coalesce(F.col("due_date") > F.col("created_at"), F.lit(False)).cast(
            "int"
        ),
    }
