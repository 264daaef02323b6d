"""Column expressions over amounts, scores and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_or(numerator: Column, denominator: Column, fallback: float) -> Column:
    """numerator / denominator where the denominator is positive, else ``fallback``."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(fallback))


def is_round(amount: Column, minimum: float, multiple: float) -> Column:
    return (amount >= minimum) & (amount % multiple == 0)


def first_digit(amount: Column) -> Column:
    """First non-zero digit of a positive amount, by arithmetic rather than by its text."""
    power = F.floor(F.log10(amount))
    lead = F.floor(amount / F.pow(F.lit(10.0), power.cast("double"))).cast("int")
    return F.when(lead > 9, 1).when(lead < 1, 9).otherwise(lead)


def money_text(amount: Column) -> Column:
    """Short text for an amount: billions, millions, grouped thousands or two decimals."""
    size = F.abs(amount)
    return (
        F.when(amount.isNull() | F.isnan(amount), F.lit("0 XAF"))
        .when(size >= 1e9, F.format_string("%.2f Md XAF", amount / 1e9))
        .when(size >= 1e6, F.format_string("%.1f M XAF", amount / 1e6))
        .when(
            size >= 1e3,
            F.concat(F.replace(F.format_number(amount, 0), F.lit(","), F.lit(" ")), F.lit(" XAF")),
        )
        .otherwise(F.format_string("%.2f XAF", amount))
    )


def verdict(score: Column, anomaly: Column) -> Column:
    return F.when(anomaly == 1, "anomaly").when(score >= 0.35, "watch").otherwise("clean")


def fraud_level(score: Column) -> Column:
    return F.when(score >= 0.5, "high").when(score >= 0.2, "medium").otherwise("low")


def sensitivity_mode(threshold: Column) -> Column:
    return (
        F.when(threshold < 0.20, "vigilant").when(threshold <= 0.35, "balanced").otherwise("strict")
    )


def clip(column: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(column, F.lit(low)), F.lit(high))


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
