"""Weighted compliance rules, held as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.config import DEFAULT, AuditConfig

SEPARATOR = " | "


@dataclass(frozen=True)
class Rule:
    name: str
    predicate: str
    weight: float
    description: str


def rule_set(cfg: AuditConfig = DEFAULT) -> list[Rule]:
    """The eight rules. Names, weights and (French) descriptions."""
    return [
        Rule(
            "rule_high_amount_global",
            f"amount_zscore_global > {cfg.zscore_limit}",
            0.25,
            f"Montant avec z-score global > {cfg.zscore_limit}",
        ),
        Rule(
            "rule_high_amount_vs_user",
            "amount_iqr_flag_per_user = 1",
            0.20,
            "Montant en dehors du IQR par utilisateur",
        ),
        Rule("rule_weekend", "is_weekend = 1", 0.10, "Transaction le week-end"),
        Rule(
            "rule_outside_hours",
            "is_outside_hours = 1",
            0.10,
            "Transaction hors heures de bureau",
        ),
        Rule(
            "rule_rare_supplier",
            "is_rare_supplier = 1",
            0.10,
            f"Fournisseur utilisé moins de {cfg.rare_supplier} fois",
        ),
        Rule(
            "rule_rolling_spike",
            "rolling_amount_spike_flag = 1",
            0.20,
            f"Montant x{cfg.spike_ratio:g}+ vs moyenne glissante {cfg.rolling_days} jours",
        ),
        Rule(
            "rule_high_daily_freq",
            f"tx_daily_count > {cfg.max_daily}",
            0.10,
            f"Plus de {cfg.max_daily} transactions le même jour",
        ),
        Rule(
            "rule_round_amount",
            f"amount >= {cfg.round_minimum:.0f}D and amount % {cfg.round_multiple:.0f}D = 0",
            0.05,
            f"Montant round ≥ {cfg.round_minimum:,.0f} XAF",
        ),
    ]


def rule_names(cfg: AuditConfig = DEFAULT) -> list[str]:
    return [r.name for r in rule_set(cfg)]


def _fired(rule: Rule) -> Column:
    return F.coalesce(F.expr(rule.predicate), F.lit(False)).cast("int")


def apply_rules(
    df: DataFrame, cfg: AuditConfig = DEFAULT, only: list[str] | None = None
) -> DataFrame:
    """Add one flag per rule, ``score_rules``, ``anomaly_rules`` and ``rules_triggered``.

    A predicate over a missing value does not fire. ``only`` limits which rules
    may fire; the score is always relative to the weight of all eight.
    """
    rules = rule_set(cfg)
    flags = {
        r.name: (_fired(r) if only is None or r.name in only else F.lit(0)) for r in rules
    }
    whole = sum(r.weight for r in rules)
    score = sum((F.col(r.name) * F.lit(r.weight) for r in rules), F.lit(0.0)) / F.lit(whole)
    return (
        df.withColumns(flags)
        .withColumns({"score_rules": score, "rules_triggered": explanation(cfg)})
        .withColumn("anomaly_rules", (F.col("score_rules") >= cfg.rules_limit).cast("int"))
    )


def explanation(cfg: AuditConfig = DEFAULT) -> Column:
    """Descriptions of the fired rules in rule order, joined by a spaced pipe."""
    texts = [F.when(F.col(r.name) == 1, F.lit(r.description)) for r in rule_set(cfg)]
    return F.array_join(F.array_compact(F.array(*texts)), SEPARATOR)


# Short labels shown for rule descriptions, by their opening words.
SHORT_LABELS = {
    "Montant avec z-score": "Amount far above all others",
    "Montant en dehors": "Amount unusual for this user",
    "Transaction le week-end": "Weekend",
    "Transaction hors heures": "Outside business hours",
    "Fournisseur utilisé": "Rare supplier",
    "Montant x": "Sudden rise over recent days",
    "Plus de": "Many transactions on one day",
    "Montant round": "Suspiciously round amount",
}


def short_reasons(column: str = "rules_triggered", limit: int = 3) -> Column:
    """Split an explanation back into at most ``limit`` short labels."""
    parts = F.filter(F.split(F.col(column), r" \| "), lambda p: p != "")

    def label(text: Column) -> Column:
        choice = F.lit(None).cast("string")
        for start, short in SHORT_LABELS.items():
            choice = F.coalesce(choice, F.when(text.startswith(start), F.lit(short)))
        return F.coalesce(choice, text)

    return F.slice(F.transform(parts, label), 1, limit)
