"""The flagship query: cleaned ledger, amount tests per user, rules, top violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.operators import features, rules
from ledgersift.operators.clean import clean, normalize
from ledgersift.session import materialize
from ledgersift.sources.fixture import raw_ledger

# Rules that need neither suppliers nor look-back windows.
SIMPLE = [
    "rule_high_amount_global",
    "rule_high_amount_vs_user",
    "rule_weekend",
    "rule_outside_hours",
    "rule_round_amount",
]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    ledger = materialize(normalize(clean(raw_ledger(spark, folder))))
    rows = features.add_amount_global(features.add_temporal(ledger))
    rows = features.add_amount_user(features.attach_users(rows))
    scored = rules.apply_rules(rows, only=SIMPLE)
    return (
        scored.orderBy(F.desc("score_rules"), F.desc("amount"), "id")
        .limit(20)
        .select(
            "id", "user_id", "amount", F.round("score_rules", 6).alias("score_rules"),
            "rules_triggered",
        )
    )
