"""Blending of the five scores and the decisions taken from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.config import DEFAULT, RESULT_COLUMNS, AuditConfig

SCORES = ["score_if", "score_lof", "score_dbscan", "score_rules", "score_fraud"]
PATTERN_COLUMNS = {
    "fraud_splitting": "fraud_splitting_score",
    "fraud_duplicate": "fraud_duplicate_score",
    "fraud_ghost_supplier": "fraud_ghost_supplier_score",
    "fraud_inflation": "fraud_inflation_score",
}
FLAGS = ["anomaly_if", "anomaly_lof", "anomaly_dbscan", "anomaly_rules", "is_fraud_pattern"]


def weights(cfg: AuditConfig = DEFAULT) -> dict[str, float]:
    return dict(
        zip(
            SCORES,
            [cfg.weight_if, cfg.weight_lof, cfg.weight_dbscan, cfg.weight_rules, cfg.weight_fraud],
        )
    )


def blended(cfg: AuditConfig = DEFAULT) -> Column:
    first, *rest = [F.col(c) * F.lit(w) for c, w in weights(cfg).items()]
    for term in rest:
        first = first + term
    return first


def high_scores(cfg: AuditConfig = DEFAULT) -> Column:
    """How many of the three detectors score above the consensus limit."""
    marks = [(F.col(c) > cfg.consensus_limit).cast("int") for c in SCORES[:3]]
    return marks[0] + marks[1] + marks[2]


def decide(df: DataFrame, cfg: AuditConfig = DEFAULT, policy: str = "batch") -> DataFrame:
    """Add ``_blend`` (unrounded), ``score_final`` and ``is_anomaly``.

    ``batch``: blend over the limit or a fraud pattern. ``online`` also accepts
    the rules' own verdict and two detectors in agreement.
    """
    if policy not in ("batch", "online"):
        raise ValueError(f"unknown policy {policy!r}")
    scored = df.withColumn("_blend", blended(cfg))
    hit = (F.col("_blend") >= cfg.final_limit) | (F.col("is_fraud_pattern") == 1)
    if policy == "online":
        hit = hit | (F.col("anomaly_rules") == 1) | (high_scores(cfg) >= 2)
    return scored.withColumns(
        {"score_final": F.round("_blend", 4), "is_anomaly": hit.cast("int")}
    )


def redecide(df: DataFrame, threshold: float) -> DataFrame:
    """Replace ``is_anomaly`` by: final score at or over ``threshold``, or a fraud pattern."""
    hit = (F.col("score_final") >= threshold) | (F.col("is_fraud_pattern") == 1)
    return df.withColumn("is_anomaly", hit.cast("int"))


def result(df: DataFrame, with_features: bool = False) -> DataFrame:
    """The published columns: identity, rounded scores, flags, patterns, explanation."""
    identity = [c for c in RESULT_COLUMNS if c in df.columns]
    rounded = [F.round(c, 4).alias(c) for c in SCORES]
    patterns = [F.round(c, 4).alias(n) for n, c in PATTERN_COLUMNS.items()]
    shown = [*identity, *SCORES, "score_final", *FLAGS, "is_anomaly", *PATTERN_COLUMNS]
    extra = []
    if with_features:
        extra = [c for c in df.columns if c not in {*shown, "_blend", "rules_triggered"}]
    return df.select(
        *identity, *rounded, "score_final", *FLAGS, "is_anomaly", *patterns, "rules_triggered", *extra
    )


def nested_result(df: DataFrame) -> DataFrame:
    """One record per transaction with nested score and pattern structs."""
    names = ["isolation_forest", "lof", "dbscan", "rules", "fraud"]
    scores = F.struct(*[F.col(c).alias(n) for n, c in zip(names, SCORES)])
    details = F.struct(*[F.col(c).alias(c.removeprefix("fraud_")) for c in PATTERN_COLUMNS])
    reasons = F.filter(F.split("rules_triggered", r" \| "), lambda p: p != "")
    return df.select(
        "id",
        "amount",
        "currency",
        "expense_type",
        "source",
        F.col("created_at").cast("string").alias("created_at"),
        "score_final",
        (F.col("is_anomaly") == 1).alias("is_anomaly"),
        scores.alias("scores"),
        details.alias("fraud_details"),
        reasons.alias("rules_triggered"),
        (F.col("is_fraud_pattern") == 1).alias("is_fraud_pattern"),
    )
