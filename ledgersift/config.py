"""Thresholds, weights and column lists shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass, field

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000

# Ledger columns and the subset holding timestamps.
LEDGER_COLUMNS = [
    "id", "company_id", "user_id", "shop_id", "supplier_id",
    "reference", "status", "currency", "amount", "source",
    "due_date", "paid_at", "items", "shipping", "billing",
    "metadata", "created_at", "updated_at", "deleted_at",
    "expense_type", "credit_code", "debit_code", "state",
]
TIMESTAMP_COLUMNS = ["due_date", "paid_at", "created_at", "updated_at", "deleted_at"]

# Identifying columns kept next to the scores.
RESULT_COLUMNS = [
    "id", "company_id", "user_id", "shop_id", "supplier_id",
    "reference", "amount", "currency", "source", "expense_type",
    "status", "created_at", "due_date", "paid_at",
]

# Spelling corrections applied to upper-cased source names.
SOURCE_FIXES = {
    "WATHSAPP": "WHATSAPP",
    "WHATSAP": "WHATSAPP",
    "WHATSAAP": "WHATSAPP",
    "WHASAPP": "WHATSAPP",
    "PAR WHATSAPP": "WHATSAPP",
    "TWITTER/X": "TWITTER",
    "APPEL": "PHONE",
    "VISITE EN MAGASIN": "BOUTIQUE",
    "PHYSIQUE": "BOUTIQUE",
    "SHOP": "BOUTIQUE",
    "VENTE DIRECT": "VENTE_DIRECTE",
    "COMMANDE DIRECT": "VENTE_DIRECTE",
    "COMMANDE DE MADAME": "VENTE_DIRECTE",
    "FACE": "FACEBOOK",
    "RÉSEAUX": "RESEAUX_SOCIAUX",
}

# The numeric columns that feed the detectors.
MATRIX_COLUMNS = [
    "amount",
    "amount_log",
    "amount_zscore_global",
    "amount_zscore_per_user",
    "amount_vs_user_mean_ratio",
    "amount_vs_rolling_mean_ratio",
    "amount_vs_supplier_avg",
    "hour_of_day",
    "day_of_week",
    "is_weekend",
    "is_outside_hours",
    "payment_delay_days",
    "user_tx_count",
    "user_tx_per_day",
    "tx_daily_count",
    "supplier_usage_count",
    "is_rare_supplier",
    "rolling_amount_spike_flag",
    "hour_deviation_from_user_norm",
    "amount_deviation_from_user_median",
    "is_unusual_source_for_user",
    "is_unusual_type_for_user",
    "days_since_last_tx",
    "status_encoded",
    "expense_type_encoded",
    "source_encoded",
    "currency_encoded",
]
CATEGORICAL_COLUMNS = ["status", "expense_type", "source", "currency"]

# The nine signals of the rank-correlation report.
CORRELATION_COLUMNS = [
    "amount_log", "amount_zscore_per_user", "amount_vs_user_mean_ratio",
    "amount_vs_rolling_mean_ratio", "tx_daily_count", "is_outside_hours",
    "is_weekend", "is_rare_supplier", "hour_deviation_from_user_norm",
]


@dataclass(frozen=True)
class ScaleLimits:
    """Bounds on what one task may be handed; beyond them operators switch plan.

    ``group_rows``: rows of one key a window or an aggregation buffer may hold.
    ``frame_rows``: rows one sliding time frame may hold (a sliding frame costs
    rows x frame length, so denser data use cumulative frames instead).
    ``frame_mean``: rows such a frame may hold on average over the rows.
    ``slices``: range partitions used once a key is too large for one task.
    ``salt``: pieces into which rows without a key are spread.
    ``round_rows``: vectors whose neighbours are searched or followed at a time.
    ``round_values``: numbers that such a round sends to the places it searches.
    ``task_rows``: whole ledger rows a task joins and orders, once there are more than a task per core.
    """

    group_rows: int = 2_000_000
    frame_rows: int = 4_096
    frame_mean: int = 256
    slices: int = 0          # 0: the session's shuffle partition count
    salt: int = 65_536
    broadcast_rows: int = 100_000
    task_rows: int = 131_072
    round_rows: int = 250_000
    round_values: int = 60_000_000


@dataclass(frozen=True)
class AuditConfig:
    """Every tunable of the audit. Defaults equal the published parameters."""

    zscore_limit: float = 3.0
    iqr_factor: float = 1.5
    business_start: int = 7
    business_end: int = 20
    max_daily: int = 10
    rare_supplier: int = 3
    spike_ratio: float = 2.0
    rolling_days: int = 7

    round_minimum: float = 100_000
    round_multiple: float = 10_000
    rules_limit: float = 0.30

    splitting_hours: int = 24
    duplicate_hours: int = 48
    duplicate_tolerance: float = 0.01
    inflation_min_tx: int = 5
    inflation_tail: int = 10
    inflation_rho: float = 0.70
    fraud_quantile: float = 0.60
    fraud_fallback: float = 0.40

    trees: int = 200
    tree_sample: int = 256
    seed: int = 42
    contamination: float = 0.05
    lof_neighbours: int = 20
    dbscan_min_samples: int = 5
    dbscan_min_cluster: int = 3
    dbscan_min_eps: float = 0.5

    weight_if: float = 0.25
    weight_lof: float = 0.20
    weight_dbscan: float = 0.15
    weight_rules: float = 0.20
    weight_fraud: float = 0.20
    final_limit: float = 0.50
    consensus_limit: float = 0.70

    limits: ScaleLimits = field(default_factory=ScaleLimits)


DEFAULT = AuditConfig()
