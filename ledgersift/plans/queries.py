"""The registered queries: every operator of the audit over the supplied tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.config import DEFAULT, HOUR_US, LEDGER_COLUMNS, MATRIX_COLUMNS, AuditConfig, ScaleLimits
from ledgersift.functions import scalar
from ledgersift.functions.temporal import micros
from ledgersift.operators import anonymize as privacy
from ledgersift.operators import clean as cleaning
from ledgersift.operators import density, ensemble, features, iforest, knn, matrix, patterns
from ledgersift.operators import reports, rules
from ledgersift.operators.quantiles import column_quantiles
from ledgersift.operators.rolling import lookback
from ledgersift.plans import audit as pipeline
from ledgersift.plans.incremental import LedgerState
from ledgersift.session import materialize, open_files, shared_folder
from ledgersift.sources.dump import read_dump, write_dump
from ledgersift.sources.files import read_csv_ledger, write_report
from ledgersift.sources.fixture import order_ledger, raw_ledger
from ledgersift.streaming.behavior import write_behavior
from ledgersift.streaming.microbatch import latest_top

# Columns compared for arrivals, with their digits.
INCREMENTAL = {
    "amount_zscore_global": 6, "amount_iqr_flag_global": 0, "amount_zscore_per_user": 6, "amount_vs_user_mean_ratio": 6,
    "amount_iqr_flag_per_user": 0, "amount_deviation_from_user_median": 6, "user_tx_count": 0, "user_tx_per_day": 6,
    "tx_daily_count": 0, "user_rolling_mean_7d": 2, "user_rolling_std_7d": 2, "amount_vs_rolling_mean_ratio": 6,
    "days_since_last_tx": 6, "hour_deviation_from_user_norm": 6, "is_unusual_source_for_user": 0,
    "is_unusual_type_for_user": 0, "supplier_usage_count": 0, "is_rare_supplier": 0, "amount_vs_supplier_avg": 6,
    "status_encoded": 0, "expense_type_encoded": 0, "source_encoded": 0, "currency_encoded": 0,
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_staged: dict[tuple, DataFrame] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def staged(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table that several queries read: built from the input once per session, then read."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _staged:
        _staged[key] = materialize(STAGES[name](spark, folder))
    return _staged[key]


def tidy(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned, normalised ledger, lazily."""
    return cleaning.normalize(cleaning.clean(raw_ledger(spark, folder)))


def base(spark: SparkSession, folder: str) -> DataFrame:
    return staged(spark, folder, "base")


def feats(spark: SparkSession, folder: str) -> DataFrame:
    return staged(spark, folder, "features")


def _build_standin(spark: SparkSession, folder: str) -> DataFrame:
    """Rules, patterns and decision with stand-in detector scores taken from the event number.

    The stand-ins make everything after the detectors exactly checkable.
    """
    number = F.col("event_id")
    fake = {
        "score_if": number % 101 / 100.0,
        "score_lof": number * 7 % 101 / 100.0,
        "score_dbscan": number * 13 % 101 / 100.0,
    }
    flags = {
        "anomaly_if": (F.col("score_if") > 0.95).cast("int"),
        "anomaly_lof": (F.col("score_lof") > 0.95).cast("int"),
        "anomaly_dbscan": (F.col("score_dbscan") > 0.95).cast("int"),
    }
    ruled = rules.apply_rules(feats(spark, folder))
    judged = patterns.add_patterns(ruled, base=base(spark, folder))
    scored = judged.withColumns(fake).withColumns(flags)
    scored = scored.withColumn("score_fraud", F.col("fraud_score_combined"))
    return ensemble.result(ensemble.decide(scored), with_features=True)


def _build_vectors(spark: SparkSession, folder: str) -> DataFrame:
    imputed = matrix.impute(feats(spark, folder))
    params = matrix.scale_parameters(imputed, MATRIX_COLUMNS)
    return matrix.vectors(matrix.standardize(imputed, params), MATRIX_COLUMNS)


STAGES: dict[str, Query] = {
    "base": tidy,
    "features": lambda spark, folder: pipeline.featured(base(spark, folder)),
    "standin": _build_standin,
    "vectors": _build_vectors,
}


def standin(spark: SparkSession, folder: str) -> DataFrame:
    return staged(spark, folder, "standin")


# ---------------------------------------------------------------- cleaning


@query
def clean_funnel(spark, d):
    return cleaning.attrition(raw_ledger(spark, d))


@query
def normalize_text(spark, d):
    return tidy(spark, d).select("id", "expense_type", "source", "currency", "amount")


@query
def normalize_cardinality(spark, d):
    clean = cleaning.clean(raw_ledger(spark, d))
    return cleaning.cardinalities(clean, cleaning.normalize(clean))


@query
def input_validation(spark, d):
    raw = raw_ledger(spark, d).withColumn(
        "created_at", F.when(F.col("event_id") % 89 != 5, F.col("created_at"))
    )
    checked = cleaning.validate_input(raw)
    return checked.groupBy("rejected", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def null_audit(spark, d):
    columns = [c for c in LEDGER_COLUMNS if c not in
               ("items", "shipping", "metadata", "credit_code", "debit_code", "state")]
    return cleaning.null_audit(raw_ledger(spark, d).select(*columns)).drop("column_type")


@query
def entity_counts(spark, d):
    ids = ["company_id", "user_id", "shop_id", "supplier_id"]
    return cleaning.entity_counts(raw_ledger(spark, d), ids)


# ---------------------------------------------------------------- features


@query
def temporal_features(spark, d):
    out = features.add_temporal(tidy(spark, d))
    return out.select(
        "id", "hour_of_day", "day_of_week", "is_weekend", "month", "year",
        "is_outside_hours", "payment_delay_days", "is_future_due",
    )


@query
def amount_zscore_global(spark, d):
    out = features.add_amount_global(base(spark, d))
    return out.select(
        "id",
        F.round("amount_log", 6).alias("amount_log"),
        F.round("amount_zscore_global", 6).alias("amount_zscore_global"),
    )


@query
def iqr_flags(spark, d, cfg: AuditConfig = DEFAULT):
    b = base(spark, d)
    out = features.add_amount_user(features.attach_users(features.add_amount_global(b, cfg), cfg), cfg)
    return out.select("id", "amount_iqr_flag_global", "amount_iqr_flag_per_user")


@query
def amount_zscore_user(spark, d):
    out = features.add_amount_user(features.attach_users(base(spark, d)))
    return out.select(
        "id",
        F.round("amount_zscore_per_user", 6).alias("amount_zscore_per_user"),
        F.round("amount_vs_user_mean_ratio", 6).alias("amount_vs_user_mean_ratio"),
    )


@query
def user_median_ratio(spark, d):
    out = features.add_amount_user(features.attach_users(base(spark, d)))
    return out.select(
        "id",
        "user_typical_amount_median",
        F.round("amount_deviation_from_user_median", 6).alias("amount_deviation_from_user_median"),
    )


@query
def user_behavior(spark, d):
    stats = features.user_statistics(base(spark, d))
    return stats.select(
        "user_id", "user_tx_count", "user_active_days",
        F.round(F.col("user_tx_count") / F.col("user_active_days"), 6).alias("user_tx_per_day"),
        F.round("user_amount_mean", 2).alias("user_amount_mean"),
        F.round("user_amount_std", 2).alias("user_amount_std"),
    )


@query
def daily_frequency(spark, d):
    cfg = AuditConfig(max_daily=5)
    out = features.add_daily_count(base(spark, d), cfg)
    return out.select("id", "tx_daily_count", "tx_daily_count_flag")


@query
def rolling_7d(spark, d, cfg: AuditConfig = DEFAULT):
    out = features.add_rolling(base(spark, d), cfg)
    return out.select(
        "id",
        F.round("user_rolling_mean_7d", 2).alias("user_rolling_mean_7d"),
        F.round("user_rolling_std_7d", 2).alias("user_rolling_std_7d"),
        F.round("amount_vs_rolling_mean_ratio", 6).alias("amount_vs_rolling_mean_ratio"),
        "rolling_amount_spike_flag",
    )


@query
def rolling_ties(spark, d):
    """Thirty-day look-back on a ledger whose timestamps repeat."""
    orders = order_ledger(spark, d).withColumn("_us", micros("created_at"))
    out = lookback(orders, ["user_id"], "amount", 30 * 24 * HOUR_US, False, DEFAULT.limits)
    return out.select("id", F.col("_n").cast("long").alias("n"), F.round("_s", 2).alias("s"))


@query
def days_since_last(spark, d, cfg: AuditConfig = DEFAULT):
    out = features.add_days_since_last(base(spark, d), cfg)
    return out.select("id", F.round("days_since_last_tx", 6).alias("days_since_last_tx"))


@query
def days_since_last_ties(spark, d):
    out = features.add_days_since_last(order_ledger(spark, d))
    return out.select("id", F.round("days_since_last_tx", 6).alias("days_since_last_tx"))


@query
def user_profile_modes(spark, d, cfg: AuditConfig = DEFAULT):
    out = features.add_profile(features.attach_users(features.add_temporal(base(spark, d)), cfg), cfg)
    return out.select(
        "id", "user_typical_source", "user_typical_expense_type",
        "is_unusual_source_for_user", "is_unusual_type_for_user",
    )


@query
def hour_deviation(spark, d):
    out = features.add_profile(features.attach_users(features.add_temporal(base(spark, d))))
    return out.select(
        "id", F.round("hour_deviation_from_user_norm", 6).alias("hour_deviation_from_user_norm")
    )


@query
def supplier_features(spark, d):
    out = features.add_supplier(base(spark, d))
    return out.select(
        "id", "supplier_usage_count", "is_rare_supplier",
        F.round("supplier_avg_amount", 4).alias("supplier_avg_amount"),
        F.round("amount_vs_supplier_avg", 6).alias("amount_vs_supplier_avg"),
    )


@query
def encode_categoricals(spark, d):
    b = base(spark, d)
    return matrix.encode(b).select(
        "id", "status_encoded", "expense_type_encoded", "source_encoded", "currency_encoded"
    )


@query
def ml_matrix(spark, d):
    imputed = matrix.impute(feats(spark, d))
    return imputed.select("id", *[F.round(c, 5).alias(c) for c in MATRIX_COLUMNS])


@query
def matrix_quantiles(spark, d):
    """Quantiles of all matrix columns together, by histograms."""
    probs = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
    found = column_quantiles(feats(spark, d), {c: list(probs.values()) for c in MATRIX_COLUMNS})
    out = spark.createDataFrame([(c, *found[c]) for c in MATRIX_COLUMNS], f"name string, {', '.join(f'{q} double' for q in probs)}")
    return out.select("name", *[F.round(q, 6).alias(q) for q in probs])


@query
def standardized_matrix(spark, d):
    imputed = matrix.impute(feats(spark, d))
    scaled = matrix.standardize(imputed, matrix.scale_parameters(imputed, MATRIX_COLUMNS))
    return scaled.select("id", *[F.round(c, 5).alias(c) for c in MATRIX_COLUMNS])


@query
def align_columns(spark, d):
    """A matrix lacking trained columns and holding unknown ones, brought into shape."""
    partial = base(spark, d).select("id", "amount", "event_id")
    return matrix.align(partial, ["amount", "amount_log", "hour_of_day"])


@query
def scalar_functions(spark, d):
    """Digit, rounding test, clipped ratio, money text and tiers of each row."""
    amount = F.col("amount")
    # A prime divisor keeps the rounded values clear of ties.
    ratio = amount / 999_983.0
    return tidy(spark, d).select(
        "id",
        scalar.first_digit(amount).cast("int").alias("first_digit"),
        scalar.is_round(amount, 100_000, 10_000).cast("int").alias("is_round"),
        scalar.clip(ratio, 0.1, 2.0).alias("clipped"),
        scalar.verdict(F.least(ratio, F.lit(1.0)), (ratio > 0.9).cast("int")).alias("verdict"),
        scalar.fraud_level(F.least(ratio, F.lit(1.0))).alias("fraud_level"),
        scalar.sensitivity_mode(F.least(ratio, F.lit(1.0))).alias("sensitivity_mode"),
        F.round(F.least(ratio, F.lit(1.0)) * 100, 1).alias("risk_index_100"),
        scalar.money_text(amount + 0.37).alias("money_text"),
    )


# ---------------------------------------------------------------- rules and patterns


@query
def rules_score(spark, d):
    out = rules.apply_rules(feats(spark, d))
    return out.select(
        "id", *rules.rule_names(), F.round("score_rules", 6).alias("score_rules"), "anomaly_rules"
    )


@query
def rule_explanations(spark, d):
    out = rules.apply_rules(feats(spark, d))
    return out.select("id", "rules_triggered")


@query
def rule_short_reasons(spark, d):
    out = rules.apply_rules(feats(spark, d))
    return out.select("id", F.array_join(rules.short_reasons(), "; ").alias("reasons"))


@query
def rule_rates(spark, d):
    return reports.rule_rates(rules.apply_rules(feats(spark, d)))


def _pattern(name):
    def run(spark, d, cfg: AuditConfig = DEFAULT):
        hits = patterns.PATTERNS[name](base(spark, d), cfg)
        return hits.select("id", F.round(name, 6).alias(name))

    return run


QUERIES["fraud_splitting"] = _pattern("fraud_splitting_score")
QUERIES["fraud_duplicates"] = _pattern("fraud_duplicate_score")
QUERIES["fraud_ghost_supplier"] = _pattern("fraud_ghost_supplier_score")
QUERIES["fraud_inflation"] = _pattern("fraud_inflation_score")


@query
def fraud_splitting_dates(spark, d):
    """Splitting over order lines, whose timestamps repeat: five days, price level 1."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    orders = spark.read.parquet(f"{d}/orders.parquet")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    rows = joined.select(
        F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate", "l_tax", "l_discount", "l_extendedprice").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_extendedprice").alias("amount"),
        micros("o_orderdate").alias("_us"),
    )
    found = lookback(rows, ["user_id", "supplier_id"], "amount", 5 * 24 * HOUR_US, True, DEFAULT.limits)
    return found.where(F.col("_n") >= 2).select(
        "id", F.col("_n").cast("long").alias("n"), F.round("_s", 2).alias("s")
    )


@query
def fraud_combined(spark, d):
    out = patterns.add_patterns(base(spark, d))
    return out.select(
        "id", F.round("fraud_score_combined", 6).alias("fraud_score_combined"), "is_fraud_pattern"
    )


# ---------------------------------------------------------------- decisions and reports


@query
def decision_batch(spark, d):
    return standin(spark, d).select("id", "score_final", "is_anomaly")


@query
def decision_online(spark, d):
    rows = standin(spark, d).withColumn("fraud_score_combined", F.col("score_fraud"))
    return ensemble.decide(rows, policy="online").select("id", "is_anomaly")


@query
def redecision(spark, d):
    """Exposure under the three preset alert thresholds."""
    parts = [
        reports.exposure(ensemble.redecide(standin(spark, d), t)).withColumn("threshold", F.lit(t))
        for t in (0.15, 0.25, 0.40)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def nested_results(spark, d):
    out = ensemble.nested_result(standin(spark, d))
    return out.select(
        "id",
        F.col("scores.rules").alias("rules"),
        F.col("fraud_details.duplicate").alias("duplicate"),
        F.size("rules_triggered").alias("n_rules"),
        "is_fraud_pattern",
    )


@query
def top_anomalies(spark, d):
    return reports.top_anomalies(standin(spark, d), 20).select("id", "amount", "score_final")


@query
def recent_alerts(spark, d):
    return reports.recent_alerts(standin(spark, d)).select("id", "created_at", "score_final")


@query
def audit_summary(spark, d):
    return reports.audit_summary(standin(spark, d))


@query
def exposure_report(spark, d):
    return reports.exposure(standin(spark, d))


@query
def batch_summary(spark, d):
    return reports.batch_summary(standin(spark, d))


@query
def top_categories(spark, d):
    return reports.top_groups(standin(spark, d), "expense_type", 10)


@query
def top_users(spark, d):
    return reports.top_groups(standin(spark, d), "user_id", 10)


@query
def top_sources(spark, d):
    return reports.top_groups(standin(spark, d), "source", 8)


@query
def monthly_trend(spark, d):
    return reports.monthly_trend(standin(spark, d))


@query
def daily_volume(spark, d):
    return reports.daily_volume(standin(spark, d))


@query
def hour_profile(spark, d):
    return reports.filled_profile(features.add_temporal(tidy(spark, d)), "hour_of_day", 24)


@query
def weekday_profile(spark, d):
    return reports.filled_profile(features.add_temporal(tidy(spark, d)), "day_of_week", 7)


@query
def describe_amount(spark, d):
    out = reports.describe_amounts(base(spark, d))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query
def value_counts(spark, d):
    return reports.value_counts(tidy(spark, d), "source")


@query
def sensitivity_counts(spark, d):
    return reports.sensitivity(feats(spark, d))


@query
def behavior_breaks(spark, d):
    return reports.rates(feats(spark, d), reports.BREAK_FLAGS, "signal")


@query
def break_classes(spark, d):
    cfg = AuditConfig(max_daily=3)
    return reports.break_classes(feats(spark, d), cfg)


@query
def supplier_rarity(spark, d):
    return reports.supplier_rarity(feats(spark, d))


@query
def rule_top20_matrix(spark, d):
    return reports.rule_top_matrix(standin(spark, d))


@query
def threshold_sweep(spark, d):
    return reports.threshold_sweep(standin(spark, d))


@query
def contribution(spark, d):
    return reports.contribution(standin(spark, d))


@query
def detector_means(spark, d):
    return reports.detector_means(standin(spark, d))


@query
def consensus(spark, d):
    return reports.consensus(standin(spark, d))


@query
def pattern_counts(spark, d):
    s = standin(spark, d)
    return reports.pattern_counts(s).withColumn("over", F.lit(0.0)).unionByName(
        reports.pattern_counts(s, 0.4).withColumn("over", F.lit(0.4))
    )


@query
def category_benchmark(spark, d):
    b = base(spark, d)
    bench = reports.category_benchmark(b)
    ratio = F.col("amount") / F.col("median_amount")
    band = F.when(ratio > 2, "high").when(ratio < 0.2, "low").otherwise("usual")
    # One row per expense type; the optimizer broadcasts it by its measured size.
    return b.join(bench, "expense_type").select(
        "id", "median_amount", F.round("mean_amount", 4).alias("mean_amount"), "max_amount",
        F.round(ratio, 6).alias("ratio"), band.alias("band"),
    )


@query
def search_filter(spark, d):
    found = reports.search(standin(spark, d), "usr_0000", "raw_materials", "suspicious")
    return found.orderBy(F.desc("score_final"), "id").select("id", "user_id", "score_final")


@query
def category_choices(spark, d):
    return reports.categories(tidy(spark, d))


@query
def amount_histogram(spark, d):
    s = standin(spark, d)
    out = reports.histogram(s, F.log1p("amount"), 0.0, 0.5, 40, "is_anomaly")
    return out.withColumn("density", F.round("density", 6))


@query
def score_histogram(spark, d):
    out = reports.histogram(standin(spark, d), F.col("score_final"), 0.0, 0.05, 20, "is_fraud_pattern")
    return out.select("is_fraud_pattern", "bin", "n", F.round("density", 6).alias("density"))


@query
def median_ratio_histogram(spark, d):
    ratio = scalar.clip(F.col("amount_deviation_from_user_median"), 0.0, 20.0)
    out = reports.histogram(standin(spark, d), ratio, 0.0, 0.4, 50, "is_anomaly")
    return out.select("is_anomaly", "bin", "n")


@query
def amount_box(spark, d):
    """Quartiles of the log amounts by fraud class, from the two classes appended."""
    s = standin(spark, d).select("is_fraud_pattern", F.log1p("amount").alias("v"))
    both = reports.both_classes(s, "is_fraud_pattern", ("normal", "fraud"))
    out = reports.box_stats(both, "class", "v")
    return out.select("class", *[F.round(c, 6).alias(c) for c in out.columns if c != "class"])


@query
def spearman_matrix(spark, d):
    imputed = matrix.impute(feats(spark, d))
    return reports.spearman(imputed).withColumn("rho", F.round("rho", 6))


@query
def gini(spark, d, cfg: AuditConfig = DEFAULT):
    return reports.gini(base(spark, d), cfg=cfg).select(F.round("gini", 8).alias("gini"))


@query
def benford(spark, d):
    out = reports.benford(tidy(spark, d))
    names = ["observed_pct", "expected_pct", "chi2", "p_value"]
    return out.select("digit", "n", *[F.round(c, 6).alias(c) for c in names])


@query
def sample_rows(spark, d):
    return reports.sample_rows(base(spark, d), 100).select("id", "amount")


# ---------------------------------------------------------------- new rows and privacy


def _split_arrivals(spark, d):
    """Earlier rows as history; the latest events as arrivals, some reusing a known id."""
    raw = raw_ledger(spark, d)
    arriving = F.col("event_id") % 40 == 39
    history = raw.where(~arriving)
    again = (F.col("event_id") % 400 == 39) & arriving
    reused = F.concat(F.lit("EXP_"), F.lpad((F.col("event_id") - 1).cast("string"), 7, "0"))
    new = raw.where(arriving).withColumn("id", F.when(again, reused).otherwise(F.col("id")))
    return history, new


@query
def score_new_rejected(spark, d):
    """Every arrival that cannot be scored, with the reason: repeated ids and deleted rows included."""
    _, new = _split_arrivals(spark, d)
    twice = new.unionByName(new.withColumn("updated_at", F.col("updated_at") + F.expr("INTERVAL 1 HOUR")))
    return pipeline.split_scorable(twice)[1].select("id", "updated_at", "rejected")


@query
def incremental_features(spark, d):
    """Features of the second half of the arrivals, from the saved state with the first half merged in."""
    history, new = _split_arrivals(spark, d)
    state = LedgerState.build(history, f"{shared_folder(spark)}/ledgersift/{uuid.uuid4().hex}", 16)
    state.apply(state.change(new.where("event_id % 80 = 39")))
    out = state.features(state.change(new.where("event_id % 80 = 79")))
    return out.select(
        "id", *[F.round(c, digits).alias(c) for c, digits in INCREMENTAL.items()],
        "user_typical_source", "user_typical_expense_type",
    )


@query
def union_new_history(spark, d):
    history, new = _split_arrivals(spark, d)
    accepted, _ = pipeline.split_new(new)
    return pipeline.with_history(history, accepted).groupBy("is_new").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("id").alias("ids"),
        F.sum("amount").alias("amount"),
    )


@query
def pseudonymize(spark, d, cfg: AuditConfig = DEFAULT):
    out = privacy.pseudonymize(raw_ledger(spark, d), cfg=cfg)
    return out.select("id", "company_id", "user_id", "shop_id", "supplier_id", "reference", "amount")


@query
def pseudonyms_second_export(spark, d):
    """An export of every row with the aliases that an earlier export of some rows has given."""
    raw = raw_ledger(spark, d)
    first = materialize(privacy.alias_dictionary(raw.where("event_id % 3 = 1 AND user_id < 'USR_00060'")))
    out = privacy.pseudonymize(raw, dictionary=materialize(privacy.alias_dictionary(raw, first)))
    return out.select("id", "company_id", "user_id", "shop_id", "supplier_id", "amount")


@query
def neutral_documents(spark, d):
    """What is left of metadata, items and shipping in a shared copy."""
    out = privacy.blank_documents(_full_ledger(spark, d))
    return out.groupBy("metadata", "items", "shipping").agg(F.count(F.lit(1)).alias("n"))


@query
def schema_drift(spark, d):
    """The events table as it stands against the ledger's columns."""
    return cleaning.schema_drift(spark.read.parquet(f"{d}/events.parquet"))


@query
def billing_sanitize(spark, d):
    raw = raw_ledger(spark, d)
    out = privacy.sanitize_billing(raw, ("cash",))
    return out.select("id", "updated_at", "billing")


@query
def date_shift(spark, d):
    out = privacy.shift_dates(raw_ledger(spark, d))
    return out.select("id", "created_at", "due_date", "paid_at", "updated_at", "deleted_at")


@query
def anonymized_features(spark, d):
    """Calendar features survive pseudonyms and the shift; counted over the shared copy."""
    shared = privacy.anonymize(raw_ledger(spark, d))
    out = features.add_temporal(cleaning.clean(shared, ["updated_at", "id"]))
    return out.groupBy("day_of_week", "is_outside_hours").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")
    )


def _full_ledger(spark, d):
    none = F.lit(None).cast("string")
    extra = {
        "items": none, "shipping": none, "metadata": F.lit('{"note": "it\'s \\\\ fine, ok"}'),
        "credit_code": none, "debit_code": F.lit("D-1"), "state": F.lit(1).cast("long"),
    }
    return raw_ledger(spark, d).withColumns(extra).select(*LEDGER_COLUMNS)


@query
def sql_dump_roundtrip(spark, d):
    """Write the ledger as INSERT statements and load it again."""
    path = f"{shared_folder(spark)}/ledgersift/dump-{uuid.uuid4().hex}"
    write_dump(_full_ledger(spark, d), path)
    rows, _ = read_dump(spark, path)
    return rows.select(
        "id", "user_id", "supplier_id", "amount", "currency", "created_at", "deleted_at",
        "billing", "metadata", "state",
    )


@query
def sql_dump_encoding(spark, d):
    """A dump in another encoding than UTF-8."""
    path = f"{shared_folder(spark)}/ledgersift/dump-{uuid.uuid4().hex}"
    accents = F.concat(F.lit("d\u00e9p\u00f4t \u00e0 "), F.col("shop_id"))
    write_dump(_full_ledger(spark, d).withColumn("metadata", accents), path, encoding="ISO-8859-1")
    rows, _ = read_dump(spark, path, encoding="ISO-8859-1")
    return rows.select("id", "metadata", "amount", "updated_at")


def _texts_as_ledger(spark, d):
    """All documents as ledger rows whose documents are their whole texts."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(
        F.concat(F.lit("D_"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("company_id"),
        F.col("n_chars").cast("double").alias("amount"), F.col("text").alias("billing"),
        F.concat(F.lit("; INSERT INTO expenses (x) VALUES ('"), F.col("lang"), F.lit("');\n -- it's\\ ")).alias("metadata"),
    )


@query
def sql_dump_hard_roundtrip(spark, d):
    """Whole texts, and strings that look like statements, through a dump and back."""
    path = f"{shared_folder(spark)}/ledgersift/dump-{uuid.uuid4().hex}"
    write_dump(_texts_as_ledger(spark, d), path)
    rows, _ = read_dump(spark, path)
    return rows.select("id", "company_id", "amount", F.sha2("billing", 256).alias("text_sha256"), "metadata")


@query
def sql_dump_rejects(spark, d):
    """A dump by another hand: line breaks in strings, doubled quotes, nested objects; tuples with a cell too many or too few."""
    path = f"{shared_folder(spark)}/ledgersift/dump-{uuid.uuid4().hex}"
    escaped = F.replace(F.coalesce("text", F.lit("")), F.lit("\\"), F.lit("\\\\"))
    quoted = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("''")), F.lit("'"))
    more = F.when(F.col("lang") == "en", "").otherwise(", 7")
    one = F.concat(
        F.lit("("), F.col("doc_id").cast("string"), F.lit(", "), quoted, F.lit(""", {"k": {"z": [1, "it's)"]}}"""), more, F.lit("),\n")
    )
    line = F.concat(F.lit("INSERT INTO `expenses` (`id`, `billing`, `metadata`) VALUES\n"), one, F.lit("(0);"))
    spark.read.parquet(f"{d}/documents.parquet").select(line.alias("value")).write.text(path)
    rows, rejected = read_dump(spark, path)
    loaded = rows.groupBy(F.sha2("billing", 256).alias("text_sha256"), "metadata").agg(F.count(F.lit(1)).alias("n"))
    refused = rejected.groupBy("found").agg(F.count(F.lit(1)).alias("n"))
    return loaded.withColumn("found", F.lit(3)).unionByName(refused, allowMissingColumns=True)


@query
def csv_hard_roundtrip(spark, d):
    """Whole texts through CSV, outer blanks, quotes and line breaks included."""
    path = f"{shared_folder(spark)}/ledgersift/report-{uuid.uuid4().hex}.csv"
    texts = _texts_as_ledger(spark, d).withColumn("metadata", F.concat(F.lit("  \t"), F.col("metadata"), F.lit("  ")))
    write_report(texts, path)
    back = read_csv_ledger(spark, path)
    return back.select("id", "amount", F.sha2("billing", 256).alias("text_sha256"), "metadata")


@query
def csv_roundtrip(spark, d):
    path = f"{shared_folder(spark)}/ledgersift/report-{uuid.uuid4().hex}.csv"
    write_report(_full_ledger(spark, d), path)
    return read_csv_ledger(spark, path).select("id", "amount", "created_at", "metadata", "state")


@query
def json_roundtrip(spark, d):
    path = f"{shared_folder(spark)}/ledgersift/report-{uuid.uuid4().hex}.json"
    write_report(_full_ledger(spark, d), path)
    back = spark.read.schema("id string, amount double, created_at string, user_id string").json(path)
    return back.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query
def parquet_roundtrip(spark, d):
    path = f"{shared_folder(spark)}/ledgersift/report-{uuid.uuid4().hex}.parquet"
    write_report(_full_ledger(spark, d), path)
    return spark.read.parquet(path).select("id", "amount", "created_at", "state")


# ---------------------------------------------------------------- detectors


@query
def knn_edges(spark, d):
    """The five nearest vectors of every embedding, itself included."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")
    )
    name = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    return knn.nearest_rows(rows, 5).select(
        name("id").alias("vid"), F.col("rank").cast("long").alias("rank"), name("other").alias("nid"), F.round("d", 5).alias("d")
    )


@query
def iforest_scores(spark, d):
    return iforest.fit_isolation_forest(staged(spark, d, "vectors"))[1]


@query
def lof_scores(spark, d):
    out = density.fit_density(staged(spark, d, "vectors"))[1]
    return out.select("id", F.round("score_lof", 5).alias("score_lof"), "anomaly_lof")


@query
def dbscan_scores(spark, d):
    out = density.fit_density(staged(spark, d, "vectors"))[1]
    return out.select("id", F.round("score_dbscan", 5).alias("score_dbscan"), "anomaly_dbscan")


@query
def ensemble_scores(spark, d):
    """The whole audit of the raw ledger."""
    return pipeline.audit(raw_ledger(spark, d))


@query
def audit_columns(spark, d):
    """The whole audit, in the columns that the random trees do not enter."""
    out = pipeline.audit(raw_ledger(spark, d))
    scores = ["score_rules", "score_lof", "score_dbscan", *ensemble.PATTERN_COLUMNS]
    flags = ["anomaly_rules", "anomaly_lof", "anomaly_dbscan", "is_fraud_pattern", "rules_triggered"]
    return out.select("id", "amount", *[F.round(c, 4).alias(c) for c in scores], *flags)


@query
def model_info(spark, d):
    models, _ = pipeline.fit_models(feats(spark, d))
    return models.info_frame(spark)


@query
def score_new(spark, d):
    """Models from history, then the online scoring of the arrivals."""
    history, new = _split_arrivals(spark, d)
    models = pipeline.fit(history)
    return pipeline.score_new(history, new, models)[0]


# ---------------------------------------------------------------- streams


@query
def stream_behavior(spark, d):
    """Look-back figures of the ledger arriving in three parts, each after a restart of the stream."""
    rows = base(spark, d).select("id", "user_id", "amount", "created_at")
    first, last = rows.agg(F.min(micros("created_at")), F.max(micros("created_at"))).first()
    step = ((last or 0) - (first or 0)) // 3 + 1
    part = F.floor((micros("created_at") - F.lit(first or 0)) / F.lit(step))
    place = f"{shared_folder(spark)}/ledgersift/{uuid.uuid4().hex}"
    for i in range(3):
        rows.where(part == i).write.mode("append").parquet(f"{place}/in")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{place}/in")
        write_behavior(arriving, f"{place}/out", f"{place}/state").awaitTermination()
    out = spark.read.parquet(f"{place}/out")
    return out.select(
        "id", F.round("user_rolling_mean_7d", 2).alias("user_rolling_mean_7d"),
        F.round("user_rolling_std_7d", 2).alias("user_rolling_std_7d"),
        F.round("days_since_last_tx", 6).alias("days_since_last_tx"),
        F.round("fraud_duplicate_score", 6).alias("fraud_duplicate_score"), "late",
    )


@query
def latest_batch_top(spark, d):
    """The highest anomalies of the newest of three written batches."""
    place = f"{shared_folder(spark)}/ledgersift/{uuid.uuid4().hex}"
    batches = standin(spark, d).withColumn("batch_id", F.col("id").substr(-7, 7).cast("long") % 3)
    with open_files(spark, 8):
        batches.write.partitionBy("batch_id").parquet(f"{place}/scored")
    return latest_top(spark, place, 50).select("id", "batch_id", "amount", "score_final")


# ---------------------------------------------------------------- plans for oversized keys


def _with_small_limits(name: str) -> Query:
    """A query whose limits make every larger user, source or value list an oversized key; the rows stay the same."""

    def run(spark, d):
        return QUERIES[name](spark, d, AuditConfig(limits=ScaleLimits(group_rows=40, frame_rows=4)))

    return run


SLICED = [
    "iqr_flags", "rolling_7d", "days_since_last", "user_profile_modes", "fraud_splitting", "fraud_duplicates", "gini",
    "pseudonymize",
]
QUERIES.update({f"{name}_sliced": _with_small_limits(name) for name in SLICED})
