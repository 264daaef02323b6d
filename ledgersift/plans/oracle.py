"""ANSI-SQL equivalents of the registered queries, for cross-checking on another engine.

Each statement is built from named common table expressions that restate the
operators in plain SQL: self joins where the Spark plans use windows, ranking
where they use aggregates, and so on.
"""

from __future__ import annotations

import re

from ledgersift.config import CORRELATION_COLUMNS, LEDGER_COLUMNS, MATRIX_COLUMNS, SOURCE_FIXES
from ledgersift.operators.ensemble import PATTERN_COLUMNS, SCORES, weights
from ledgersift.operators.reports import BREAK_FLAGS, SWEEP
from ledgersift.operators.rules import SHORT_LABELS, rule_set
from ledgersift.plans.flagship import SIMPLE
from ledgersift.plans.queries import INCREMENTAL, SLICED
from ledgersift.sources.fixture import LEDGER_EXPRESSIONS

DAY = 86400000000


_texts = "'D_' || CAST(doc_id AS varchar) AS id, n_chars::double AS amount, sha256(text) AS text_sha256"
_strange = (
    "'; INSERT INTO expenses (x) VALUES (' || chr(39) || lang || chr(39) || ');' || chr(10) || ' -- it' || chr(39) || 's'"
    " || chr(92) || ' '"
)


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_first = ", ".join(f"{e} AS {n}" for n, e in LEDGER_EXPRESSIONS.items())
_names = list(LEDGER_EXPRESSIONS)
_later = ", ".join(
    {"amount": "amount + 1.0 AS amount", "updated_at": "updated_at + INTERVAL 1 HOUR AS updated_at"}.get(n, n)
    for n in _names
)
_fixes = " ".join(f"WHEN {_quote(a)} THEN {_quote(b)}" for a, b in SOURCE_FIXES.items())
_source = "upper(trim(coalesce(source, 'UNKNOWN')))"
_rules = rule_set()
_weight = sum(r.weight for r in _rules)
_flag_sql = {
    r.name: "CAST(coalesce("
    + r.predicate.replace("100000D", "100000.0").replace("10000D", "10000.0")
    + ", false) AS int)"
    for r in _rules
}
_rule_flags = ", ".join(f"{sql} AS {name}" for name, sql in _flag_sql.items())
_rule_score = "(0.0" + "".join(f" + {r.name} * {r.weight}::double" for r in _rules) + f") / {_weight!r}::double"
_rule_text = "concat_ws(' | ', " + ", ".join(
    f"CASE WHEN {r.name} = 1 THEN {_quote(r.description)} END" for r in _rules
) + ")"
_blend = " + ".join(f"{c} * {w}::double" for c, w in weights().items())
_patterns = list(PATTERN_COLUMNS.values())

CTES: dict[str, str] = {
    "b0": f"""SELECT {_first} FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS int) AS k FROM events)""",
    "raw": f"""SELECT * FROM b0 UNION ALL SELECT {_later} FROM b0 WHERE event_id % 301 = 4""",
    "cleaned": """SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at, created_at) AS rn
        FROM raw WHERE deleted_at IS NULL)
      WHERE rn = 1 AND amount > 0 AND created_at IS NOT NULL""",
    "base": f"""SELECT * REPLACE (
        lower(trim(coalesce(expense_type, 'unknown'))) AS expense_type,
        CASE {_source} {_fixes} ELSE {_source} END AS source,
        upper(trim(coalesce(currency, 'UNKNOWN'))) AS currency),
        epoch_us(created_at) AS us FROM cleaned""",
    "temporal": """SELECT *, CAST(hour(created_at) AS int) AS hour_of_day,
        CAST(isodow(created_at) - 1 AS int) AS day_of_week,
        CAST(isodow(created_at) IN (6, 7) AS int) AS is_weekend,
        CAST(month(created_at) AS int) AS month, CAST(year(created_at) AS int) AS year,
        CAST(hour(created_at) < 7 OR hour(created_at) >= 20 AS int) AS is_outside_hours,
        round((epoch_us(paid_at) - epoch_us(created_at)) / 86400000000.0::double, 2) AS payment_delay_days,
        CAST(coalesce(due_date > created_at, false) AS int) AS is_future_due FROM base""",
    "overall": """SELECT avg(amount) AS g_mean, stddev_samp(amount) AS g_std,
        quantile_cont(amount, 0.25) AS g_q1, quantile_cont(amount, 0.75) AS g_q3,
        quantile_cont(amount, 0.75) AS p75, quantile_cont(amount, 0.90) AS p90 FROM base""",
    "users": f"""SELECT user_id, avg(amount) AS user_amount_mean, stddev_samp(amount) AS user_amount_std,
        count(*) AS user_tx_count,
        greatest((max(us) - min(us)) // {DAY}, 1) AS user_active_days,
        avg(hour_of_day) AS user_hour_mean, coalesce(stddev_samp(hour_of_day), 0.0) AS user_hour_std,
        quantile_cont(amount, 0.25) AS u_q1, quantile_cont(amount, 0.5) AS user_typical_amount_median,
        quantile_cont(amount, 0.75) AS u_q3 FROM temporal WHERE user_id IS NOT NULL GROUP BY user_id""",
    "usual_source": """SELECT user_id, source AS user_typical_source FROM (
        SELECT user_id, source, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, source) AS r
        FROM base WHERE user_id IS NOT NULL GROUP BY user_id, source) WHERE r = 1""",
    "usual_type": """SELECT user_id, expense_type AS user_typical_expense_type FROM (
        SELECT user_id, expense_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, expense_type) AS r
        FROM base WHERE user_id IS NOT NULL GROUP BY user_id, expense_type) WHERE r = 1""",
    "daily": """SELECT user_id, CAST(created_at AS date) AS day, count(*) AS tx_daily_count
        FROM base WHERE user_id IS NOT NULL GROUP BY 1, 2""",
    "rolling": f"""SELECT id,
        CASE WHEN user_id IS NOT NULL THEN avg(amount) OVER w END AS user_rolling_mean_7d,
        CASE WHEN user_id IS NOT NULL THEN coalesce(stddev_samp(amount) OVER w, 0.0) END AS user_rolling_std_7d
        FROM base WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {7 * DAY - 1} PRECEDING AND CURRENT ROW)""",
    "gaps": """SELECT id, CASE WHEN user_id IS NULL THEN 0.0 ELSE
        coalesce((us - lag(us) OVER (PARTITION BY user_id ORDER BY us, id)) / 86400000000.0::double, 0.0) END
        AS days_since_last_tx FROM base""",
    "suppliers": """SELECT supplier_id, count(*) AS uses, avg(amount) AS s_mean
        FROM base WHERE supplier_id IS NOT NULL GROUP BY supplier_id""",
    "feat": """SELECT t.*, ln(1 + amount) AS amount_log, (amount - g_mean) / g_std AS amount_zscore_global,
        CAST(amount < g_q1 - 1.5 * (g_q3 - g_q1) OR amount > g_q3 + 1.5 * (g_q3 - g_q1) AS int) AS amount_iqr_flag_global,
        user_amount_mean, user_amount_std, user_tx_count, user_active_days,
        CASE WHEN user_amount_std > 0 THEN (amount - user_amount_mean) / user_amount_std ELSE 0.0 END AS amount_zscore_per_user,
        CASE WHEN user_amount_mean > 0 THEN amount / user_amount_mean ELSE 1.0 END AS amount_vs_user_mean_ratio,
        CAST(amount < u_q1 - 1.5 * (u_q3 - u_q1) OR amount > u_q3 + 1.5 * (u_q3 - u_q1) AS int) AS amount_iqr_flag_per_user,
        user_typical_amount_median,
        CASE WHEN user_typical_amount_median > 0 THEN amount / user_typical_amount_median ELSE 1.0 END AS amount_deviation_from_user_median,
        user_tx_count / user_active_days AS user_tx_per_day,
        tx_daily_count, CAST(coalesce(tx_daily_count > 10, false) AS int) AS tx_daily_count_flag,
        user_rolling_mean_7d, user_rolling_std_7d,
        CASE WHEN user_rolling_mean_7d > 0 THEN amount / user_rolling_mean_7d ELSE 1.0 END AS amount_vs_rolling_mean_ratio,
        CAST(CASE WHEN user_rolling_mean_7d > 0 THEN amount / user_rolling_mean_7d ELSE 1.0 END > 2.0 AS int) AS rolling_amount_spike_flag,
        CASE WHEN user_hour_std > 0 THEN abs(hour_of_day - user_hour_mean) / user_hour_std ELSE 0.0 END AS hour_deviation_from_user_norm,
        user_typical_source, user_typical_expense_type,
        CAST(source IS DISTINCT FROM user_typical_source AS int) AS is_unusual_source_for_user,
        CAST(expense_type IS DISTINCT FROM user_typical_expense_type AS int) AS is_unusual_type_for_user,
        days_since_last_tx,
        coalesce(uses, 0) AS supplier_usage_count,
        CAST(coalesce(uses < 3, false) AS int) AS is_rare_supplier,
        coalesce(s_mean, amount) AS supplier_avg_amount,
        amount / coalesce(s_mean, amount) AS amount_vs_supplier_avg
        FROM temporal t CROSS JOIN overall
        LEFT JOIN users USING (user_id) LEFT JOIN usual_source USING (user_id) LEFT JOIN usual_type USING (user_id)
        LEFT JOIN daily ON daily.user_id = t.user_id AND daily.day = CAST(t.created_at AS date)
        JOIN rolling USING (id) JOIN gaps USING (id) LEFT JOIN suppliers USING (supplier_id)""",
    "codes": " UNION ALL ".join(
        f"SELECT '{c}' AS col, {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM base WHERE {c} IS NOT NULL)"
        for c in ("status", "expense_type", "source", "currency")
    ),
    "encoded": "SELECT f.*, "
    + ", ".join(
        f"CAST(coalesce(c_{c}.code, -1) AS int) AS {c}_encoded"
        for c in ("status", "expense_type", "source", "currency")
    )
    + " FROM feat f "
    + " ".join(
        f"LEFT JOIN codes c_{c} ON c_{c}.col = '{c}' AND c_{c}.v = f.{c}"
        for c in ("status", "expense_type", "source", "currency")
    ),
    "middle": "SELECT "
    + ", ".join(f"coalesce(quantile_cont({c}::double, 0.5), 0.0) AS m_{c}" for c in MATRIX_COLUMNS)
    + " FROM encoded",
    "imputed": "SELECT id, "
    + ", ".join(f"coalesce({c}::double, m_{c}) AS {c}" for c in MATRIX_COLUMNS)
    + " FROM encoded CROSS JOIN middle",
    "scaling": "SELECT "
    + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in MATRIX_COLUMNS)
    + " FROM imputed",
    "ruled0": f"SELECT *, {_rule_flags} FROM feat",
    "ruled": f"""SELECT *, {_rule_score} AS score_rules, {_rule_text} AS rules_triggered,
        CAST({_rule_score} >= 0.30 AS int) AS anomaly_rules FROM ruled0""",
    "split_prior": f"""SELECT a.id, a.amount, count(*) AS n, sum(b.amount) AS prior FROM base a JOIN base b
        ON a.user_id = b.user_id AND a.supplier_id = b.supplier_id
        AND (b.us, b.id) < (a.us, a.id) AND b.us >= a.us - {DAY} GROUP BY a.id, a.amount""",
    "p_splitting": """SELECT id, (least(n / 10.0::double, 1.0) + least((prior + amount) / (p75 * 3), 1.0)) / 2 AS fraud_splitting_score
        FROM split_prior CROSS JOIN overall WHERE n >= 2 AND prior + amount > p75""",
    "p_duplicate": f"""SELECT a.id, max(1 - (a.us - b.us) / 3600000000.0::double / 48) AS fraud_duplicate_score FROM base a JOIN base b
        ON a.user_id = b.user_id AND (b.us, b.id) < (a.us, a.id) AND b.us >= a.us - {2 * DAY}
        AND abs(a.amount - b.amount) / (a.amount + 1) < 0.01::double GROUP BY a.id""",
    "p_ghost": """SELECT id, least(amount / p90, 1.0) AS fraud_ghost_supplier_score
        FROM base CROSS JOIN overall WHERE amount > p90 AND supplier_id IN
        (SELECT supplier_id FROM suppliers WHERE uses = 1)""",
    "tail10": """SELECT * FROM (SELECT id, user_id, amount,
        row_number() OVER (PARTITION BY user_id ORDER BY us DESC, id DESC) AS back FROM base WHERE user_id IS NOT NULL) WHERE back <= 10""",
    "tail_rank": """SELECT *, -back::double AS t, rank() OVER (PARTITION BY user_id ORDER BY amount)
        + (count(*) OVER (PARTITION BY user_id, amount) - 1) / 2.0::double AS r FROM tail10""",
    "rho": """SELECT user_id, count(*) AS n, corr(t, r) AS rho FROM tail_rank GROUP BY user_id
        HAVING count(*) >= 5 AND min(amount) < max(amount)""",
    "p_inflation": """SELECT id, (rho - 0.70) / 0.30 AS fraud_inflation_score FROM tail10 JOIN rho USING (user_id)
        WHERE rho > 0.70 AND NOT (n = 5 AND rho <= 0.80538) AND NOT (n = 6 AND rho <= 0.72930)""",
    "patt0": "SELECT base.id, "
    + ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in _patterns)
    + " FROM base LEFT JOIN p_splitting USING (id) LEFT JOIN p_duplicate USING (id)"
    " LEFT JOIN p_ghost USING (id) LEFT JOIN p_inflation USING (id)",
    "patt1": f"SELECT *, greatest({', '.join(_patterns)}) AS fraud_score_combined FROM patt0",
    "cut": """SELECT coalesce(quantile_cont(fraud_score_combined, 0.60), 0.40) AS cut
        FROM patt1 WHERE fraud_score_combined > 0""",
    "patt": "SELECT patt1.*, CAST(fraud_score_combined >= cut AS int) AS is_fraud_pattern FROM patt1 CROSS JOIN cut",
    "judged": """SELECT ruled.*, patt.* EXCLUDE (id), fraud_score_combined AS score_fraud,
        event_id % 101 / 100.0::double AS score_if, event_id * 7 % 101 / 100.0::double AS score_lof,
        event_id * 13 % 101 / 100.0::double AS score_dbscan FROM ruled JOIN patt USING (id)""",
    "blended": f"""SELECT *, {_blend} AS blend, CAST(score_if > 0.95 AS int) AS anomaly_if,
        CAST(score_lof > 0.95 AS int) AS anomaly_lof, CAST(score_dbscan > 0.95 AS int) AS anomaly_dbscan FROM judged""",
    "scored": f"""SELECT * REPLACE ({', '.join(f'round({c}, 4) AS {c}' for c in SCORES)}),
        round(blend, 4) AS score_final, CAST(blend >= 0.50 OR is_fraud_pattern = 1 AS int) AS is_anomaly,
        {', '.join(f'round({c}, 4) AS {n}' for n, c in PATTERN_COLUMNS.items())} FROM blended""",
    "orders_ledger": """SELECT concat('ORD_', lpad(CAST(o_orderkey AS varchar), 8, '0')) AS id, o_custkey AS user_id,
        o_totalprice AS amount, epoch_us(o_orderdate) AS us FROM orders""",
    "aliases": " UNION ALL ".join(
        f"SELECT '{c}' AS col, {c} AS v, concat('{p}_', lpad(CAST(row_number() OVER (ORDER BY min((updated_at, id))) AS varchar), 4, '0')) AS alias"
        f" FROM raw WHERE trim({c}) <> '' GROUP BY {c}"
        for c, p in {"company_id": "COMP", "user_id": "USR", "shop_id": "SHOP", "supplier_id": "SUPP"}.items()
    ),
    "grown": " UNION ALL ".join(
        f"SELECT '{c}' AS col, v, concat('{p}_', lpad(CAST(row_number() OVER (ORDER BY early IS NULL, coalesce(early, seen)) AS varchar), 4, '0')) AS alias"
        f" FROM (SELECT {c} AS v, min((updated_at, id)) AS seen, min((updated_at, id)) FILTER (WHERE event_id % 3 = 1 AND user_id < 'USR_00060') AS early"
        f" FROM raw WHERE trim({c}) <> '' GROUP BY {c})"
        for c, p in {"company_id": "COMP", "user_id": "USR", "shop_id": "SHOP", "supplier_id": "SUPP"}.items()
    ),
    "arrivals": """SELECT * REPLACE (CASE WHEN event_id % 400 = 39 THEN
        concat('EXP_', lpad(CAST(event_id - 1 AS varchar), 7, '0')) ELSE id END AS id) FROM raw WHERE event_id % 40 = 39
        AND amount > 0""",
}


def build(select: str) -> str:
    """Prefix a statement with the expressions it uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(select)
    parts = ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in needed)
    return f"WITH {parts} {select}" if needed else select


def _rates(columns: list[str], table: str, key: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS {key}, count(*) FILTER (WHERE {c} = 1) AS n,"
        f" round(count(*) FILTER (WHERE {c} = 1) * 100.0::double / count(*), 2) AS rate_pct FROM {table}"
        for c in columns
    )


def _exposure(table: str, flag: str = "is_anomaly = 1", extra: str = "") -> str:
    return f"""SELECT count(*) AS total, count(*) FILTER (WHERE {flag}) AS anomalies,
      round(count(*) FILTER (WHERE {flag}) * 100.0::double / count(*), 2) AS anomaly_rate_pct,
      sum(amount) AS total_amount, sum(CASE WHEN {flag} THEN amount ELSE 0.0 END) AS risk_amount,
      round(sum(CASE WHEN {flag} THEN amount ELSE 0.0 END) * 100.0::double / sum(amount), 2) AS risk_share_pct,
      round(avg(score_final), 4) AS mean_score,
      round(coalesce(avg(CASE WHEN {flag} THEN score_final END), 0.0), 4) AS mean_score_anomalies,
      round(coalesce(coalesce(avg(CASE WHEN {flag} THEN score_final END), 0.0)
        / avg(CASE WHEN NOT ({flag}) THEN score_final END), 1.0), 4) AS separation{extra} FROM {table}"""


def _groups(column: str, n: int) -> str:
    return f"""SELECT {column}, count(id) AS alerts, sum(amount) AS amount FROM scored
      WHERE is_anomaly = 1 AND {column} IS NOT NULL GROUP BY {column} ORDER BY alerts DESC, {column} LIMIT {n}"""


def _profile(column: str, size: int) -> str:
    return f"""SELECT r AS {column}, coalesce(n, 0) AS n FROM range({size}) t(r)
      LEFT JOIN (SELECT {column} AS c, count(*) AS n FROM temporal GROUP BY 1) ON c = r"""


def _histogram(value: str, width: float, bins: int, by: str, columns: str) -> str:
    bin_ = f"CAST(least(greatest(floor(({value}) / {width}), 0), {bins - 1}) AS int)"
    return f"""SELECT {columns} FROM (SELECT {by}, bin, bin * {width}::double AS bin_start, n,
      round(n / (sum(n) OVER (PARTITION BY {by}) * {width}::double), 6) AS density
      FROM (SELECT {by}, {bin_} AS bin, count(*) AS n FROM scored GROUP BY 1, 2))"""


_money = """CASE WHEN off >= 1e9 THEN printf('%.2f Md XAF', off / 1e9)
  WHEN off >= 1e6 THEN printf('%.1f M XAF', off / 1e6)
  WHEN off >= 1e3 THEN replace(format('{:,}', CAST(off AS bigint)), ',', ' ') || ' XAF'
  ELSE printf('%.2f XAF', off) END"""
_label = "CASE " + " ".join(
    f"WHEN starts_with(x, {_quote(a)}) THEN {_quote(b)}" for a, b in SHORT_LABELS.items()
) + " ELSE x END"
_null_columns = [c for c in _names if c != "event_id"]

SQL: dict[str, str] = {
    "clean_funnel": """SELECT count(*) AS raw_rows, count(deleted_at) AS soft_deleted,
      count(*) - count(DISTINCT id) AS duplicate_ids, count(*) FILTER (WHERE NOT coalesce(amount > 0, false)) AS invalid_amount,
      (SELECT count(*) FROM cleaned) AS retained,
      round(count(deleted_at) * 100.0::double / count(*), 2) AS soft_deleted_pct,
      round((count(*) - count(DISTINCT id)) * 100.0::double / count(*), 2) AS duplicate_ids_pct,
      round(count(*) FILTER (WHERE NOT coalesce(amount > 0, false)) * 100.0::double / count(*), 2) AS invalid_amount_pct,
      round((SELECT count(*) FROM cleaned) * 100.0::double / count(*), 2) AS retained_pct FROM raw""",
    "normalize_text": "SELECT id, expense_type, source, currency, amount FROM base",
    "normalize_cardinality": """SELECT count(DISTINCT c.expense_type) AS expense_type_before, count(DISTINCT c.source) AS source_before,
      count(DISTINCT b.expense_type) AS expense_type_after, count(DISTINCT b.source) AS source_after
      FROM cleaned c JOIN base b USING (id)""",
    "input_validation": """SELECT CASE WHEN amount IS NULL THEN 'amount missing' WHEN amount <= 0 THEN 'amount not positive'
      WHEN event_id % 89 = 5 THEN 'created_at missing' END AS rejected, coalesce(status, 'pending') AS status, count(*) AS n
      FROM raw GROUP BY 1, 2""",
    "null_audit": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls,"
        f" round((count(*) - count({c})) * 100.0::double / count(*), 2) AS null_pct FROM raw"
        for c in _null_columns
    ),
    "entity_counts": """SELECT count(*) AS total_rows, min(created_at) AS first_at, max(created_at) AS last_at,
      date_sub('day', min(created_at), max(created_at)) AS span_days,
      count(DISTINCT company_id) AS distinct_company_id, count(DISTINCT user_id) AS distinct_user_id,
      count(DISTINCT shop_id) AS distinct_shop_id, count(DISTINCT supplier_id) AS distinct_supplier_id FROM raw""",
    "temporal_features": """SELECT id, hour_of_day, day_of_week, is_weekend, month, year, is_outside_hours,
      payment_delay_days, is_future_due FROM temporal""",
    "amount_zscore_global": """SELECT id, round(ln(1 + amount), 6) AS amount_log,
      round((amount - g_mean) / g_std, 6) AS amount_zscore_global FROM base CROSS JOIN overall""",
    "iqr_flags": "SELECT id, amount_iqr_flag_global, amount_iqr_flag_per_user FROM feat",
    "amount_zscore_user": """SELECT id, round(amount_zscore_per_user, 6) AS amount_zscore_per_user,
      round(amount_vs_user_mean_ratio, 6) AS amount_vs_user_mean_ratio FROM feat""",
    "user_median_ratio": """SELECT id, user_typical_amount_median,
      round(amount_deviation_from_user_median, 6) AS amount_deviation_from_user_median FROM feat""",
    "user_behavior": """SELECT user_id, user_tx_count, user_active_days,
      round(user_tx_count / user_active_days, 6) AS user_tx_per_day, round(user_amount_mean, 2) AS user_amount_mean,
      round(user_amount_std, 2) AS user_amount_std FROM users""",
    "daily_frequency": """SELECT id, tx_daily_count, CAST(coalesce(tx_daily_count > 5, false) AS int) AS tx_daily_count_flag FROM feat""",
    "rolling_7d": """SELECT id, round(user_rolling_mean_7d, 2) AS user_rolling_mean_7d, round(user_rolling_std_7d, 2) AS user_rolling_std_7d,
      round(amount_vs_rolling_mean_ratio, 6) AS amount_vs_rolling_mean_ratio, rolling_amount_spike_flag FROM feat""",
    "rolling_ties": f"""SELECT a.id, count(*) AS n, round(sum(b.amount), 2) AS s FROM orders_ledger a JOIN orders_ledger b
      ON a.user_id = b.user_id AND b.us > a.us - {30 * DAY} AND b.us <= a.us GROUP BY a.id""",
    "days_since_last": "SELECT id, round(days_since_last_tx, 6) AS days_since_last_tx FROM gaps",
    "days_since_last_ties": """SELECT id, round(coalesce((us - lag(us) OVER (PARTITION BY user_id ORDER BY us, id)) / 86400000000.0::double, 0.0), 6)
      AS days_since_last_tx FROM orders_ledger""",
    "user_profile_modes": """SELECT id, user_typical_source, user_typical_expense_type,
      is_unusual_source_for_user, is_unusual_type_for_user FROM feat""",
    "hour_deviation": "SELECT id, round(hour_deviation_from_user_norm, 6) AS hour_deviation_from_user_norm FROM feat",
    "supplier_features": """SELECT id, supplier_usage_count, is_rare_supplier, round(supplier_avg_amount, 4) AS supplier_avg_amount,
      round(amount_vs_supplier_avg, 6) AS amount_vs_supplier_avg FROM feat""",
    "encode_categoricals": "SELECT id, status_encoded, expense_type_encoded, source_encoded, currency_encoded FROM encoded",
    "ml_matrix": "SELECT id, " + ", ".join(f"round({c}, 5) AS {c}" for c in MATRIX_COLUMNS) + " FROM imputed",
    "standardized_matrix": "SELECT id, "
    + ", ".join(
        f"round(({c} - a_{c}) / CASE WHEN s_{c} <= 1e-14 * abs(a_{c}) OR s_{c} = 0 THEN 1 ELSE s_{c} END, 5) AS {c}"
        for c in MATRIX_COLUMNS
    )
    + " FROM imputed CROSS JOIN scaling",
    "align_columns": "SELECT id, amount, 0.0::double AS amount_log, 0.0::double AS hour_of_day FROM base",
    "scalar_functions": f"""SELECT id, CAST(regexp_extract(CAST(CAST(amount AS bigint) AS varchar), '[1-9]') AS int) AS first_digit,
      CAST(amount >= 100000 AND amount % 10000 = 0 AS int) AS is_round, least(greatest(amount / 999983.0::double, 0.1), 2.0)::double AS clipped,
      CASE WHEN amount / 999983.0::double > 0.9 THEN 'anomaly' WHEN amount / 999983.0::double >= 0.35 THEN 'watch' ELSE 'clean' END AS verdict,
      CASE WHEN amount / 999983.0::double >= 0.5 THEN 'high' WHEN amount / 999983.0::double >= 0.2 THEN 'medium' ELSE 'low' END AS fraud_level,
      CASE WHEN amount / 999983.0::double < 0.20 THEN 'vigilant' WHEN amount / 999983.0::double <= 0.35 THEN 'balanced' ELSE 'strict' END AS sensitivity_mode,
      round(least(amount / 999983.0::double, 1.0::double) * 100, 1) AS risk_index_100, {_money} AS money_text FROM (SELECT *, amount + 0.37::double AS off FROM base)""",
    "rules_score": "SELECT id, " + ", ".join(r.name for r in _rules) + ", round(score_rules, 6) AS score_rules, anomaly_rules FROM ruled",
    "rule_explanations": "SELECT id, rules_triggered FROM ruled",
    "rule_short_reasons": f"""SELECT id, CASE WHEN rules_triggered = '' THEN '' ELSE
      array_to_string([{_label} for x in string_split(rules_triggered, ' | ')][1:3], '; ') END AS reasons FROM ruled""",
    "rule_rates": _rates([r.name for r in _rules], "ruled", "rule"),
    "fraud_splitting": "SELECT id, round(fraud_splitting_score, 6) AS fraud_splitting_score FROM p_splitting",
    "fraud_duplicates": "SELECT id, round(fraud_duplicate_score, 6) AS fraud_duplicate_score FROM p_duplicate",
    "fraud_ghost_supplier": "SELECT id, round(fraud_ghost_supplier_score, 6) AS fraud_ghost_supplier_score FROM p_ghost",
    "fraud_inflation": "SELECT id, round(fraud_inflation_score, 6) AS fraud_inflation_score FROM p_inflation",
    "fraud_combined": "SELECT id, round(fraud_score_combined, 6) AS fraud_score_combined, is_fraud_pattern FROM patt",
    "decision_batch": "SELECT id, score_final, is_anomaly FROM scored",
    "decision_online": f"""SELECT id, CAST({_blend} >= 0.50 OR is_fraud_pattern = 1 OR anomaly_rules = 1
      OR CAST(score_if > 0.70 AS int) + CAST(score_lof > 0.70 AS int) + CAST(score_dbscan > 0.70 AS int) >= 2 AS int) AS is_anomaly FROM scored""",
    "redecision": " UNION ALL ".join(
        _exposure("scored", f"(score_final >= {t}::double OR is_fraud_pattern = 1)", f", {t}::double AS threshold")
        for t in (0.15, 0.25, 0.40)
    ),
    "nested_results": """SELECT id, score_rules AS rules, fraud_duplicate AS duplicate,
      CAST(CASE WHEN rules_triggered = '' THEN 0 ELSE len(string_split(rules_triggered, ' | ')) END AS int) AS n_rules,
      is_fraud_pattern = 1 AS is_fraud_pattern FROM scored""",
    "top_anomalies": "SELECT id, amount, score_final FROM scored ORDER BY score_final DESC, id LIMIT 20",
    "recent_alerts": "SELECT id, created_at, score_final FROM scored WHERE is_anomaly = 1 ORDER BY created_at DESC, id DESC LIMIT 8",
    "audit_summary": """SELECT count(*) AS total_transactions, count(*) FILTER (WHERE is_anomaly = 1) AS total_anomalies,
      round(count(*) FILTER (WHERE is_anomaly = 1) * 100.0::double / count(*), 2) AS anomaly_rate_pct,
      round(avg(score_final), 4) AS avg_score_final,
      coalesce(round(avg(score_final) FILTER (WHERE is_anomaly = 1), 4), 0.0) AS avg_score_anomalies,
      count(*) FILTER (WHERE anomaly_if = 1) AS flagged_if, count(*) FILTER (WHERE anomaly_lof = 1) AS flagged_lof,
      count(*) FILTER (WHERE anomaly_dbscan = 1) AS flagged_dbscan, count(*) FILTER (WHERE anomaly_rules = 1) AS flagged_rules,
      count(*) FILTER (WHERE is_fraud_pattern = 1) AS flagged_fraud,
      count(*) FILTER (WHERE anomaly_if = 1 AND anomaly_lof = 1 AND anomaly_rules = 1) AS consensus_3_models,
      """
    + ", ".join(f"count(*) FILTER (WHERE {c} > 0) AS n_{c}" for c in PATTERN_COLUMNS)
    + """, CAST(trunc(sum(amount) FILTER (WHERE is_anomaly = 1)) AS bigint) AS anomaly_amount_total,
      CAST(trunc(max(amount) FILTER (WHERE is_anomaly = 1)) AS bigint) AS anomaly_amount_max,
      CAST(trunc(avg(amount) FILTER (WHERE is_anomaly = 1)) AS bigint) AS anomaly_amount_mean FROM scored""",
    "exposure_report": _exposure("scored"),
    "batch_summary": """SELECT count(*) AS total, count(*) FILTER (WHERE is_anomaly = 1) AS n_anomalies,
      round(count(*) FILTER (WHERE is_anomaly = 1) * 100.0::double / count(*), 2) AS anomaly_rate,
      coalesce(sum(amount) FILTER (WHERE is_anomaly = 1), 0.0) AS anomaly_amount_total FROM scored""",
    "top_categories": _groups("expense_type", 10),
    "top_users": _groups("user_id", 10),
    "top_sources": _groups("source", 8),
    "monthly_trend": """SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS total, count(*) FILTER (WHERE is_anomaly = 1) AS anomalies,
      round(count(*) FILTER (WHERE is_anomaly = 1) * 100.0::double / count(*), 1) AS rate_pct FROM scored GROUP BY 1""",
    "daily_volume": """SELECT a.day, a.total, coalesce(b.anomalies, 0) AS anomalies FROM
      (SELECT CAST(created_at AS date) AS day, count(*) AS total FROM scored GROUP BY 1) a LEFT JOIN
      (SELECT CAST(created_at AS date) AS day, count(*) AS anomalies FROM scored WHERE is_anomaly = 1 GROUP BY 1) b USING (day)""",
    "hour_profile": _profile("hour_of_day", 24),
    "weekday_profile": _profile("day_of_week", 7),
    "describe_amount": """SELECT round(min(amount), 6) AS min_amount, round(max(amount), 6) AS max_amount, round(avg(amount), 6) AS mean_amount,
      round(stddev_samp(amount), 6) AS std_amount, round(skewness(amount), 6) AS skew_amount, round(skewness(ln(1 + amount)), 6) AS skew_log_amount,
      """
    + ", ".join(f"round(quantile_cont(amount, {p}), 6) AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.95, 0.99))
    + " FROM base",
    "value_counts": """SELECT source, count(*) AS n, round(count(*) * 100.0::double / (SELECT count(*) FROM base), 2) AS share_pct
      FROM base GROUP BY source ORDER BY n DESC, source LIMIT 8""",
    "sensitivity_counts": """SELECT count(*) FILTER (WHERE amount_zscore_global > 3) AS z_global, count(*) FILTER (WHERE amount_zscore_per_user > 3) AS z_user,
      count(*) FILTER (WHERE amount_iqr_flag_global = 1) AS iqr_global, count(*) FILTER (WHERE amount_iqr_flag_per_user = 1) AS iqr_user,
      round(count(*) FILTER (WHERE amount_iqr_flag_global = 1) * 100.0::double / count(*), 2) AS iqr_global_pct,
      round(count(*) FILTER (WHERE amount_iqr_flag_per_user = 1) * 100.0::double / count(*), 2) AS iqr_user_pct FROM feat""",
    "behavior_breaks": _rates(BREAK_FLAGS, "feat", "signal"),
    "break_classes": """SELECT CASE WHEN tx_daily_count > 3 AND amount_vs_rolling_mean_ratio > 2 THEN 'double'
      WHEN amount_vs_rolling_mean_ratio > 2 THEN 'amount' ELSE 'none' END AS break_class, count(*) AS n FROM feat GROUP BY 1""",
    "supplier_rarity": """SELECT count(supplier_id) AS with_supplier, round(count(supplier_id) * 100.0::double / count(*), 2) AS coverage_pct,
      count(*) FILTER (WHERE is_rare_supplier = 1) AS rare, count(*) FILTER (WHERE supplier_id IS NOT NULL AND is_rare_supplier = 0) AS regular,
      round(count(*) FILTER (WHERE is_rare_supplier = 1) * 100.0::double / count(supplier_id), 2) AS rare_pct FROM feat""",
    "rule_top20_matrix": " UNION ALL ".join(
        f"SELECT '{r.name}' AS rule, "
        + ", ".join(f"max({r.name}) FILTER (WHERE rk = {i}) AS r{i}" for i in range(1, 21))
        + " FROM (SELECT *, row_number() OVER (ORDER BY score_final DESC, id) AS rk FROM scored) WHERE rk <= 20"
        for r in _rules
    ),
    "threshold_sweep": " UNION ALL ".join(
        f"SELECT {t}::double AS threshold, count(*) FILTER (WHERE score_final >= {t}::double) AS anomalies,"
        f" round(count(*) FILTER (WHERE score_final >= {t}::double) * 100.0::double / count(*), 2) AS rate_pct,"
        f" sum(CASE WHEN score_final >= {t}::double THEN amount ELSE 0.0 END) AS amount FROM scored"
        for t in SWEEP
    ),
    "contribution": " UNION ALL ".join(
        f"SELECT '{c}' AS pillar, round(avg({c}) * {w}::double * 100.0::double / ("
        + " + ".join(f"avg({x}) * {v}::double" for x, v in weights().items())
        + "), 4) AS share_pct FROM scored WHERE is_anomaly = 1"
        for c, w in weights().items()
    ),
    "detector_means": " UNION ALL ".join(
        f"SELECT '{c}' AS detector, round(avg({c}) FILTER (WHERE is_anomaly = 0), 6) AS mean_normal,"
        f" round(avg({c}) FILTER (WHERE is_anomaly = 1), 6) AS mean_anomaly FROM scored"
        for c in SCORES
    ),
    "consensus": """SELECT r AS votes, coalesce(n, 0) AS n FROM range(4) t(r) LEFT JOIN
      (SELECT anomaly_if + anomaly_lof + anomaly_dbscan AS c, count(*) AS n FROM scored GROUP BY 1) ON c = r""",
    "pattern_counts": " UNION ALL ".join(
        f"SELECT '{c}' AS pattern, count(*) FILTER (WHERE {c} > {o}) AS n, {o}::double AS over FROM scored"
        for o in (0.0, 0.4)
        for c in PATTERN_COLUMNS
    ),
    "category_benchmark": """SELECT id, median_amount, round(mean_amount, 4) AS mean_amount, max_amount, round(amount / median_amount, 6) AS ratio,
      CASE WHEN amount / median_amount > 2 THEN 'high' WHEN amount / median_amount < 0.2 THEN 'low' ELSE 'usual' END AS band
      FROM base JOIN (SELECT expense_type, quantile_cont(amount, 0.5) AS median_amount, avg(amount) AS mean_amount, max(amount) AS max_amount
      FROM base GROUP BY expense_type) USING (expense_type)""",
    "search_filter": """SELECT id, user_id, score_final FROM scored WHERE is_anomaly = 1 AND expense_type = 'raw_materials'
      AND (contains(lower(id), 'usr_0000') OR coalesce(contains(lower(user_id), 'usr_0000'), false)
      OR coalesce(contains(lower(supplier_id), 'usr_0000'), false)) ORDER BY score_final DESC, id""",
    "category_choices": "SELECT DISTINCT expense_type FROM base ORDER BY 1",
    "amount_histogram": _histogram("ln(1 + amount)", 0.5, 40, "is_anomaly", "is_anomaly, bin, bin_start, n, density"),
    "score_histogram": _histogram("score_final", 0.05, 20, "is_fraud_pattern", "is_fraud_pattern, bin, n, density"),
    "median_ratio_histogram": _histogram(
        "least(greatest(amount_deviation_from_user_median, 0.0), 20.0)", 0.4, 50, "is_anomaly", "is_anomaly, bin, n"
    ),
    "amount_box": """SELECT CASE WHEN is_fraud_pattern = 1 THEN 'fraud' ELSE 'normal' END AS class, round(min(v), 6) AS low,
      round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3,
      round(max(v), 6) AS high FROM (SELECT is_fraud_pattern, ln(1 + amount) AS v FROM scored) GROUP BY 1""",
    "gini": """SELECT round((2 * sum(i * amount) - (count(*) + 1) * sum(amount)) / (count(*) * sum(amount)), 8) AS gini
      FROM (SELECT amount, CAST(row_number() OVER (ORDER BY amount) AS double) AS i FROM base)""",
    "benford": """SELECT digit, n, round(n * 100.0::double / t, 6) AS observed_pct, round(p * 100, 6) AS expected_pct, round(x, 6) AS chi2,
      round(exp(-x / 2) * (1 + x / 2 + pow(x / 2, 2) / 2 + pow(x / 2, 3) / 6), 6) AS p_value FROM (
      SELECT *, sum(pow(n - p * t, 2) / (p * t)) OVER () AS x FROM (SELECT d AS digit, coalesce(n, 0) AS n,
      log10(1 + 1.0::double / d) AS p, (SELECT count(*) FROM base) AS t FROM range(1, 10) r(d) LEFT JOIN
      (SELECT CAST(regexp_extract(CAST(CAST(amount AS bigint) AS varchar), '[1-9]') AS bigint) AS f, count(*) AS n FROM base GROUP BY 1) ON f = d))""",
    "union_new_history": """SELECT CAST(is_new AS int) AS is_new, count(*) AS n, count(DISTINCT id) AS ids, sum(amount) AS amount FROM (
      SELECT 1 AS is_new, id, amount FROM arrivals UNION ALL
      SELECT 0, id, amount FROM raw WHERE event_id % 40 <> 39 AND id NOT IN (SELECT id FROM arrivals)) GROUP BY 1""",
    "pseudonymize": """SELECT concat('EXP_', lpad(CAST(no AS varchar), 5, '0')) AS id, c.alias AS company_id, u.alias AS user_id, s.alias AS shop_id,
      p.alias AS supplier_id, CASE WHEN reference IS NOT NULL THEN concat('#REF_', lpad(CAST(no AS varchar), 5, '0')) END AS reference, amount
      FROM (SELECT *, row_number() OVER (ORDER BY updated_at, id) AS no FROM raw) r
      LEFT JOIN aliases c ON c.col = 'company_id' AND c.v = r.company_id LEFT JOIN aliases u ON u.col = 'user_id' AND u.v = r.user_id
      LEFT JOIN aliases s ON s.col = 'shop_id' AND s.v = r.shop_id LEFT JOIN aliases p ON p.col = 'supplier_id' AND p.v = r.supplier_id""",
    "billing_sanitize": """SELECT id, updated_at, '{"treasury_account_id":"' || 'ACC_' || lpad(CAST(no AS varchar), 4, '0') ||
      '","method":"Corporate account","address_id":null}' AS billing FROM raw JOIN (
      SELECT json_extract_string(billing, '$.treasury_account_id') AS a, row_number() OVER (ORDER BY min((updated_at, id))) AS no FROM raw GROUP BY 1)
      ON a = json_extract_string(billing, '$.treasury_account_id')""",
    "date_shift": """SELECT id, created_at + INTERVAL 70 DAY AS created_at, due_date + INTERVAL 70 DAY AS due_date, paid_at + INTERVAL 70 DAY AS paid_at,
      updated_at + INTERVAL 70 DAY AS updated_at, deleted_at + INTERVAL 70 DAY AS deleted_at FROM raw""",
    # The shared copy gives every raw row an id of its own, so repeated ids stay.
    "anonymized_features": """SELECT CAST(isodow(created_at) - 1 AS int) AS day_of_week,
      CAST(hour(created_at) < 7 OR hour(created_at) >= 20 AS int) AS is_outside_hours, count(*) AS n, sum(amount) AS amount
      FROM raw WHERE deleted_at IS NULL AND amount > 0 GROUP BY 1, 2""",
    "sql_dump_roundtrip": """SELECT id, user_id, supplier_id, amount, currency, date_trunc('second', created_at) AS created_at,
      date_trunc('second', deleted_at) AS deleted_at, billing, '{"note": "it''s \\\\ fine, ok"}' AS metadata, 1::bigint AS state FROM raw""",
    "sql_dump_hard_roundtrip": f"SELECT {_texts}, source AS company_id, {_strange} AS metadata FROM documents",
    "csv_hard_roundtrip": f"SELECT {_texts}, '  ' || chr(9) || {_strange} || '  ' AS metadata FROM documents",
    "sql_dump_rejects": """SELECT sha256(coalesce(text, '')) AS text_sha256, '{"k": {"z": [1, "it''s)"]}}' AS metadata, count(*) AS n, 3 AS found
      FROM documents WHERE lang = 'en' GROUP BY 1
      UNION ALL SELECT NULL, NULL, count(*), 4 FROM documents WHERE lang <> 'en' OR lang IS NULL HAVING count(*) > 0
      UNION ALL SELECT NULL, NULL, count(*), 1 FROM documents HAVING count(*) > 0""",
    "score_new_rejected": """SELECT id, updated_at, coalesce(reason, 'id repeated') AS rejected FROM (
      SELECT *, CASE WHEN id IS NULL THEN 'id missing' WHEN company_id IS NULL THEN 'company_id missing' WHEN amount IS NULL THEN 'amount missing'
      WHEN amount <= 0 THEN 'amount not positive' WHEN created_at IS NULL THEN 'created_at missing' WHEN deleted_at IS NOT NULL THEN 'deleted' END AS reason
      FROM (SELECT * REPLACE (CASE WHEN event_id % 400 = 39 THEN 'EXP_' || lpad(CAST(event_id - 1 AS varchar), 7, '0') ELSE id END AS id,
        updated_at + CASE WHEN late THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS updated_at)
        FROM raw CROSS JOIN (SELECT false AS late UNION ALL SELECT true) WHERE event_id % 40 = 39))
      QUALIFY reason IS NOT NULL OR row_number() OVER (PARTITION BY id, reason IS NULL ORDER BY updated_at, created_at) > 1""",
    "stream_behavior": """SELECT id, round(user_rolling_mean_7d, 2) AS user_rolling_mean_7d, round(user_rolling_std_7d, 2) AS user_rolling_std_7d,
      round(days_since_last_tx, 6) AS days_since_last_tx, round(fraud_duplicate_score, 6) AS fraud_duplicate_score, 0 AS late
      FROM rolling JOIN gaps USING (id) LEFT JOIN p_duplicate USING (id)""",
    "neutral_documents": """SELECT '{"note": null, "matchingMediaIds": []}' AS metadata, NULL::varchar AS items, NULL::varchar AS shipping,
      count(*) AS n FROM raw HAVING count(*) > 0""",
    "schema_drift": "SELECT column_name, 'extra' AS finding FROM (DESCRIBE events) WHERE column_name NOT IN ("
    + ", ".join(f"'{c}'" for c in LEDGER_COLUMNS) + ") UNION ALL SELECT c, 'missing' FROM unnest(["
    + ", ".join(f"'{c}'" for c in LEDGER_COLUMNS) + "]) t(c) WHERE c NOT IN (SELECT column_name FROM (DESCRIBE events))",
    "sql_dump_encoding": "SELECT id, 'd\u00e9p\u00f4t \u00e0 ' || shop_id AS metadata, amount, date_trunc('second', updated_at) AS updated_at FROM raw",
    "latest_batch_top": """SELECT id, 2 AS batch_id, amount, score_final FROM scored WHERE is_anomaly = 1 AND event_id % 3 = 2
      ORDER BY score_final DESC, id LIMIT 50""",
    "pseudonyms_second_export": """SELECT concat('EXP_', lpad(CAST(no AS varchar), 5, '0')) AS id, c.alias AS company_id, u.alias AS user_id,
      s.alias AS shop_id, p.alias AS supplier_id, amount FROM (SELECT *, row_number() OVER (ORDER BY updated_at, id) AS no FROM raw) r
      LEFT JOIN grown c ON c.col = 'company_id' AND c.v = r.company_id LEFT JOIN grown u ON u.col = 'user_id' AND u.v = r.user_id
      LEFT JOIN grown s ON s.col = 'shop_id' AND s.v = r.shop_id LEFT JOIN grown p ON p.col = 'supplier_id' AND p.v = r.supplier_id""",
    "csv_roundtrip": """SELECT id, amount, created_at, '{"note": "it''s \\\\ fine, ok"}' AS metadata, 1::bigint AS state FROM raw""",
    "json_roundtrip": "SELECT id, amount, created_at, user_id FROM raw",
    "parquet_roundtrip": "SELECT id, amount, created_at, 1::bigint AS state FROM raw",
    "knn_edges": """SELECT vid, rank, nid, round(d, 5) AS d FROM (SELECT lpad(CAST(a.vec_id AS varchar), 12, '0') AS vid,
      lpad(CAST(b.vec_id AS varchar), 12, '0') AS nid, list_distance(a.embedding::double[], b.embedding::double[]) AS d,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id) - 1 AS rank
      FROM embeddings a CROSS JOIN embeddings b) WHERE rank < 5""",
}

_row_key = (
    "concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate, l_tax, l_discount, l_extendedprice)"
)
_ranked = ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::double AS k_{c}"
    for c in CORRELATION_COLUMNS
)
SQL["spearman_matrix"] = " UNION ALL ".join(
    f"SELECT '{a}' AS first, '{b}' AS second, round(corr(k_{a}, k_{b}), 6) AS rho FROM ranked"
    for a in CORRELATION_COLUMNS
    for b in CORRELATION_COLUMNS
)
CTES["ranked"] = f"SELECT {_ranked} FROM imputed"
CTES["lines"] = f"""SELECT {_row_key} AS id, o_custkey AS user_id, l_suppkey AS supplier_id, l_extendedprice AS amount,
    epoch_us(o_orderdate) AS us FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
SQL["fraud_splitting_dates"] = f"""SELECT a.id, count(*) AS n, round(sum(b.amount), 2) AS s FROM lines a JOIN lines b
    ON a.user_id = b.user_id AND a.supplier_id = b.supplier_id AND (b.us, b.id) < (a.us, a.id) AND b.us >= a.us - {5 * DAY}
    GROUP BY a.id HAVING count(*) >= 2"""

# The detectors over all pairs of the standardised rows.
_spread = ", ".join(
    f"({c} - a_{c}) / CASE WHEN s_{c} <= 1e-14 * abs(a_{c}) OR s_{c} = 0 THEN 1 ELSE s_{c} END" for c in MATRIX_COLUMNS
)
CTES["spots"] = f"""SELECT row_number() OVER (ORDER BY id) AS vid, id, [{_spread}]::double[{len(MATRIX_COLUMNS)}] AS v
    FROM imputed CROSS JOIN scaling"""
CTES["closest"] = """SELECT a.vid, min({'d': array_distance(a.v, b.v), 'n': b.vid}, 21) AS l FROM spots a CROSS JOIN spots b GROUP BY a.vid"""
CTES["meets"] = """SELECT vid, r, e.d AS d, e.n AS nid FROM (SELECT vid, unnest(l) AS e, generate_subscripts(l, 1) AS r FROM closest)"""
CTES["kdists"] = "SELECT vid, max(d) AS kdist FROM meets WHERE r > 1 GROUP BY vid"
CTES["densities"] = """SELECT m.vid, 1 / (sum(greatest(m.d, k.kdist)) / 20 + 1e-10) AS lrd FROM meets m JOIN kdists k ON k.vid = m.nid
    WHERE r > 1 GROUP BY m.vid"""
_factor = "sum(lrd) FILTER ({0}) / 20 * (sum(greatest(d, kdist)) FILTER ({0}) / 20 + 1e-10)"
CTES["factors"] = f"""SELECT m.vid, {_factor.format('r <= 20')} AS lof, {_factor.format('r > 1')} AS lof_fit
    FROM meets m JOIN kdists k ON k.vid = m.nid JOIN densities s ON s.vid = m.nid GROUP BY m.vid"""
CTES["lof_span"] = "SELECT min(lof) AS low, max(lof) AS high, quantile_cont(lof_fit, 0.95) AS cut FROM factors"
CTES["lofs"] = """SELECT id, least(greatest((lof - low) / (high - low), 0.0), 1.0) AS score_lof, CAST(lof > cut AS int) AS anomaly_lof
    FROM factors CROSS JOIN lof_span JOIN spots USING (vid)"""
CTES["radius"] = "SELECT greatest(quantile_cont(d, 0.5), 0.5) AS eps FROM meets WHERE r = 5"
CTES["cores"] = "SELECT vid, v FROM spots JOIN meets USING (vid) CROSS JOIN radius WHERE r = 5 AND d <= eps"
CTES["ties"] = """SELECT a.vid AS a, b.vid AS b FROM cores a CROSS JOIN cores b CROSS JOIN radius
    WHERE a.vid <> b.vid AND array_distance(a.v, b.v) <= eps"""
CTES["grouped"] = """SELECT vid, comp FROM (WITH RECURSIVE reach(vid, comp) USING KEY (vid) AS (SELECT vid, vid FROM cores UNION
    SELECT t.b, min(reach.comp) FROM reach JOIN ties t ON t.a = reach.vid JOIN recurring.reach old ON old.vid = t.b
    WHERE reach.comp < old.comp GROUP BY t.b) SELECT * FROM reach)"""
CTES["labels_of"] = """SELECT vid, comp AS label FROM grouped UNION ALL
    SELECT m.vid, min(comp) FROM meets m JOIN grouped g ON g.vid = m.nid CROSS JOIN radius
    WHERE r <= 5 AND d <= eps AND m.vid NOT IN (SELECT vid FROM cores) GROUP BY m.vid"""
CTES["sizes_of"] = "SELECT label, count(*) AS size FROM labels_of GROUP BY label"
CTES["votes"] = """SELECT m.vid, avg(d) AS mean FROM meets m WHERE r <= 5 GROUP BY m.vid"""
CTES["choices"] = """SELECT m.vid, label, size FROM meets m JOIN labels_of l ON l.vid = m.nid JOIN sizes_of USING (label) WHERE r <= 5
    GROUP BY m.vid, label, size QUALIFY row_number() OVER (PARTITION BY m.vid ORDER BY count(*) DESC, label) = 1"""
CTES["dbs"] = """SELECT id, CASE WHEN mean > eps THEN least(mean / (eps * 2), 1.0) WHEN label IS NULL THEN 0.8 WHEN size < 3 THEN 0.6
    ELSE least(mean / eps * 0.4, 0.4) END::double AS score_dbscan
    FROM votes CROSS JOIN radius LEFT JOIN choices USING (vid) JOIN spots USING (vid)"""
CTES["dbs_cut"] = "SELECT quantile_cont(score_dbscan, 0.95) AS cut FROM dbs"
CTES["dbscans"] = "SELECT id, score_dbscan, CAST(score_dbscan >= cut AS int) AS anomaly_dbscan FROM dbs CROSS JOIN dbs_cut"
SQL["lof_scores"] = "SELECT id, round(score_lof, 5) AS score_lof, anomaly_lof FROM lofs"
SQL["dbscan_scores"] = "SELECT id, round(score_dbscan, 5) AS score_dbscan, anomaly_dbscan FROM dbscans"
SQL["sample_rows"] = "SELECT id, amount FROM base ORDER BY md5(concat('42/', id)), id LIMIT 100"
SQL["audit_columns"] = f"""SELECT id, amount, round(score_rules, 4) AS score_rules, rules_triggered, anomaly_rules,
    round(score_lof, 4) AS score_lof, anomaly_lof, round(score_dbscan, 4) AS score_dbscan, anomaly_dbscan, is_fraud_pattern,
    {', '.join(f'round({c}, 4) AS {n}' for n, c in PATTERN_COLUMNS.items())}
    FROM ruled JOIN patt USING (id) JOIN lofs USING (id) JOIN dbscans USING (id)"""

SQL["matrix_quantiles"] = " UNION ALL ".join(
    f"SELECT '{c}' AS name, " + ", ".join(f"round(quantile_cont({c}::double, {p}), 6) AS q{int(p * 100):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))
    + " FROM encoded"
    for c in MATRIX_COLUMNS
)
SQL.update({f"{name}_sliced": SQL[name] for name in SLICED})

_simple = [r for r in _rules if r.name in SIMPLE]
_simple_score = "(0.0" + "".join(f" + {_flag_sql[r.name]} * {r.weight}::double" for r in _simple) + f") / {_weight!r}::double"
_simple_text = "concat_ws(' | ', " + ", ".join(
    f"CASE WHEN {_flag_sql[r.name]} = 1 THEN {_quote(r.description)} END" for r in _simple
) + ")"
SQL["flagship"] = f"""SELECT id, user_id, amount, round({_simple_score}, 6) AS score_rules, {_simple_text} AS rules_triggered
    FROM feat ORDER BY {_simple_score} DESC, amount DESC, id LIMIT 20"""


def _with_arrivals(select: str) -> str:
    """A statement over the ledger in which accepted arrivals stand in for the rows of their ids."""
    both = """SELECT * FROM come UNION ALL SELECT * FROM sent WHERE event_id % 40 <> 39 AND id NOT IN (SELECT id FROM come)"""
    come = """SELECT * REPLACE (CASE WHEN event_id % 400 = 39 THEN concat('EXP_', lpad(CAST(event_id - 1 AS varchar), 7, '0'))
        ELSE id END AS id, coalesce(status, 'pending') AS status) FROM sent WHERE event_id % 40 = 39 AND amount > 0 AND deleted_at IS NULL"""
    plain = f"raw AS MATERIALIZED ({CTES['raw']})"
    changed = f"sent AS MATERIALIZED ({CTES['raw']}), come AS MATERIALIZED ({come}), raw AS MATERIALIZED ({both})"
    return build(select).replace(plain, changed)


_rounded = ", ".join(f"round({c}, {digits}) AS {c}" for c, digits in INCREMENTAL.items())


def oracle_sql() -> dict[str, str]:
    arrived = _with_arrivals(
        f"SELECT id, {_rounded}, user_typical_source, user_typical_expense_type FROM encoded WHERE event_id % 80 = 79"
    )
    return {**{name: build(text) for name, text in SQL.items()}, "incremental_features": arrived}
