"""Aggregate reports over a scored ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.config import CORRELATION_COLUMNS, DEFAULT, AuditConfig
from ledgersift.functions.scalar import first_digit
from ledgersift.operators.ensemble import PATTERN_COLUMNS, SCORES, weights
from ledgersift.operators.quantiles import distinct_values, quantiles, value_blocks
from ledgersift.operators.rules import rule_set
from ledgersift.operators.skew import attach, largest_group
from ledgersift.session import materialize


def flagged() -> Column:
    return F.col("is_anomaly") == 1


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage, 0 when the whole is 0."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(F.lit(0.0))


def top_anomalies(df: DataFrame, n: int = 20, only_flagged: bool = False) -> DataFrame:
    rows = df.where(flagged()) if only_flagged else df
    return rows.orderBy(F.desc("score_final"), "id").limit(n)


def recent_alerts(df: DataFrame, n: int = 8) -> DataFrame:
    return df.where(flagged()).orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def audit_summary(df: DataFrame) -> DataFrame:
    """Counts, rates, mean scores, detector and pattern counts, amounts at risk."""
    risk = F.when(flagged(), F.col("amount"))
    agreed = (
        (F.col("anomaly_if") == 1) & (F.col("anomaly_lof") == 1) & (F.col("anomaly_rules") == 1)
    )
    count = F.count(F.lit(1))
    hits = F.count_if(flagged())
    return df.agg(
        count.alias("total_transactions"),
        hits.alias("total_anomalies"),
        share(hits, count).alias("anomaly_rate_pct"),
        F.round(F.avg("score_final"), 4).alias("avg_score_final"),
        F.coalesce(F.round(F.avg(F.when(flagged(), F.col("score_final"))), 4), F.lit(0.0)).alias(
            "avg_score_anomalies"
        ),
        *[
            F.count_if(F.col(c) == 1).alias(n)
            for n, c in {
                "flagged_if": "anomaly_if",
                "flagged_lof": "anomaly_lof",
                "flagged_dbscan": "anomaly_dbscan",
                "flagged_rules": "anomaly_rules",
                "flagged_fraud": "is_fraud_pattern",
            }.items()
        ],
        F.count_if(agreed).alias("consensus_3_models"),
        *[F.count_if(F.col(c) > 0).alias(f"n_{c}") for c in PATTERN_COLUMNS],
        F.sum(risk).cast("long").alias("anomaly_amount_total"),
        F.max(risk).cast("long").alias("anomaly_amount_max"),
        F.avg(risk).cast("long").alias("anomaly_amount_mean"),
    )


def exposure(df: DataFrame) -> DataFrame:
    """Amount audited and at risk, mean scores and how far the classes are apart."""
    risk = F.sum(F.when(flagged(), F.col("amount")).otherwise(F.lit(0.0)))
    hit = F.avg(F.when(flagged(), F.col("score_final")))
    rest = F.avg(F.when(~flagged(), F.col("score_final")))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(flagged()).alias("anomalies"),
        share(F.count_if(flagged()), F.count(F.lit(1))).alias("anomaly_rate_pct"),
        F.sum("amount").alias("total_amount"),
        risk.alias("risk_amount"),
        share(risk, F.sum("amount")).alias("risk_share_pct"),
        F.round(F.avg("score_final"), 4).alias("mean_score"),
        F.round(F.coalesce(hit, F.lit(0.0)), 4).alias("mean_score_anomalies"),
        F.round(F.when(rest > 0, F.coalesce(hit, F.lit(0.0)) / rest).otherwise(1.0), 4).alias(
            "separation"
        ),
    )


def batch_summary(df: DataFrame) -> DataFrame:
    hits = F.count_if(flagged())
    count = F.count(F.lit(1))
    return df.agg(
        count.alias("total"),
        hits.alias("n_anomalies"),
        share(hits, count).alias("anomaly_rate"),
        F.coalesce(F.sum(F.when(flagged(), F.col("amount"))), F.lit(0.0)).alias(
            "anomaly_amount_total"
        ),
    )


def top_groups(df: DataFrame, column: str, n: int) -> DataFrame:
    """The values of ``column`` with most alerts and the amount behind them."""
    return (
        df.where(flagged() & F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("id").alias("alerts"), F.sum("amount").alias("amount"))
        .orderBy(F.desc("alerts"), column)
        .limit(n)
    )


def monthly_trend(df: DataFrame) -> DataFrame:
    hits, count = F.count_if(flagged()), F.count("id")
    return df.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        count.alias("total"), hits.alias("anomalies"), F.round(hits * 100.0 / count, 1).alias("rate_pct")
    )


def daily_volume(df: DataFrame) -> DataFrame:
    return df.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(flagged()).alias("anomalies")
    )


def category_benchmark(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Per expense type: median, mean and maximum amount."""
    middle = quantiles(df, ["expense_type"], "amount", [0.5], "q", cfg.limits)
    stats = (
        df.where(F.col("expense_type").isNotNull())
        .groupBy("expense_type")
        .agg(F.avg("amount").alias("mean_amount"), F.max("amount").alias("max_amount"))
    )
    return stats.join(middle, "expense_type").select(
        "expense_type", F.col("q")[0].alias("median_amount"), "mean_amount", "max_amount"
    )


def describe_amounts(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Extremes, percentiles, moments and bias-corrected skewness of the amounts."""
    cuts = [0.25, 0.5, 0.75, 0.95, 0.99]
    n = F.count("amount")
    fix = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    moments = df.agg(
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
        F.avg("amount").alias("mean_amount"),
        F.stddev_samp("amount").alias("std_amount"),
        (F.skewness("amount") * fix).alias("skew_amount"),
        (F.skewness(F.log1p("amount")) * fix).alias("skew_log_amount"),
    ).withColumn("_one", F.lit(1))
    ranks = quantiles(df, [], "amount", cuts, "q", cfg.limits).withColumn("_one", F.lit(1))
    named = [F.col("q")[i].alias(f"p{int(c * 100)}") for i, c in enumerate(cuts)]
    return moments.join(ranks, "_one").select(
        *[c for c in moments.columns if c != "_one"], *named
    )


def value_counts(df: DataFrame, column: str, n: int = 8) -> DataFrame:
    """Most frequent values with their share of all rows.

    The total is the sum of the group counts, so the table is read once.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.lit(1).alias("_one"))
    return (
        counts.where(F.col(column).isNotNull())
        .orderBy(F.desc("n"), column)
        .limit(n)
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")
        .select(column, "n", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("share_pct"))
    )


def filled_profile(df: DataFrame, column: str, size: int) -> DataFrame:
    """Counts for 0..size-1, zero where nothing was seen."""
    counts = df.groupBy(F.col(column).cast("long").alias(column)).agg(F.count(F.lit(1)).alias("n"))
    bins = df.sparkSession.range(size).withColumnRenamed("id", column)
    return bins.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def sensitivity(df: DataFrame, limit: float = 3.0) -> DataFrame:
    """How many rows each amount test would flag."""
    return df.agg(
        F.count_if(F.col("amount_zscore_global") > limit).alias("z_global"),
        F.count_if(F.col("amount_zscore_per_user") > limit).alias("z_user"),
        F.count_if(F.col("amount_iqr_flag_global") == 1).alias("iqr_global"),
        F.count_if(F.col("amount_iqr_flag_per_user") == 1).alias("iqr_user"),
        share(F.count_if(F.col("amount_iqr_flag_global") == 1), F.count(F.lit(1))).alias(
            "iqr_global_pct"
        ),
        share(F.count_if(F.col("amount_iqr_flag_per_user") == 1), F.count(F.lit(1))).alias(
            "iqr_user_pct"
        ),
    )


BREAK_FLAGS = [
    "tx_daily_count_flag",
    "rolling_amount_spike_flag",
    "is_unusual_source_for_user",
    "is_unusual_type_for_user",
]


def rates(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Per 0/1 column: how many rows are 1, and their share."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c) == 1).alias(c) for c in columns])
    return one.unpivot(["_rows"], columns, key, "n").select(
        key, "n", share(F.col("n"), F.col("_rows")).alias("rate_pct")
    )


def break_classes(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Rows by kind of break: volume and amount together, amount only, none."""
    spike = F.col("amount_vs_rolling_mean_ratio") > cfg.spike_ratio
    kind = (
        F.when((F.col("tx_daily_count") > cfg.max_daily) & spike, "double")
        .when(spike, "amount")
        .otherwise("none")
    )
    return df.groupBy(kind.alias("break_class")).agg(F.count(F.lit(1)).alias("n"))


def consensus(df: DataFrame) -> DataFrame:
    """Rows by the number of detectors that flag them (0 to 3)."""
    votes = F.col("anomaly_if") + F.col("anomaly_lof") + F.col("anomaly_dbscan")
    return filled_profile(df.withColumn("votes", votes), "votes", 4)


def rule_rates(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    return rates(df, [r.name for r in rule_set(cfg)], "rule")


def detector_means(df: DataFrame) -> DataFrame:
    """Mean score per detector for flagged and for other rows."""
    means = []
    for c in SCORES:
        means += [
            F.avg(F.when(~flagged(), F.col(c))).alias(f"n_{c}"),
            F.avg(F.when(flagged(), F.col(c))).alias(f"a_{c}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("detector"),
                F.round(F.col(f"n_{c}"), 6).alias("mean_normal"),
                F.round(F.col(f"a_{c}"), 6).alias("mean_anomaly"),
            )
            for c in SCORES
        ]
    )
    return df.agg(*means).select(F.inline(rows))


def contribution(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Share of each pillar in the blended score of the flagged rows."""
    parts = {c: F.avg(F.when(flagged(), F.col(c))) * w for c, w in weights(cfg).items()}
    one = df.agg(*[v.alias(c) for c, v in parts.items()])
    whole = sum((F.col(c) for c in SCORES[1:]), F.col(SCORES[0]))
    return (
        one.withColumn("_whole", whole)
        .unpivot(["_whole"], SCORES, "pillar", "part")
        .select("pillar", F.round(F.col("part") * 100.0 / F.col("_whole"), 4).alias("share_pct"))
    )


SWEEP = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60]


def threshold_sweep(
    df: DataFrame, thresholds: list[float] = SWEEP, or_fraud: bool = False
) -> DataFrame:
    """Count, rate and amount at or over each threshold, in one pass over the rows."""
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, t in enumerate(thresholds):
        hit = F.col("score_final") >= t
        if or_fraud:
            hit = hit | (F.col("is_fraud_pattern") == 1)
        aggs += [
            F.count_if(hit).alias(f"n{i}"),
            F.sum(F.when(hit, F.col("amount")).otherwise(F.lit(0.0))).alias(f"a{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(t).alias("threshold"),
                F.col(f"n{i}").alias("anomalies"),
                share(F.col(f"n{i}"), F.col("_rows")).alias("rate_pct"),
                F.col(f"a{i}").alias("amount"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def histogram(df: DataFrame, value: Column, low: float, width: float, bins: int, by: str) -> DataFrame:
    """Counts and densities over equal bins per class; values outside go to the end bins."""
    raw = F.floor((value - low) / width)
    bucket = F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = (
        df.where(value.isNotNull())
        .groupBy(F.col(by), bucket.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy(by).agg(F.sum("n").alias("_all"))
    return counts.join(totals, by).select(
        by,
        "bin",
        (F.lit(low) + F.col("bin") * width).alias("bin_start"),
        "n",
        (F.col("n") / (F.col("_all") * width)).alias("density"),
    )


def box_stats(df: DataFrame, by: str, value: str, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Quartiles and extremes per class."""
    cuts = quantiles(df, [by], value, [0.0, 0.25, 0.5, 0.75, 1.0], "q", cfg.limits)
    names = ["low", "q1", "median", "q3", "high"]
    return cuts.select(by, *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def spearman(
    df: DataFrame, columns: list[str] = CORRELATION_COLUMNS, cfg: AuditConfig = DEFAULT
) -> DataFrame:
    """Rank correlations of all column pairs (first, second, rho); rows with gaps are left out.

    Equal values of a column are merged before they are ranked, so ties never meet in one
    task: all columns together are ranked as one table of (column, value, count), whose
    positions give the average ranks. The ranks go back to the rows by one join, and one
    aggregate sums the products of every pair. ``rho`` is null for a constant column and
    for a table without rows.
    """
    whole = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    # A zero has one rank whatever its sign.
    cells = F.array(*[F.struct(F.lit(i).alias("c"), (F.col(c) + 0.0).alias("v")) for i, c in enumerate(columns)])
    rows = materialize(whole.select(F.monotonically_increasing_id().alias("_row"), cells.alias("_cells")))
    n = rows.count()
    long = rows.select("_row", F.inline("_cells"))
    distinct = distinct_values(long.select(F.struct("c", "v").alias("_cell")), "_cell")
    blocks = value_blocks(long, ["c"], "v", cfg.limits, distinct)
    # Every column fills n positions; ranks are counted from its middle.
    middle = F.col("_first") - F.col("c") * F.lit(n) + (F.col("_count") - n) / 2.0
    ranks = materialize(blocks.select("c", "v", middle.alias("_rank")))
    if ranks.count() <= cfg.limits.broadcast_rows:
        placed = long.join(F.broadcast(ranks), ["c", "v"])
    else:
        placed = attach(long, ranks, ["c", "v"], largest_group(long, ["c", "v"]), cfg.limits, unique="_row", nulls=False)
    wide = placed.groupBy("_row").agg(
        *[F.max(F.when(F.col("c") == i, F.col("_rank"))).alias(f"r{i}") for i in range(len(columns))]
    )
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = wide.agg(*[F.sum(F.col(f"r{i}") * F.col(f"r{j}")).alias(f"s{i}_{j}") for i, j in pairs])
    entries = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            spread = F.sqrt(F.col(f"s{i}_{i}")) * F.sqrt(F.col(f"s{j}_{j}"))
            rho = F.lit(1.0) if i == j else F.col(f"s{min(i, j)}_{max(i, j)}") / spread
            entries.append(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.when(spread > 0, rho).alias("rho")))
    return sums.select(F.inline(F.array(*entries)))


def gini(df: DataFrame, value: str = "amount", cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Concentration of the positive amounts.

    Equal amounts form a block; the sum of its ranks has a closed form, so
    ranks are needed per distinct amount only.
    """
    positive = df.where(F.col(value) > 0)
    blocks = value_blocks(positive, [], value, cfg.limits, distinct_values(positive, value))
    first, n = F.col("_first").cast("double"), F.col("_count").cast("double")
    ranks = n * first + n * (n + 1) / 2
    sums = blocks.agg(
        F.sum(ranks * F.col(value)).alias("ranked"),
        F.sum(n * F.col(value)).alias("total"),
        F.sum(n).alias("n"),
    )
    value_of = (2 * F.col("ranked") - (F.col("n") + 1) * F.col("total")) / (
        F.col("n") * F.col("total")
    )
    return sums.select(
        F.coalesce(F.when(F.col("total") > 0, value_of), F.lit(0.0)).alias("gini")
    )


def benford(df: DataFrame, value: str = "amount") -> DataFrame:
    """First digits against their expected shares, with the chi-square test over all nine.

    With eight degrees of freedom the tail probability is a finite sum.
    """
    digits = (
        df.where(F.col(value) > 0)
        .groupBy(first_digit(F.col(value)).cast("long").alias("digit"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    nine = df.sparkSession.range(1, 10).withColumnRenamed("id", "digit")
    # Nine rows from here on, so an unpartitioned window is safe.
    whole = Window.partitionBy()
    full = nine.join(digits, "digit", "left").select(
        "digit",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.log10(1 + 1 / F.col("digit")).alias("p"),
    )
    total = F.nullif(F.sum("n").over(whole), F.lit(0))
    counted = full.withColumn("t", total)
    expected = F.col("p") * F.col("t")
    tested = counted.withColumn(
        "chi2", F.sum(F.pow(F.col("n") - expected, 2) / expected).over(whole)
    )
    half = F.col("chi2") / 2
    tail = F.exp(-half) * (1 + half + F.pow(half, 2) / 2 + F.pow(half, 3) / 6)
    return tested.select(
        "digit",
        "n",
        (F.col("n") * 100.0 / F.col("t")).alias("observed_pct"),
        (F.col("p") * 100.0).alias("expected_pct"),
        "chi2",
        tail.alias("p_value"),
    )


def pattern_counts(df: DataFrame, over: float = 0.0) -> DataFrame:
    """Rows per fraud pattern with a score over ``over``."""
    one = df.agg(*[F.count_if(F.col(c) > over).alias(c) for c in PATTERN_COLUMNS])
    return one.unpivot([], list(PATTERN_COLUMNS), "pattern", "n")


def supplier_rarity(df: DataFrame) -> DataFrame:
    """Rows with a supplier: covered share, rare and regular."""
    known = F.col("supplier_id").isNotNull()
    rare = F.col("is_rare_supplier") == 1
    return df.agg(
        F.count_if(known).alias("with_supplier"),
        share(F.count_if(known), F.count(F.lit(1))).alias("coverage_pct"),
        F.count_if(rare).alias("rare"),
        F.count_if(known & ~rare).alias("regular"),
        share(F.count_if(rare), F.count_if(known)).alias("rare_pct"),
    )


def rule_top_matrix(df: DataFrame, n: int = 20, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """Rules as rows, the top-n rows as columns r1..rn, flags as cells."""
    names = [r.name for r in rule_set(cfg)]
    top = top_anomalies(df.select("id", "score_final", *names), n)
    ranked = top.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("score_final"), "id"))
    )
    cells = ranked.unpivot(["rank"], names, "rule", "flag")
    wide = cells.groupBy("rule").pivot("rank", list(range(1, n + 1))).agg(F.max("flag"))
    return wide.select("rule", *[F.col(str(i)).alias(f"r{i}") for i in range(1, n + 1)])


def search(
    df: DataFrame, text: str = "", category: str | None = None, state: str = "all"
) -> DataFrame:
    """Rows whose id, user or supplier contains ``text``, of a category and a verdict."""
    out = df
    if state == "suspicious":
        out = out.where(flagged())
    elif state == "clean":
        out = out.where(~flagged())
    if category:
        out = out.where(F.col("expense_type") == category)
    wanted = text.strip().lower()
    if wanted:
        hits = [F.lower(c).contains(wanted) for c in ("id", "user_id", "supplier_id")]
        out = out.where(F.coalesce(hits[0], F.lit(False)) | F.coalesce(hits[1], F.lit(False)) | F.coalesce(hits[2], F.lit(False)))
    return out


def categories(df: DataFrame, column: str = "expense_type") -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def sample_rows(df: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """A reproducible sample: the rows with the smallest digests of seed and id."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}/"), F.col("id").cast("string"))), "id").limit(n)


def both_classes(df: DataFrame, by: str, labels: tuple[str, str]) -> DataFrame:
    """The two classes of a flag one after the other, labelled."""
    no, yes = df.where(F.col(by) != 1), df.where(F.col(by) == 1)
    return no.withColumn("class", F.lit(labels[0])).unionByName(
        yes.withColumn("class", F.lit(labels[1]))
    )
