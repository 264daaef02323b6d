import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA, by_id, frame, ledger_row
from ledgersift.config import DAY_US, HOUR_US, MATRIX_COLUMNS, AuditConfig, ScaleLimits
from ledgersift.functions.temporal import micros
from ledgersift.operators import features, matrix, patterns, quantiles
from ledgersift.operators.clean import clean, normalize
from ledgersift.operators.rolling import lookback
from ledgersift.operators.skew import attach, number_rows, previous_value
from ledgersift.session import materialize
from ledgersift.sources.fixture import raw_ledger


@pytest.fixture(scope="module")
def base(spark):
    return materialize(normalize(clean(raw_ledger(spark, TESTDATA))))


def same(a, b):
    a = a.toPandas().sort_values("id").reset_index(drop=True)
    b = b.toPandas().sort_values("id").reset_index(drop=True)
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for column in a.columns:
        if a[column].dtype.kind in "fi":
            assert np.allclose(a[column].astype(float), b[column].astype(float), rtol=1e-9, atol=1e-6, equal_nan=True), column
        else:
            assert (a[column].astype(str) == b[column].astype(str)).all(), column


def test_sliced_plans_give_the_same_features(base, sliced):
    same(features.enrich(base), features.enrich(base, sliced))


def test_tasks_grow_with_the_rows(base):
    cfg = AuditConfig(limits=ScaleLimits(task_rows=500))
    same(features.enrich(base), features.enrich(base, cfg))
    for step in (features.attach_users, features.add_supplier):
        sizes = [r["count"] for r in step(base, cfg).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == base.count() and max(sizes) <= 4 * 500


def test_hits_beyond_a_broadcast_join_in_more_tasks(base):
    cfg = AuditConfig(limits=ScaleLimits(task_rows=500, broadcast_rows=0))
    judged = patterns.add_patterns(base, cfg)
    same(patterns.add_patterns(base), judged)
    assert max(r["count"] for r in judged.groupBy(F.spark_partition_id()).count().collect()) <= 2 * 500


def test_few_keys_are_not_dealt(spark, base):
    stats = base.groupBy("expense_type").agg(F.count(F.lit(1)).alias("n"))
    plain = attach(base, stats, ["expense_type"], 10**5, ScaleLimits(task_rows=500), dealt=True)
    assert "REPARTITION" not in plain._jdf.queryExecution().toString()


def test_partitioning_does_not_matter(base):
    columns = ["id", "user_rolling_mean_7d", "days_since_last_tx", "tx_daily_count", "user_typical_source"]
    once = features.enrich(base.repartition(1)).select(*columns)
    same(once, features.enrich(base.repartition(23)).select(*columns))


def test_calendar_flags(ledger):
    rows = features.add_temporal(clean(ledger)).collect()
    for r in rows:
        assert r.day_of_week == r.created_at.weekday()
        assert r.is_weekend == int(r.created_at.weekday() >= 5)
        assert r.is_outside_hours == int(r.created_at.hour < 7 or r.created_at.hour >= 20)
        assert r.is_future_due == 1 and r.payment_delay_days is None


def test_outlier_has_a_high_score(ledger):
    out = features.add_amount_global(clean(ledger)).where("id = 'EXP_00037'").first()
    assert out.amount_zscore_global > 2 and out.amount_iqr_flag_global == 1


def test_rows_without_user(spark):
    rows = [ledger_row(i, user_id=None) for i in range(3)] + [ledger_row(9)]
    out = {r.id: r for r in features.enrich(normalize(frame(spark, rows))).collect()}
    lonely = out["EXP_00000"]
    assert lonely.user_tx_count is None and lonely.tx_daily_count is None
    assert lonely.is_unusual_source_for_user == 1 and lonely.days_since_last_tx == 0.0
    assert lonely.amount_zscore_per_user == 0.0 and lonely.amount_vs_rolling_mean_ratio == 1.0
    assert out["EXP_00009"].user_rolling_std_7d == 0.0


def brute_lookback(rows, length, prior_only):
    out = {}
    for key, group in rows.groupby("k"):
        g = group.sort_values(["_us", "id"])
        us, v, ids = g["_us"].to_numpy(), g["v"].to_numpy(), g["id"].to_numpy()
        for i in range(len(g)):
            if prior_only:
                inside = np.flatnonzero(us[:i] >= us[i] - length)
            else:
                inside = np.flatnonzero((us > us[i] - length) & (us <= us[i]))
            x = v[inside]
            out[ids[i]] = (len(x), x.sum(), ((x - x.mean()) ** 2).sum() if len(x) else 0.0)
    return out


@pytest.mark.parametrize("prior_only", [False, True])
@pytest.mark.parametrize("kind", ["plain", "sliced"])
def test_lookback_against_brute_force(spark, sliced, prior_only, kind):
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({
        "id": [f"R{i:04d}" for i in range(n)],
        # One key holds a third of all rows; times repeat.
        "k": np.where(rng.random(n) < 0.33, "hot", rng.integers(0, 12, n).astype(str)),
        "_us": rng.integers(0, 60, n) * HOUR_US,
        "v": rng.normal(1000, 300, n),
    })
    df = spark.createDataFrame(pdf)
    limits = (sliced if kind == "sliced" else AuditConfig()).limits
    got = lookback(df, ["k"], "v", 5 * HOUR_US, prior_only, limits).collect()
    want = brute_lookback(pdf, 5 * HOUR_US, prior_only)
    assert len(got) == n
    for r in got:
        cnt, s, m2 = want[r.id]
        assert r._n == cnt
        assert r._s == pytest.approx(s, rel=1e-9, abs=1e-6)
        assert r._m2 == pytest.approx(m2, rel=1e-6, abs=1e-3)


@pytest.mark.parametrize("prior_only", [False, True])
def test_dense_lookback_slides_no_frame(spark, prior_only):
    rng = np.random.default_rng(5)
    n = 1500
    pdf = pd.DataFrame({
        "id": [f"R{i:04d}" for i in range(n)], "k": np.where(np.arange(n) < 1300, "dense", "other"),
        "_us": rng.integers(0, 40 * HOUR_US, n) // 5_000_000 * 5_000_000, "v": rng.normal(1000, 300, n), "note": "x",
    })
    odd = [("N0", None, 7, 1.0, "x"), ("N1", "dense", None, 2.0, None), ("N2", None, None, 3.0, "x"), ("N3", "other", 9 * HOUR_US, None, None)]
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame(odd, "id string, k string, _us long, v double, note string"))
    out = lookback(df, ["k"], "v", 10 * HOUR_US, prior_only, ScaleLimits())
    # Some 300 rows lie in a window: no frame that is summed anew for each row.
    assert f"RangeFrame, -{10 * HOUR_US - (not prior_only)}" not in out._jdf.queryExecution().toString()
    got, want = by_id(out), brute_lookback(pdf, 10 * HOUR_US, prior_only)
    assert set(got) == {*pdf["id"], "N0", "N1", "N2", "N3"} and len(got) == out.count()
    assert out.columns[:5] == df.columns and got["N0"].note == "x" and got["N0"]._n is None and got["N2"]._n is None
    for i, (cnt, s, m2) in want.items():
        assert got[i]._n == cnt
        assert got[i]._s == pytest.approx(s, rel=1e-9, abs=1e-6)
        assert got[i]._m2 == pytest.approx(m2, rel=1e-6, abs=1e-3)
    slid = by_id(lookback(df, ["k"], "v", 10 * HOUR_US, prior_only, ScaleLimits(frame_mean=n)))
    for i in ("N0", "N1", "N2", "N3"):
        assert got[i] == pytest.approx(slid[i]) if i == "N3" else got[i] == slid[i]


def test_previous_value_with_a_hot_key(spark, sliced):
    pdf = pd.DataFrame({"id": [f"R{i:04d}" for i in range(300)], "k": ["hot"] * 200 + list("ab") * 50,
                        "t": np.random.default_rng(1).permutation(300)})
    out = previous_value(spark.createDataFrame(pdf), ["k"], ["t", "id"], "t", "p", sliced.limits).toPandas()
    want = pdf.sort_values("t").groupby("k")["t"].shift()
    got = out.set_index("id")["p"].reindex(pdf["id"]).to_numpy()
    assert np.allclose(got.astype(float), want.reindex(pdf.index).to_numpy(), equal_nan=True)


def test_attach_cuts_hot_keys(spark, sliced):
    rows = spark.range(500).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 40).cast("string")).alias("k"),
    )
    stats = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = attach(rows, stats, ["k"], 167, sliced.limits)
    assert out.count() == 500
    assert out.where("k is null and n is not null").count() == 0
    wrong = out.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n")).where("c <> n")
    assert wrong.count() == 0


def test_attach_scatters_rows_without_key(spark):
    rows = spark.range(4000).selectExpr("cast(id AS string) AS id", "CASE WHEN id % 4 > 0 THEN id % 40 END AS k")
    stats = spark.range(40).selectExpr("id AS k", "id * 2 AS twice")
    name, wanted = "spark.sql.autoBroadcastJoinThreshold", "-1"
    before = spark.conf.get(name)
    spark.conf.set(name, wanted)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = attach(rows, stats, ["k"], 100, AuditConfig().limits)
        got = joined.select("k", "twice", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set(name, before)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(got) == 4000 and all(r["twice"] == (None if r["k"] is None else 2 * r["k"]) for r in got)
    assert len({r["task"] for r in got if r["k"] is None}) > 1


def test_quantiles_by_position(spark, sliced):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 300, p=[0.6, 0.3, 0.1]), "v": np.round(rng.normal(0, 10, 300), 1)})
    probs = [0.0, 0.25, 0.6, 0.9, 1.0]
    got = {r.k: r.q for r in quantiles.quantiles(spark.createDataFrame(pdf), ["k"], "v", probs, "q", sliced.limits).collect()}
    for key, group in pdf.groupby("k"):
        assert np.allclose(got[key], group["v"].quantile(probs))
    whole = quantiles.table_quantiles(spark.createDataFrame(pdf), "v", probs, sliced.limits)
    assert np.allclose(whole, pdf["v"].quantile(probs))


def test_numbering(spark, sliced):
    df = spark.range(100).select(F.format_string("%03d", F.lit(99) - F.col("id")).alias("id"))
    out = number_rows(df, ["id"], "n", 100, sliced.limits).collect()
    assert all(int(r.id) + 1 == r.n for r in out)


def test_matrix_has_no_gaps(base):
    imputed = matrix.impute(matrix.encode(features.enrich(base).withColumn("payment_delay_days", F.lit(None).cast("double"))))
    pdf = imputed.toPandas()
    assert list(pdf.columns) == ["id", *MATRIX_COLUMNS]
    assert not pdf.isna().any().any() and (pdf["payment_delay_days"] == 0).all()
    scaled = matrix.standardize(imputed, matrix.scale_parameters(imputed, MATRIX_COLUMNS)).toPandas()
    assert abs(scaled["amount"].mean()) < 1e-9 and scaled["amount"].std(ddof=0) == pytest.approx(1)


def test_codes_follow_sorted_values(spark, sliced):
    rows = [ledger_row(i, status=s) for i, s in enumerate(["b", "a", None, "c", "a"])]
    for cfg in (AuditConfig(), sliced):
        out = matrix.encode(frame(spark, rows), ["status"], cfg).orderBy("id").collect()
        assert [r.status_encoded for r in out] == [1, 0, -1, 2, 0]


def test_week_shift_keeps_features(base):
    from ledgersift.operators.anonymize import shift_dates

    columns = ["id", "day_of_week", "hour_of_day", "is_outside_hours", "payment_delay_days",
               "user_rolling_mean_7d", "days_since_last_tx", "tx_daily_count"]
    same(features.enrich(base).select(*columns), features.enrich(shift_dates(base)).select(*columns))


def test_micros(base):
    r = base.select((micros("created_at") % DAY_US).alias("x"), F.hour("created_at").alias("h")).first()
    assert r.x // HOUR_US == r.h


def test_modes_do_not_count_nulls_at_any_size(spark, sliced):
    rows = [ledger_row(i, user_id="A", source=None if i < 5 else "A", expense_type=None) for i in range(8)]
    for cfg in (AuditConfig(), sliced):
        got = features.user_statistics(frame(spark, rows), cfg).first()
        assert got["user_typical_source"] == "A" and got["user_typical_expense_type"] is None
