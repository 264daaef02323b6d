import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import LEDGER, frame, ledger_row
from ledgersift.config import AuditConfig
from ledgersift.operators import ensemble, reports
from ledgersift.plans import audit as pipeline
from ledgersift.streaming.microbatch import latest_top, score_stream

CFG = AuditConfig(trees=40)


@pytest.fixture(scope="module")
def scored(ledger):
    from ledgersift.session import materialize

    return materialize(pipeline.audit(ledger, CFG, with_features=True))


@pytest.fixture(scope="module")
def models(ledger):
    return pipeline.fit(ledger, CFG)


def test_audit_contract(scored):
    assert scored.count() == 118
    for column in [*ensemble.SCORES, "score_final", *ensemble.PATTERN_COLUMNS]:
        low, high = scored.agg(F.min(column), F.max(column)).first()
        assert 0 <= low <= high <= 1, column
    for column in [*ensemble.FLAGS, "is_anomaly"]:
        assert {r[0] for r in scored.select(column).distinct().collect()} <= {0, 1}
    assert scored.orderBy(F.desc("score_final")).first().id == "EXP_00037"


def test_top_and_summary(scored):
    top = [r.score_final for r in reports.top_anomalies(scored, 10).collect()]
    assert top == sorted(top, reverse=True) and len(top) == 10
    row = reports.audit_summary(scored).first()
    assert row.total_transactions == 118 and row.total_anomalies >= 1
    assert row.anomaly_amount_max >= 9_250_000


def test_policies(spark):
    base = dict.fromkeys(ensemble.SCORES, 0.0) | {"is_fraud_pattern": 0, "anomaly_rules": 0}
    cases = [base, base | {"anomaly_rules": 1}, base | {"score_if": 0.8, "score_lof": 0.75}, base | {"is_fraud_pattern": 1}]
    df = spark.createDataFrame([{"id": str(i), **c} for i, c in enumerate(cases)])
    assert [r.is_anomaly for r in ensemble.decide(df).orderBy("id").collect()] == [0, 0, 0, 1]
    assert [r.is_anomaly for r in ensemble.decide(df, policy="online").orderBy("id").collect()] == [0, 1, 1, 1]
    with pytest.raises(ValueError):
        ensemble.decide(df, policy="other")


def test_new_rows(spark, ledger, models):
    sunday = dt.datetime(2026, 5, 10, 2, 15)
    new = frame(spark, [
        ledger_row(900, user_id="NEW", amount=1e9, created_at=sunday, updated_at=sunday),
        ledger_row(901, amount=-500.0),
        ledger_row(902, created_at=None),
        # An id the history already knows: the new row counts.
        ledger_row(3, amount=22222.0),
    ])
    results, rejected = pipeline.score_new(ledger, new, models, CFG)
    got = {r.id: r for r in results.collect()}
    assert set(got) == {"EXP_00900", "EXP_00003"}
    assert got["EXP_00900"].is_anomaly == 1 and got["EXP_00900"].score_final > 0.40
    assert got["EXP_00003"].amount == 22222.0
    assert {r.id: r.rejected for r in rejected.collect()} == {
        "EXP_00901": "amount not positive", "EXP_00902": "created_at missing",
    }


def test_saved_models_score_alike(spark, ledger, models, tmp_path):
    models.save(spark, str(tmp_path / "m"))
    loaded = pipeline.AuditModels.load(spark, str(tmp_path / "m"))
    assert loaded.info == models.info and loaded.info["n_features"] == 27
    new = frame(spark, [ledger_row(900, amount=77777.0), ledger_row(905)])
    a = {r.id: r for r in pipeline.score_new(ledger, new, models, CFG)[0].collect()}
    b = {r.id: r for r in pipeline.score_new(ledger, new, loaded, CFG)[0].collect()}
    assert a == b


def test_stream(spark, ledger, models, tmp_path):
    arrivals = str(tmp_path / "in")
    frame(spark, [ledger_row(900, amount=9e8), ledger_row(901, amount=-1.0)]).write.parquet(arrivals)
    stream = spark.readStream.schema(LEDGER).parquet(arrivals)
    q = score_stream(stream, ledger, models, str(tmp_path / "out"), str(tmp_path / "cp"), CFG)
    q.awaitTermination(300)
    assert [r.id for r in latest_top(spark, str(tmp_path / "out")).collect()] == ["EXP_00900"]
    assert spark.read.parquet(str(tmp_path / "out" / "rejected")).count() == 1
    with pytest.raises(ValueError):
        latest_top(spark, str(tmp_path / "out"), 0)


def test_gini_and_benford(spark, sliced):
    import numpy as np

    v = np.round(np.random.default_rng(2).lognormal(8, 2, 300), 0) + 1
    df = spark.createDataFrame([(float(x),) for x in v], "amount double")
    s = np.sort(v)
    n = len(s)
    want = (2 * (np.arange(1, n + 1) * s).sum() - (n + 1) * s.sum()) / (n * s.sum())
    assert reports.gini(df).first().gini == pytest.approx(want)
    assert reports.gini(df, cfg=sliced).first().gini == pytest.approx(want)
    rows = reports.benford(df).orderBy("digit").collect()
    assert sum(r.n for r in rows) == n
    counts = [sum(str(int(x))[0] == str(d) for x in v) for d in range(1, 10)]
    assert [r.n for r in rows] == counts
