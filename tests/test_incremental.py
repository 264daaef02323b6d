import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import by_id, frame, ledger_row
from ledgersift.config import DEFAULT, ScaleLimits
from ledgersift.operators.order_counts import block_of, block_totals, counted_quantiles, value_counts
from ledgersift.plans import audit as pipeline
from ledgersift.plans.incremental import LedgerState, _with, _without


@pytest.fixture
def state(ledger, tmp_path):
    return LedgerState.build(ledger, str(tmp_path / "state"), 8)


def whole(raw, new):
    """The same features by way of the whole ledger, and that ledger."""
    both = pipeline.with_history(raw, pipeline.split_scorable(new)[0]).drop("is_new")
    ids = {r.id for r in pipeline.split_scorable(new)[0].select("id").collect()}
    rows = by_id(pipeline.featured(pipeline.staged_ledger(both)))
    return {i: rows[i] for i in ids}, both


def same(got, want):
    assert set(got) == set(want)
    for i, row in want.items():
        for c in row.asDict():
            a, b = got[i][c], row[c]
            assert a == (pytest.approx(b, rel=1e-9, abs=1e-9) if isinstance(b, float) else b), (i, c)


def test_three_changes_equal_full_recomputation(spark, ledger, state):
    at = dt.datetime(2025, 12, 20, 3)
    changes = [
        # A new user, a known id that moves to another user with another supplier, refused rows.
        [ledger_row(900, user_id="NEW", supplier_id="S_NEW", expense_type="brand_new"), ledger_row(3, user_id="AGENT_1", supplier_id=None, amount=22222.0),
         ledger_row(901, amount=-5.0), ledger_row(902, deleted_at=at), ledger_row(900, updated_at=at)],
        # The moved row goes back, the largest amount is replaced, a row without user and one without supplier.
        [ledger_row(3, amount=1.5), ledger_row(37, amount=9.0, created_at=at), ledger_row(903, user_id=None), ledger_row(904, supplier_id=None)],
        [],
        # The only row of a category and of a user is replaced by another one.
        [ledger_row(900, user_id="AGENT_2"), ledger_row(905, user_id="AGENT_1"), ledger_row(906, user_id="AGENT_1")],
    ]
    raw = ledger
    for rows in changes:
        new = frame(spark, rows)
        change = state.change(new)
        if rows:
            want, raw = whole(raw, new)
            same(by_id(state.features(change)), want)
            assert change.refused.count() == len(rows) - len(want)
        state.apply(change)
    assert state.version == 4


def test_history_without_rows(spark, ledger, tmp_path):
    state = LedgerState.build(ledger.where("id IS NULL"), str(tmp_path / "s"), 8)
    new = frame(spark, [ledger_row(1), ledger_row(8), ledger_row(2)])
    want, _ = whole(ledger.where("id IS NULL"), new)
    same(by_id(state.features(state.change(new))), want)


def scanned(df):
    """Rows and files that the scans of a query have read."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run = df.select("*")
        plan = run._jdf.queryExecution().executedPlan()
        run._jdf.queryExecution().toRdd().count()
        leaves = plan.collectLeaves()
        metrics = [leaves.apply(i).metrics() for i in range(leaves.size())]
        return [(m.apply("numOutputRows").value(), m.apply("numFiles").value()) for m in metrics if m.contains("numFiles")]
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def test_only_touched_buckets_are_read(spark, ledger, state):
    change = state.change(frame(spark, [ledger_row(900, user_id="AGENT_3")]))
    rows = state.touched_rows(change)
    assert {r.user_id for r in rows.collect()} == {"AGENT_3"}
    total = state._read("rows").count()
    buckets = state._read("rows").groupBy("bucket").count()
    home = F.pmod(F.xxhash64(F.lit("AGENT_3")), F.lit(8))
    shared = buckets.where(F.col("bucket") == home).first()["count"]
    read = scanned(rows)
    assert max(n for n, _ in read) == shared < total


@pytest.mark.parametrize("limits", [DEFAULT.limits, ScaleLimits(group_rows=3, slices=4)])
def test_quantiles_under_additions_and_removals(spark, limits):
    draw = random.Random(4)
    held = [draw.choice((0.0, 5.0, -3.25, 1e-300, 1e300, 77.0, -1e9, draw.lognormvariate(3, 4))) for _ in range(300)]
    probs = [0.0, 0.25, 0.6, 0.75, 0.9, 0.95, 1.0]

    def table(values):
        return spark.createDataFrame([(v,) for v in values], "v double")

    counts = value_counts(table([*held, None]), "v")
    totals = block_totals(counts)
    assert counted_quantiles(counts, totals, probs, limits) == pytest.approx(np.quantile(held, probs).tolist())
    gone, more = held[::3], [4.0, 5.0, 1e9]
    extra = value_counts(table(gone), "v", -1).unionByName(value_counts(table(more), "v"))
    left = [v for i, v in enumerate(held) if i % 3] + more
    got = counted_quantiles(counts.unionByName(extra), totals.unionByName(block_totals(extra)), probs, limits)
    assert got == pytest.approx(np.quantile(left, probs).tolist())
    assert counted_quantiles(counts.limit(0), totals.limit(0), probs, limits) == [None] * len(probs)
    order = table(held).select("v", block_of(F.col("v")).alias("b")).orderBy("v").collect()
    assert [r.b for r in order] == sorted(r.b for r in order)


def test_moments_leave_as_they_came():
    def of(values):
        return len(values), float(np.mean(values)), float(np.var(values) * len(values))

    a, b = [1.0, 5.0, 1e6, 3.0], [2.0, 9e5]
    assert _with(of(a), of(b)) == pytest.approx(of(a + b))
    assert _without(_with(of(a), of(b)), of(b)) == pytest.approx(of(a))
    assert _without(of(a), of(a)) == (0, 0.0, 0.0) and _with((0, 0.0, 0.0), of(a)) == pytest.approx(of(a))
