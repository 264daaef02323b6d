import datetime as dt
import math
import random

import pytest

from conftest import by_id
from ledgersift.config import DEFAULT
from ledgersift.session import open_files
from ledgersift.streaming.behavior import latest_alike, sliding_moments, write_behavior

ROW = "id string, user_id string, amount double, created_at timestamp_ntz"
START = dt.datetime(2025, 2, 1)


def uneven(seed, n, span):
    draw = random.Random(seed)
    us = sorted(draw.randrange(span) for _ in range(n))
    return us, [draw.choice((100.0, 100.4, 101.1, 99.2, 7e6, 0.5)) * draw.choice((1, 1, 1.009)) for _ in us]


@pytest.mark.parametrize("seed, n, span", [(1, 200, 50), (2, 150, 1000), (3, 60, 5000), (4, 1, 1), (5, 0, 1)])
def test_sliding_moments(seed, n, span):
    us, amounts = uneven(seed, n, span)
    got = sliding_moments(us, amounts, 40)
    assert len(got) == n
    for at, (count, mean, m2) in zip(us, got, strict=True):
        seen = [a for u, a in zip(us, amounts, strict=True) if at - 40 < u <= at]
        middle = math.fsum(seen) / len(seen)
        assert count == len(seen) and mean == pytest.approx(middle)
        assert m2 == pytest.approx(math.fsum((a - middle) ** 2 for a in seen), rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("tolerance", [0.01, 0.2])
def test_latest_alike(tolerance):
    us, amounts = uneven(7, 300, 900)
    got = latest_alike(us, amounts, tolerance, 60)
    for i, found in enumerate(got):
        match = [
            j for j in range(i)
            if abs(amounts[i] - amounts[j]) / (amounts[i] + 1) < tolerance and us[j] >= us[i] - 60
        ]
        assert found == (match[-1] if match else None)


def test_state_lives_on_and_ends(spark, tmp_path):
    """Restarts, a late row, a row behind the watermark, an expired tail and rows without a user."""
    def arrive(*rows):
        made = [(i, u, a, START + dt.timedelta(hours=h)) for i, u, a, h in rows]
        spark.createDataFrame(made, ROW).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(ROW).parquet(f"{tmp_path}/in")
        write_behavior(source, f"{tmp_path}/out", f"{tmp_path}/cp", delay_hours=5).awaitTermination()

    arrive(("a1", "u", 100.0, 0), ("a3", "u", 100.5, 20), ("a2", "u", 300.0, 10), ("n1", None, 5.0, 1), ("b1", "v", 9.0, 20))
    # a4 is late but inside the delay, a5 follows it, x lies behind the watermark.
    arrive(("a5", "u", 500.0, 30), ("a4", "u", 301.0, 18), ("x", "u", 1.0, 2), ("n2", None, 5.0, 21))
    # v moves the watermark on for a month: the tail of u ends, its newest time stays.
    arrive(("b2", "v", 9.0, 20 + 720))
    arrive(("a6", "u", 500.0, 750), ("a7", "u", 500.0, 750))
    got = by_id(spark.read.parquet(f"{tmp_path}/out"))
    assert set(got) == {"a1", "a2", "a3", "a4", "a5", "a6", "a7", "b1", "b2", "n1", "n2"}
    mean = {i: r.user_rolling_mean_7d for i, r in got.items()}
    assert mean["a3"] == pytest.approx((100 + 300 + 100.5) / 3)
    assert mean["a4"] == pytest.approx((100 + 300 + 301) / 3)
    assert mean["a5"] == pytest.approx((100 + 300 + 301 + 100.5 + 500) / 5)
    assert mean["a6"] == mean["a7"] == 500.0 and mean["n1"] is None
    assert {i for i, r in got.items() if r.late} == {"a4"}
    days = {i: r.days_since_last_tx * 24 for i, r in got.items()}
    assert days["a2"] == 10 and days["a4"] == 8 and days["a5"] == 10 and days["n2"] == 0
    assert days["a6"] == pytest.approx(720) and days["a7"] == 0 and days["b2"] == pytest.approx(720)
    score = {i: r.fraud_duplicate_score for i, r in got.items() if r.fraud_duplicate_score is not None}
    assert score == pytest.approx({"a3": 1 - 20 / 48, "a4": 1 - 8 / 48, "a7": 1.0})


def test_spearman(spark, sliced):
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F

    from ledgersift.operators.reports import spearman

    draw = np.random.default_rng(5)
    data = pd.DataFrame({
        "a": draw.normal(size=300), "b": draw.integers(0, 3, 300).astype(float),
        "c": np.zeros(300), "d": np.where(draw.random(300) < 0.9, 0.0, draw.random(300)),
    })
    data["e"] = -data["a"] ** 3
    data.loc[7, "b"] = None
    df = spark.createDataFrame(data).withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    kept = data.dropna().rank()
    want = {(x, y): kept[x].corr(kept[y]) for x in data for y in data}
    for cfg in (DEFAULT, sliced):
        got = {(r.first, r.second): r.rho for r in spearman(df, list(data), cfg).toLocalIterator()}
        assert set(got) == set(want)
        for pair, rho in got.items():
            assert rho is None if "c" in pair else rho == pytest.approx(want[pair], abs=1e-12), pair
    empty = spearman(df.where("a > 1e9"), ["a", "b"]).collect()
    assert len(empty) == 4 and all(r.rho is None for r in empty)


def test_batches_are_written_without_a_sort(spark, tmp_path):
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before, rows = spark.conf.get(name), spark.range(30).selectExpr("id", "if(id = 29, null, id % 3) AS batch_id")
    with open_files(spark, 8):
        assert spark.conf.get(name) == "8"
        rows.write.partitionBy("batch_id").parquet(str(tmp_path / "kept"))
    with pytest.raises(ValueError), open_files(spark, 8):
        raise ValueError
    assert spark.conf.get(name) == before
    back = spark.read.parquet(str(tmp_path / "kept"))
    assert sorted((r.id, r.batch_id) for r in back.collect()) == [(i, None if i == 29 else i % 3) for i in range(30)]
