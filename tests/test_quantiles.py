import math

import numpy as np
import pytest

from ledgersift.config import ScaleLimits
from ledgersift.operators.quantiles import column_quantiles, table_quantiles

PROBS = [0.0, 0.05, 0.5, 0.75, 0.95, 1.0]
TINY = 5e-324


def columns(n=3000):
    rng = np.random.default_rng(3)
    return {
        "normal": rng.normal(size=n),
        "heavy": np.exp(rng.normal(size=n) * 12),
        "cents": np.round(rng.gamma(2.0, 40.0, n), 2),
        "flag": (rng.random(n) < 0.3).astype(float),
        "one": np.full(n, -7.25),
        "far": np.where(np.arange(n) % 500 == 0, 1.7e308, np.where(np.arange(n) % 501 == 0, -1.7e308, rng.random(n))),
        "small": rng.integers(0, 4, n) * TINY,
        "close": 1.0 + rng.integers(0, 5, n) * 2.220446049250313e-16,
    }


@pytest.mark.parametrize("bins", [2, 4096])
def test_columns_equal_a_sort(spark, bins):
    data = columns()
    rows = [tuple(float(data[c][i]) for c in data) for i in range(3000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data))
    wanted = list(data) if bins > 2 else ["cents", "close", "flag"]
    got = column_quantiles(df, {c: PROBS for c in wanted}, bins=bins)
    for c in wanted:
        ranked = np.sort(data[c])
        for p, value in zip(PROBS, got[c]):
            at = p * (len(ranked) - 1)
            a, b = ranked[math.floor(at)], ranked[math.ceil(at)]
            assert value == (a if a == b else a + (b - a) * (at - math.floor(at))), (c, p)


def test_odd_values_and_empty_columns(spark):
    inf, nan = math.inf, math.nan
    df = spark.createDataFrame(
        [(1.0, None, nan), (None, None, 2.0), (inf, None, -inf), (-inf, None, 2.0), (3.0, None, 1.0)],
        "a double, none double, b double",
    )
    got = column_quantiles(df, {"a": [0.0, 0.5, 1.0], "none": [0.5], "b": [0.0, 0.5, 1.0]})
    assert got["a"] == [-inf, 2.0, inf] and got["none"] == [None] and got["b"][:2] == [-inf, 2.0] and math.isnan(got["b"][2])
    assert column_quantiles(df.limit(0), {"a": [0.5], "b": []}) == {"a": [None], "b": []}
    assert column_quantiles(df, {}) == {}


def test_weights_and_the_plan_beyond_the_limit(spark):
    rows = [(float(i * i % 97), i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "v double, w int")
    every = np.sort([v for v, w in rows for _ in range(w)])
    want = [float(np.quantile(every, p)) for p in (0.25, 0.5, 0.9)]
    for limit in (10, 10_000):
        got = table_quantiles(df, "v", [0.25, 0.5, 0.9], ScaleLimits(group_rows=limit), weight="w")
        assert got == pytest.approx(want)


def test_rounds_do_not_grow_with_the_rows(spark, monkeypatch):
    """A few scans find all positions, and each shuffles a bounded number of rows."""
    from ledgersift.operators import quantiles

    scans, plain = [], quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda *a: scans.append(1) or plain(*a))
    df = spark.range(200_000).selectExpr("rand(5) * 1e6 AS a", "id % 1000 / 8 AS b")
    column_quantiles(df, {"a": [0.5, 0.9], "b": [0.25]})
    assert len(scans) <= 3
