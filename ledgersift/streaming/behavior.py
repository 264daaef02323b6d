"""Behaviour of each user in a stream: look-back figures kept up to date by keyed state.

The state of a user is the tail of rows that a look-back can still reach and the time of
the newest row before it. What a micro-batch costs grows with its rows and the tails of
the users in it, never with the history.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgersift.config import DAY_US, DEFAULT, HOUR_US, AuditConfig
from ledgersift.functions.temporal import micros
from ledgersift.operators.patterns import BAND_SHARE

OUTPUT = (
    "id string, user_id string, created_us long, amount double, user_rolling_mean_7d double,"
    " user_rolling_std_7d double, days_since_last_tx double, fraud_duplicate_score double, late int"
)
# Many small stores: no disk set aside ahead of use, and changes instead of whole copies per batch.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_EMPTY = (0, 0.0, 0.0)


def _joined(a: tuple, b: tuple) -> tuple:
    """Two (count, mean, squared deviations) as one."""
    n = a[0] + b[0]
    if not n:
        return _EMPTY
    gap = b[1] - a[1]
    return n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n


def sliding_moments(us: list[int], amounts: list[float], length: int) -> list[tuple]:
    """Per row (count, mean, squared deviations) of the rows in (us - length, us]; ``us`` ascends.

    The window is a suffix of rows already summed from the right and a running sum of the
    rows after them, so each row is merged a fixed number of times and nothing is subtracted.
    """
    out: list[tuple] = []
    suffix: dict[int, tuple] = {}
    low = high = 0
    running = _EMPTY
    while high < len(us):
        now, end = us[high], high
        while end < len(us) and us[end] == now:
            running = _joined(running, (1, amounts[end], 0.0))
            end += 1
        while us[low] <= now - length:
            suffix.pop(low, None)
            low += 1
        if low not in suffix:
            suffix, total = {}, _EMPTY
            for i in range(end - 1, low - 1, -1):
                total = _joined((1, amounts[i], 0.0), total)
                suffix[i] = total
            running = _EMPTY
        out += [_joined(suffix[low], running)] * (end - high)
        high = end
    return out


def latest_alike(
    us: list[int], amounts: list[float], tolerance: float, span: int
) -> list[int | None]:
    """Per row the position of the newest earlier row with nearly the same amount, at most ``span`` before.

    Rows of one logarithmic band always match, so only rows after the latest one of the own
    band are looked at, in the few bands within reach.
    """
    width, reach = BAND_SHARE * math.log1p(tolerance), -math.log1p(-tolerance) * 1.0009
    bands: dict[int, list[int]] = {}
    out: list[int | None] = []
    for i, amount in enumerate(amounts):
        log = math.log1p(amount)
        home = math.floor(log / width)
        best = bands[home][-1] if home in bands else -1
        for band in range(math.floor((log - reach) / width), math.floor((log + reach) / width) + 1):
            for j in reversed(bands.get(band, ())):
                if j <= best:
                    break
                if abs(amount - amounts[j]) / (amount + 1) < tolerance:
                    best = j
                    break
        out.append(best if best >= 0 and us[best] >= us[i] - span else None)
        bands.setdefault(home, []).append(i)
    return out


class UserTail(StatefulProcessor):
    """Scores the new rows of a user against the user's tail.

    Rows of a batch are put in order of (time, id) with the tail, so their order of arrival
    inside a batch does not matter. A row that is not newer than one of an earlier batch is
    marked late: it sees all rows known by then, but rows already written do not see it.
    """

    def __init__(self, cfg: AuditConfig, delay_us: int) -> None:
        self.rolling = cfg.rolling_days * DAY_US
        self.span = cfg.duplicate_hours * HOUR_US
        self.hours = float(cfg.duplicate_hours)
        self.tolerance = cfg.duplicate_tolerance
        # A late row looks back from up to ``delay_us`` before the newest one.
        self.keep = max(self.rolling, self.span) + delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getListState("tail", "us long, id string, amount double")
        self.past = handle.getValueState("past", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        user, new = key[0], []
        for part in rows:
            some = list(zip(part["us"].tolist(), part["id"].tolist(), part["amount"].tolist(), strict=True))
            if user is None:
                blank = [(i, None, at, amount, None, None, 0.0, None, 0) for at, i, amount in some]
                yield pd.DataFrame(blank, columns=_names())
            else:
                new += some
        if not new:
            return
        known = [tuple(r) for r in self.tail.get()]
        clock = max((r[0] for r in known), default=None)
        ordered = sorted([(*r, 0) for r in known] + [(*r, 1) for r in new])
        us, amounts = [r[0] for r in ordered], [r[2] for r in ordered]
        before = self.past.get()[0] if self.past.exists() else None
        moments = sliding_moments(us, amounts, self.rolling)
        alike = latest_alike(us, amounts, self.tolerance, self.span)
        out = []
        for i, (at, name, amount, is_new) in enumerate(ordered):
            if not is_new:
                continue
            n, mean, m2 = moments[i]
            last = us[i - 1] if i else before
            score = None if alike[i] is None else 1.0 - (at - us[alike[i]]) / HOUR_US / self.hours
            out.append((
                name, user, at, amount, mean, math.sqrt(m2 / (n - 1)) if n > 1 else 0.0,
                0.0 if last is None else (at - last) / DAY_US, score,
                int(clock is not None and at <= clock),
            ))
        self._cut(ordered, us[-1] - self.keep, before)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((us[-1] + self.keep) // 1000 + 1)
        yield pd.DataFrame(out, columns=_names())

    def _cut(self, ordered: list[tuple], limit: int, before: int | None) -> None:
        """Keep the rows after ``limit`` and the newest one; remember the newest of those dropped."""
        start = 0
        while start < len(ordered) - 1 and ordered[start][0] <= limit:
            start += 1
        if start:
            before = ordered[start - 1][0]
        if before is not None:
            self.past.update((before,))
        self.tail.put([r[:3] for r in ordered[start:]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No row in reach any more: only the newest one stays."""
        rows = sorted(tuple(r) for r in self.tail.get())
        if rows:
            self._cut(rows, rows[-1][0], self.past.get()[0] if self.past.exists() else None)
        return iter(())


def _names() -> list[str]:
    return [part.split()[0] for part in OUTPUT.split(",")]


def user_behavior_stream(
    arriving: DataFrame, delay_hours: int = 1, cfg: AuditConfig = DEFAULT
) -> DataFrame:
    """Look-back figures of a stream of cleaned rows (unique ids, positive amounts, a created_at).

    Returns the columns of ``OUTPUT``: seven-day mean and deviation, days since the user's row
    before, and the score of a near-duplicate within 48 hours (null without one). Rows more
    than ``delay_hours`` behind the newest row of all earlier batches are dropped by the
    watermark. Rows without a user are spread and get null figures and a gap of 0. One
    micro-batch of one user is held in a task: bound it by the source's options.
    """
    us = micros("created_at")
    scatter = F.when(F.col("user_id").isNull(), F.pmod(F.xxhash64("id"), F.lit(256)).cast("int")).otherwise(F.lit(0))
    timed = arriving.select(
        "user_id", scatter.alias("scatter"), us.alias("us"), "id", F.col("amount").cast("double").alias("amount"),
        F.timestamp_micros(us).alias("at"),
    ).withWatermark("at", f"{delay_hours} hours")
    return timed.groupBy("user_id", "scatter").transformWithStateInPandas(
        UserTail(cfg, delay_hours * HOUR_US), OUTPUT, "Append", "EventTime"
    )


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that keyed state needs, for queries started inside."""
    old = {name: spark.conf.get(name, None) for name in _STORE}
    for name, value in _STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def write_behavior(
    arriving: DataFrame,
    output: str,
    checkpoint: str,
    delay_hours: int = 1,
    cfg: AuditConfig = DEFAULT,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start :func:`user_behavior_stream` into a parquet folder; each row is written exactly once."""
    scored = user_behavior_stream(arriving, delay_hours, cfg)
    writer = scored.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", output)
    with keyed_state(arriving.sparkSession):
        return writer.trigger(**(trigger or {"availableNow": True})).start()
