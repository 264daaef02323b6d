"""Scoring arriving transactions in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgersift.config import DEFAULT, AuditConfig
from ledgersift.operators.reports import top_anomalies
from ledgersift.plans.audit import AuditModels, score_new


def score_stream(
    arriving: DataFrame,
    history: DataFrame,
    models: AuditModels,
    output: str,
    checkpoint: str,
    cfg: AuditConfig = DEFAULT,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score each micro-batch against history and write it under ``output``.

    A batch has its own folder that a repeated run overwrites, so results appear
    exactly once. Rejected rows go to a sibling folder with their reason.
    """

    def handle(batch: DataFrame, number: int) -> None:
        scored, rejected = score_new(history, batch, models, cfg)
        scored.write.mode("overwrite").parquet(f"{output}/scored/batch_id={number}")
        rejected.write.mode("overwrite").parquet(f"{output}/rejected/batch_id={number}")

    writer = arriving.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest_top(spark: SparkSession, output: str, n: int = 20) -> DataFrame:
    """The highest-scoring anomalies of the newest batch (1 <= n <= 100)."""
    if not 1 <= n <= 100:
        raise ValueError("n must lie between 1 and 100")
    results = spark.read.parquet(f"{output}/scored")
    newest = results.agg(F.max("batch_id").alias("b")).first()["b"]
    return top_anomalies(results.where(F.col("batch_id") == F.lit(newest)), n, only_flagged=True)
