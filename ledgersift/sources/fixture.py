"""Views that present the supplied test tables as expense ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column expressions valid in Spark and in ANSI SQL engines alike; {K} is the
# integer ``k`` of the JSON text in ``props``.
LEDGER_EXPRESSIONS = {
    "id": "concat('EXP_', lpad(CAST(event_id AS string), 7, '0'))",
    "company_id": "concat('COMP_', CAST(user_id % 7 AS string))",
    "user_id": "CASE WHEN event_id % 97 = 1 THEN NULL"
    " ELSE concat('USR_', lpad(CAST(user_id AS string), 5, '0')) END",
    "shop_id": "concat('SHOP_', CAST(user_id % 11 AS string))",
    "supplier_id": "CASE WHEN k < 20 THEN NULL"
    " ELSE concat('SUPP_', CAST(user_id AS string), '_', CAST(k % 20 AS string)) END",
    "reference": "CASE WHEN event_id % 5 = 0 THEN NULL"
    " ELSE concat('REF-', CAST(event_id AS string)) END",
    "status": "CASE WHEN event_id % 10 < 7 THEN 'approved'"
    " WHEN event_id % 10 < 9 THEN 'pending' ELSE NULL END",
    "currency": "CASE WHEN event_id % 4 = 0 THEN ' xaf ' ELSE 'XAF' END",
    "amount": "CAST(CASE WHEN event_id % 211 = 2 THEN -1.0 ELSE 1.0 END AS double)"
    " * round(value * 10000)",
    "source": "CASE event_type WHEN 'click' THEN 'wathsapp' WHEN 'view' THEN 'Dashboard '"
    " WHEN 'error' THEN 'twitter/x' WHEN 'signup' THEN 'APPEL' ELSE 'WHATSAPP' END",
    "due_date": "CASE WHEN event_id % 6 = 0 THEN NULL"
    " ELSE ts + INTERVAL 15 DAY - INTERVAL 1 DAY * CAST(event_id % 30 AS int) END",
    "paid_at": "CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR * k ELSE NULL END",
    "billing": "concat('{\"treasury_account_id\": \"TA', CAST(k AS string),"
    " '\", \"method\": \"cash\", \"address_id\": \"AD', CAST(user_id AS string), '\"}')",
    "created_at": "ts",
    "updated_at": "ts",
    "deleted_at": "CASE WHEN event_id % 50 = 3 THEN ts + INTERVAL 1 DAY ELSE NULL END",
    "expense_type": "CASE WHEN event_id % 8 = 0 THEN ' Raw_Materials'"
    " WHEN event_id % 8 < 5 THEN 'raw_materials' WHEN event_id % 8 = 5 THEN 'personnel'"
    " WHEN event_id % 8 = 6 THEN 'other' ELSE NULL END",
    "event_id": "event_id",
}


def raw_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a raw ledger, including late second copies of some ids."""
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )
    first = events.selectExpr(*[f"{e} AS {n}" for n, e in LEDGER_EXPRESSIONS.items()])
    # The second copy is emitted from the same scan rather than from a second one.
    again = F.when(
        F.col("event_id") % 301 == 4, F.array(F.lit(0), F.lit(1))
    ).otherwise(F.array(F.lit(0)))
    return (
        first.withColumn("_copy", F.explode(again))
        .withColumns(
            {
                "amount": F.col("amount") + F.col("_copy"),
                "updated_at": F.col("updated_at") + F.make_dt_interval(hours=F.col("_copy")),
            }
        )
        .drop("_copy")
    )


def order_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The orders table as a ledger whose timestamps repeat (dates only)."""
    return spark.read.parquet(f"{folder}/orders.parquet").select(
        F.concat(F.lit("ORD_"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("id"),
        F.concat(F.lit("CUST_"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("created_at"),
    )
