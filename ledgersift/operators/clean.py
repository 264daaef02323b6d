"""Cleaning, normalisation, input validation and data-quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgersift.config import LEDGER_COLUMNS, SOURCE_FIXES
from ledgersift.functions.scalar import literal_map


def arrival_order(df: DataFrame, order: list[str] | None) -> list[Column]:
    """Arrival order of raw rows; a content hash settles what the timestamps leave open."""
    known = [F.col(c) for c in (order or ["updated_at", "created_at"])]
    return [*known, F.xxhash64(*sorted(df.columns))]


def keep_first(df: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """One row per ``key``: the first to arrive.

    The rank filter is pushed below the shuffle (a per-task top 1), so a group
    of copies of any size sends one row per task.
    """
    w = Window.partitionBy(key).orderBy(*arrival_order(df, order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def clean(df: DataFrame, ingest_order: list[str] | None = None) -> DataFrame:
    """Drop soft-deleted rows, repeated ids, unusable amounts and undated rows."""
    live = df.where(F.col("deleted_at").isNull())
    single = keep_first(live, "id", ingest_order)
    return single.where((F.col("amount") > 0) & ~F.isnan("amount")).where(
        F.col("created_at").isNotNull()
    )


def normalize(df: DataFrame) -> DataFrame:
    """Unify the spelling of expense type, source and currency."""
    source = F.upper(F.trim(F.coalesce("source", F.lit("UNKNOWN"))))
    fixes = literal_map(SOURCE_FIXES)
    return df.withColumns(
        {
            "expense_type": F.lower(F.trim(F.coalesce("expense_type", F.lit("unknown")))),
            "source": F.coalesce(F.element_at(fixes, source), source),
            "currency": F.upper(F.trim(F.coalesce("currency", F.lit("UNKNOWN")))),
        }
    )


def attrition(df: DataFrame) -> DataFrame:
    """One row: how many raw rows each cleaning step concerns, and the retained count."""
    per_id = df.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"),
        F.count_if(F.col("amount").isNull() | F.isnan("amount") | (F.col("amount") <= 0)).alias(
            "bad"
        ),
        # The row that survives de-duplication decides whether the id is retained.
        F.min_by(
            F.struct("amount", "created_at"),
            F.when(F.col("deleted_at").isNull(), F.struct(*arrival_order(df, None))),
        ).alias("first"),
        F.count_if(F.col("deleted_at").isNull()).alias("live"),
    )
    kept = (
        (F.col("live") > 0)
        & (F.col("first.amount") > 0)
        & ~F.isnan("first.amount")
        & F.col("first.created_at").isNotNull()
    )
    counts = per_id.agg(
        F.sum("n").alias("raw_rows"),
        F.sum("deleted").alias("soft_deleted"),
        F.sum(F.col("n") - 1).alias("duplicate_ids"),
        F.sum("bad").alias("invalid_amount"),
        F.count_if(kept).alias("retained"),
    )
    shares = {
        f"{c}_pct": F.round(F.col(c) * 100.0 / F.col("raw_rows"), 2)
        for c in ["soft_deleted", "duplicate_ids", "invalid_amount", "retained"]
    }
    return counts.withColumns(shares)


def cardinalities(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct expense types and sources before and after normalisation (nulls not counted)."""

    def count(df: DataFrame, suffix: str) -> DataFrame:
        return df.agg(
            F.count_distinct("expense_type").alias(f"expense_type_{suffix}"),
            F.count_distinct("source").alias(f"source_{suffix}"),
        ).withColumn("_one", F.lit(1))

    return count(before, "before").join(count(after, "after"), "_one").drop("_one")


def schema_drift(df: DataFrame, expected: list[str] = LEDGER_COLUMNS) -> DataFrame:
    """Columns that are missing from or unexpected in ``df``: (column_name, finding)."""
    found = [(c, "missing") for c in expected if c not in df.columns]
    found += [(c, "extra") for c in df.columns if c not in expected]
    return df.sparkSession.createDataFrame(found, "column_name string, finding string")


# Defaults of incoming records.
INPUT_DEFAULTS = {"status": "pending", "currency": "XAF", "source": "DASHBOARD", "state": 1}


def validate_input(df: DataFrame) -> DataFrame:
    """Add ``rejected``: the reason a new record cannot be scored, or null."""
    reason = (
        F.when(F.col("id").isNull(), "id missing")
        .when(F.col("company_id").isNull(), "company_id missing")
        .when(F.col("amount").isNull() | F.isnan("amount"), "amount missing")
        .when(F.col("amount") <= 0, "amount not positive")
        .when(F.col("created_at").isNull(), "created_at missing")
    )
    filled = {
        c: F.coalesce(F.col(c), F.lit(v)) for c, v in INPUT_DEFAULTS.items() if c in df.columns
    }
    return df.withColumns({**filled, "rejected": reason})


def rows_to_ledger(spark: SparkSession, rows: list[dict], schema) -> DataFrame:
    """A few in-memory records as a ledger frame with the input defaults applied."""
    names = [f.name for f in schema.fields]
    data = [[r.get(n, INPUT_DEFAULTS.get(n)) for n in names] for r in rows]
    return spark.createDataFrame(data, schema)


def null_audit(df: DataFrame) -> DataFrame:
    """Per column: declared type, null count and null share."""
    parts: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    parts += [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    types = dict(df.dtypes)
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(types[c]).alias("column_type"),
                F.col(c).alias("nulls"),
            )
            for c in df.columns
        ]
    )
    counted = df.agg(*parts).select("_rows", F.explode(entries).alias("e"))
    return counted.select(
        "e.column_name",
        "e.column_type",
        "e.nulls",
        F.round(F.col("e.nulls") * 100.0 / F.col("_rows"), 2).alias("null_pct"),
    )


def entity_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct entities and the covered time span.

    Exact distinct counts over several columns multiply the rows before the
    shuffle, so each column is de-duplicated on its own first.
    """
    if approximate:
        counts = [F.approx_count_distinct(c).alias(f"distinct_{c}") for c in columns]
        return df.agg(*counts, F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    pieces = [
        df.select(c).distinct().agg(F.count(c).alias(f"distinct_{c}")).withColumn("_one", F.lit(1))
        for c in columns
    ]
    span = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
        F.timestamp_diff("DAY", F.min("created_at"), F.max("created_at")).alias("span_days"),
    ).withColumn("_one", F.lit(1))
    return reduce(lambda a, b: a.join(b, "_one"), pieces, span).drop("_one")
