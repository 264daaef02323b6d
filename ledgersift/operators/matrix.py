"""Category codes, the imputed numeric matrix and its standardisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.config import CATEGORICAL_COLUMNS, DEFAULT, MATRIX_COLUMNS, AuditConfig
from ledgersift.operators.quantiles import column_quantiles, distinct_values, value_blocks
from ledgersift.operators.skew import attach, largest_group


def category_codes(df: DataFrame, column: str, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """(value, code): distinct non-null values numbered from 0 in sorted order."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    size = distinct_values(df, column)
    numbered = value_blocks(values, [], column, cfg.limits, size)
    return numbered.select(column, F.col("_first").cast("int").alias(f"{column}_encoded"))


def encode(
    df: DataFrame,
    columns: list[str] = CATEGORICAL_COLUMNS,
    cfg: AuditConfig = DEFAULT,
    base: DataFrame | None = None,
) -> DataFrame:
    """Add ``<column>_encoded`` per categorical column; null is -1.

    The categories are read from ``base`` (default: the frame itself). Up to a
    thousand of them become a sorted literal array with a position lookup in the
    row; more are numbered and joined.
    """
    source = base if base is not None else df
    sizes = source.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    few = [c for c in columns if sizes[c] <= 1_000]
    listed = {}
    if few:
        listed = source.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in few]).first().asDict()
    out = df
    for column in columns:
        name = f"{column}_encoded"
        if column in listed:
            known = F.lit(listed[column] or []).cast("array<string>")
            code = F.array_position(known, F.col(column)).cast("int") - 1
            out = out.withColumn(name, F.coalesce(code, F.lit(-1)))
        else:
            largest = largest_group(source, [column])
            out = attach(out, category_codes(source, column, cfg), [column], largest, cfg.limits)
            out = out.withColumn(name, F.coalesce(name, F.lit(-1)))
    return out


def medians(df: DataFrame, columns: list[str], cfg: AuditConfig = DEFAULT) -> dict[str, float]:
    """Exact medians of the columns, nulls skipped; a column of nulls gives 0."""
    sizes = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    small = [c for c in columns if sizes[c] <= cfg.limits.group_rows]
    found: dict[str, float | None] = {}
    if small:
        row = df.agg(*[F.median(c).alias(c) for c in small]).first()
        found.update(row.asDict())
    wide = {c: [0.5] for c in columns if c not in found}
    found.update({c: q[0] for c, q in column_quantiles(df, wide).items()} if wide else {})
    return {c: (0.0 if found[c] is None else float(found[c])) for c in columns}


def with_nulls(df: DataFrame, columns: list[str]) -> list[str]:
    """Which of the columns contain a null (one pass)."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def impute(df: DataFrame, cfg: AuditConfig = DEFAULT) -> DataFrame:
    """(id, 27 doubles): nulls become the column median, or 0 if there is none.

    Only columns that hold nulls need a median, and only those are sorted for it.
    """
    columns = [c for c in MATRIX_COLUMNS if c in df.columns]
    gaps = with_nulls(df, columns)
    middle = medians(df, gaps, cfg) if gaps else {}
    filled = [
        (F.coalesce(F.col(c).cast("double"), F.lit(middle[c])) if c in middle else F.col(c).cast("double")).alias(c)
        for c in columns
    ]
    return df.select("id", *filled)


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bring a matrix to the trained columns: missing ones are 0, unknown ones go."""
    return df.select(
        "id", *[(F.col(c) if c in df.columns else F.lit(0.0)).alias(c) for c in columns]
    )


def _finite(column: str) -> Column:
    value = F.col(column)
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(value)


def scale_parameters(matrix: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column (two numbers each, driver-sized)."""
    parts = []
    for c in columns:
        parts += [F.avg(_finite(c)).alias(f"m_{c}"), F.stddev_pop(_finite(c)).alias(f"s_{c}")]
    row = matrix.agg(*parts).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0) for c in columns}


def standardize(matrix: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """Subtract the mean and divide by the deviation; constant columns are only centred."""
    scaled = []
    for c, (mean, std) in params.items():
        # A deviation that is only rounding noise counts as constant.
        flat = std <= 10 * 2.220446049250313e-16 * abs(mean)
        scaled.append(((_finite(c) - mean) / (1.0 if flat or std == 0 else std)).alias(c))
    return matrix.select("id", *scaled)


def vectors(scaled: DataFrame, columns: list[str]) -> DataFrame:
    """(id, vec): the scaled columns as one array."""
    return scaled.select("id", F.array(*columns).alias("vec"))
