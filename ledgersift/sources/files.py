"""CSV, parquet and JSON-lines sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.config import TIMESTAMP_COLUMNS

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"



def _escaped(value: Column) -> Column:
    """Line breaks and backslashes written out, so that a record is one line and files can be split.

    An empty text is written as backslash and e, since an empty field is a null.
    """
    doubled = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    broken = F.replace(F.replace(doubled, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.when(value == "", F.lit("\\e")).otherwise(broken)


def _unescaped(value: Column) -> Column:
    # Doubled backslashes are parted off first, so that the rest can be undone piece by piece.
    pieces = F.transform(
        F.split(value, r"\\\\"),
        lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")),
    )
    return F.when(value == "\\e", F.lit("")).otherwise(F.array_join(pieces, "\\"))


def read_csv_ledger(spark: SparkSession, path: str, line_breaks: str = "escaped") -> DataFrame:
    """A ledger from CSV: all text, except dates and an amount that is 0 when unreadable.

    ``line_breaks`` tells how breaks inside text stand in the file: "escaped" as
    :func:`write_report` writes them, or "quoted" as they are, which reads each
    file in one task and leaves backslashes alone.
    """
    if line_breaks not in ("escaped", "quoted"):
        raise ValueError("line_breaks must be escaped or quoted")
    text = (
        spark.read.option("header", True).option("escape", '"').option("multiLine", line_breaks == "quoted").csv(path)
    )
    if line_breaks == "escaped":
        text = text.select(*[_unescaped(F.col(f"`{c}`")).alias(c) for c in text.columns])
    casts = {c: F.col(c).try_cast("timestamp_ntz") for c in TIMESTAMP_COLUMNS if c in text.columns}
    if "amount" in text.columns:
        casts["amount"] = F.coalesce(F.col("amount").try_cast("double"), F.lit(0.0))
    if "state" in text.columns:
        casts["state"] = F.col("state").try_cast("bigint")
    return text.withColumns(casts) if casts else text


def write_report(df: DataFrame, path: str) -> None:
    """Write by suffix: .parquet, .json (one record per line, ISO dates), otherwise CSV with line breaks escaped."""
    if path.endswith(".parquet"):
        df.write.parquet(path)
    elif path.endswith(".json"):
        df.write.option("timestampNTZFormat", ISO).option("ignoreNullFields", False).json(path)
    else:
        texts = {c: _escaped(F.col(f"`{c}`")) for c, kind in df.dtypes if kind == "string"}
        plain = {f"ignore{side}WhiteSpace": False for side in ("Leading", "Trailing")}
        df.withColumns(texts).write.options(header=True, escape='"', timestampNTZFormat=ISO, **plain).csv(path)
