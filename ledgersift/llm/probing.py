"""Probing sharded arrays: packed questions meet the arrays of their shard in bounded pieces."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.session import work_partitions

PIECE_ENTRIES = 1 << 19


_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a flat "name type, ..." list; workers have no session to parse it."""
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def probe_shards(
    arrays: DataFrame, probes: DataFrame, answer: Callable[[dict, list[dict]], pa.RecordBatch], schema: str,
    entries: int = PIECE_ENTRIES,
) -> DataFrame:
    """Answer packed ``probes`` (shard, n, ...) from ``arrays`` (shard, ..., one row per shard).

    ``n`` counts the entries packed into a row. A shard with many entries, as
    one very frequent key makes it, is cut into pieces of about ``entries`` entries; only
    its arrays are repeated. ``answer(arrays, probe rows)`` sees one piece. Probes of
    a shard without arrays are dropped. Both tables should be written ones.
    """
    spark = probes.sparkSession
    sizes = probes.groupBy("shard").agg(
        F.greatest(F.lit(1), F.ceil(F.sum("n") / F.lit(float(entries)))).cast("int").alias("pieces")
    )
    # One row per shard, far fewer than probes.
    held = arrays.join(sizes, "shard").withColumn("piece", F.explode(F.expr("sequence(0, pieces - 1)"))).drop("pieces")
    packed = [c for c in probes.columns if c != "shard"]
    asked = probes.join(sizes, "shard").select(
        "shard", F.pmod(F.xxhash64(*packed), F.col("pieces")).cast("int").alias("piece"), *packed
    )
    parts = work_partitions(spark, 1 << 30)
    held, asked = held.repartition(parts, "shard", "piece"), asked.repartition(parts, "shard", "piece")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_pylist([], schema=empty)
        return pa.Table.from_batches([answer(left.to_pylist()[0], right.to_pylist())])

    empty = arrow_schema(schema)
    return held.groupBy("shard", "piece").cogroup(asked.groupBy("shard", "piece")).applyInArrow(run, schema)
