"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.session import materialize


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes in ``links`` (a, b); component is the smallest node reachable.

    Each round joins every node's larger neighbours to its smallest one, then its
    smaller neighbours likewise; the number of rounds grows with the logarithm
    of the longest chain. Each round is a written table, so a lost executor
    costs one round at most. Self links and repeated links are harmless; no
    links give no rows.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    for _ in range(rounds):
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).union(
            edges.select(F.col("v").alias("n"), F.col("u").alias("m"))
        )
        low = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        # What repeats here is gone after the one distinct below.
        large = both.join(low, "n").where(F.col("m") > F.col("n")).select(F.col("m").alias("u"), F.col("low").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(least, "u").where(F.col("v") > F.col("low"))
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
        )
        edges = materialize(small.union(least.select("u", F.col("low").alias("v"))).distinct())
        # Settled: every node has one smaller neighbour or is one, never both.
        ends = edges.select(F.explode(F.array(
            F.struct(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")),
            F.struct(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")),
        )).alias("end")).groupBy("end.n").agg(F.sum("end.up").alias("up"), F.max("end.down").alias("down"))
        if not ends.where("up > 1 or (up > 0 and down > 0)").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
