"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """edges (a bigint, b bigint) -> node, component: the smallest id reachable, for every node of an edge that is no
    loop. Rows with nulls are passed over. Every round is written to the shared folder; the number of rounds grows
    with the logarithm of the longest path. Minima are pre-aggregated, so a hub's edges never meet in one task before
    a join that Spark can split."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    now = materialize(now, label)
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = materialize(large, label)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), label)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then nothing is left to join."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select("v", F.lit(0), F.lit(1)).toDF("node", "out", "in"))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 OR (out > 0 AND in > 0)").isEmpty()
