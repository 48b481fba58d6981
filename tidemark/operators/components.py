"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two equi joins on an edge table. A node with very many
neighbours is only ever aggregated (with partial aggregation) or split by the skew join; it
is never collected. The edge table is cut to shared storage after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut


def _oriented(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    pulled = edges.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pulled.unionByName(lowest.select("u", F.col("m").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Every node points at one node, and that one points nowhere."""
    roles = edges.select("u", "v").unionByName(
        edges.select(F.col("v").alias("u"), F.lit(None).cast("bigint").alias("v"))
    )
    per_node = roles.groupBy("u").agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.count_if(F.col("v").isNull()).alias("as_target")
    )
    moving = (F.col("low") != F.col("high")) | (F.col("low").isNotNull() & (F.col("as_target") > 0))
    return per_node.where(moving).isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node."""
    current = _oriented(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")))
    while True:
        current = cut(_oriented(_small_star(_oriented(_large_star(current)))))
        if _settled(current):
            break
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
