"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpweave.session import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``id, component_id`` (the smallest id reachable) for every id that has a link.

    Every round joins each link with the least neighbour of its ends; only minima per id are
    aggregated, no neighbour list is ever gathered, and a hub is split by the skew join. Rounds grow
    with the logarithm of the longest chain. The table is written after each round, so that a lost
    executor costs one round at most.
    """
    u, v = F.col(left), F.col(right)
    edges = materialize(links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "w")
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(down, F.col("u") == F.col("w")).select(
            F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")
        ).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct()
        edges = materialize(small)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
