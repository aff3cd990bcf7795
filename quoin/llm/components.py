"""Connected components by alternating large-star and small-star steps, with DataFrame operations only.

Each step groups edges by node with map-side minima and joins those back, so a node with very many edges is never gathered in
one task; edges are written to the shared folder after each round, and a round that changes nothing is the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v of one ordered type. One row per node that has an edge to another: node, component (its smallest node).

    Null ends and edges of a node to itself count for nothing.
    """
    now = materialize(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        n, mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (n, mark) == state or not n:
            break
        state = (n, mark)
        new = materialize(_small_star(_large_star(now)))
        discard(now)
        now = new
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
