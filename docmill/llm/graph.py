"""Distributed union-find: connected components by alternating star operations.

Each round replaces edges by edges to the smallest neighbour (large star, then small
star); rounds follow until the edges no longer change. Minima are aggregated before the
shuffle, so a node with very many neighbours costs one row per task, and the joins that
follow are ordinary equi-joins that Spark splits where a key is skewed. Edges are cut
from their lineage by a table in shared storage each round, and the round before is
deleted; none reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import drop, stage


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node it reaches) of every node but the smallest ones.

    edges: two integer columns a and b. Loops, repeated edges and nulls do no harm. The
    result is a table in shared storage.
    """
    a, b = F.col("a"), F.col("b")
    now = stage(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = _state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("k"), F.least("u", "v").alias("m"))
        # every larger neighbour v of u points to the smallest of u's neighbours: seen from edges v > u
        large = now.join(low, now["v"] == low["k"]).select("u", F.col("m").alias("v")).where("u != v")
        # a local minimum keeps its own edges: they are already among those above
        own = now.join(low, now["u"] == low["k"]).select("u", F.col("m").alias("v"))
        merged = stage(large.unionByName(own).distinct(), "edges")
        least = merged.groupBy("u").agg(F.min("v").alias("m"))
        small = merged.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        after = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(now, merged)
        now = after
        state = _state(after)
        if state == seen:
            break
        seen = state
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out._staged = now._staged
    return out


def _state(edges: DataFrame) -> tuple[int, int]:
    """How many edges there are and a digest of them that does not depend on order."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
    return row["n"], row["s"] or 0
