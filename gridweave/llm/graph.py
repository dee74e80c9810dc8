"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, scratch: common.Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of `edges`; the root is the smallest node that can be reached, itself included.

    Alternating large-star and small-star steps: each links a node's neighbours to the smallest of them. Both work with
    a minimum per node and a join, so a node with very many neighbours is a skewed join that Spark splits, never a
    group in one task. Each round is written to `scratch`, where the result is read from. It ends when a round changes nothing.
    """
    held = scratch.keep(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")

    def sign(df):
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    before = sign(held)
    while before[0]:
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        held = scratch.keep(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        after = sign(held)
        if after == before:
            break
        before = after
    return held.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
