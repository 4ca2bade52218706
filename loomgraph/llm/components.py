"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(a, b) -> (node, component): each node that has an edge, with the smallest node it reaches.

    Each step replaces a node's links by links to the smallest neighbour; no neighbourhood is gathered in one task:
    minima are pre-aggregated and joined back, and a join on a hub can be split. Stops when the links form stars, and
    raises if they still do not after `rounds`. Repeated edges and loops change nothing; an empty input gives an empty
    result.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "cc")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # repeated links stay until the end of the step, at most four for each of its first ones
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        now = cut(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "cc")
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n"))
        if ends.agg(F.coalesce(F.bool_and(F.expr("up = 0 or n = 1")), F.lit(True))).first()[0]:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
