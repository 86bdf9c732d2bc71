"""Connected components of an edge table, with joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vectorgrove.llm.common import checkpoint


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for every node of the edges (a, b).

    Alternates large-star and small-star steps until edges stay as they are:
    each links a node's larger, then its smaller neighbours to the smallest of
    all.  The smallest neighbour comes from an aggregation with partial sums
    and goes back by a join, so a node with very many edges is never one
    task's.  Edges with a null end, and of a node to itself, are left out.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).dropDuplicates()
    e = checkpoint(e)
    seen = None
    while True:
        # large star: neighbours above a node go to the smallest of it and its neighbours
        ends = F.explode(F.array(F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")), F.struct(F.col("hi").alias("u"), F.col("lo").alias("v"))))
        least = e.select(ends.alias("e")).groupBy(F.col("e.u").alias("w")).agg(F.least(F.min("e.v"), F.min("e.u")).alias("m"))
        large = e.join(least, F.col("lo") == F.col("w")).select("hi", "m").where("hi <> m")
        # small star: a node and its neighbours below go to the smallest of these
        below = large.groupBy(F.col("hi").alias("w")).agg(F.min("m").alias("least"))
        both = F.explode(F.array(F.struct(F.col("m").alias("hi"), F.col("least").alias("lo")), F.struct(F.col("hi").alias("hi"), F.col("least").alias("lo"))))
        small = large.join(below, F.col("hi") == F.col("w")).select(both.alias("e")).select("e.lo", "e.hi").where("hi <> lo").dropDuplicates()
        e = checkpoint(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    hung = e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
    return hung.union(e.select("lo", F.col("lo").alias("component")).dropDuplicates())
