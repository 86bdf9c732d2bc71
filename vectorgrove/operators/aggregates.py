"""Grouped vector aggregates, occupancy, histograms and cuts, without Python code on the data path."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def exploded(df: DataFrame, vector_col: str, *keep: str) -> DataFrame:
    """One row per component: keep..., pos, x (double)."""
    return df.select(*keep, F.posexplode(F.col(vector_col)).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def centroids(df: DataFrame, vector_col: str, by: list[str], weight: Column | None = None) -> DataFrame:
    """by..., pos, mean: (weighted) means of components in double precision, as partial and final sums."""
    rows = df.withColumn("_w", (weight if weight is not None else F.lit(1.0)).cast("double"))
    x = exploded(rows, vector_col, *by, "_w")
    return x.groupBy(*by, "pos").agg((F.sum(F.col("x") * F.col("_w")) / F.sum("_w")).alias("mean"))


def occupancy(members: DataFrame, clusters: int, cluster_col: str = "cluster_id", synthetic_col: str | None = None) -> DataFrame:
    """cluster_id, total, real and synthetic members, with zeros for declared clusters that have none."""
    synthetic = F.col(synthetic_col) if synthetic_col else F.lit(False)
    found = members.groupBy(F.col(cluster_col).cast("long").alias("c")).agg(F.count("*").alias("total"), F.count_if(~synthetic).alias("real"), F.count_if(synthetic).alias("synthetic"))
    declared = members.sparkSession.range(clusters).withColumnRenamed("id", "cluster_id")
    return declared.join(found, F.col("cluster_id") == F.col("c"), "left").select("cluster_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "real", "synthetic")))


def occupancy_stats(occ: DataFrame) -> DataFrame:
    """Mean, population deviation, least and largest number of members."""
    return occ.agg(F.avg("total").alias("mean"), F.stddev_pop("total").alias("stddev"), F.min("total").alias("least"), F.max("total").alias("largest"))


def rank_in_order(df: DataFrame, order: list, name: str = "place", buckets: int | None = None) -> DataFrame:
    """0-based rank in a total order without a single-task sort.

    Rows are put into ranges of the order, ranked within each, and moved on by
    the rows of the ranges before.  Ties need to be broken by the order.
    """
    from vectorgrove.session import checkpoint

    buckets = buckets or max(64, df.count() // 1_000_000)
    ranged = checkpoint(df.repartitionByRange(buckets, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    starts = starts.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    w = Window.partitionBy("_range").orderBy(*order)
    joined = ranged.join(F.broadcast(starts), F.col("_range") == F.col("_r"))  # a row for each range
    return joined.withColumn(name, F.col("_start") + F.row_number().over(w) - 1).drop("_range", "_r", "_start")


def balanced_group(place: Column, n: int, groups: int) -> Column:
    """Group of a 0-based place when n rows are cut into contiguous groups, the first n % groups one larger."""
    size, more = divmod(n, groups)
    edge = more * (size + 1)
    return F.when(place < edge, F.floor(place / (size + 1))).otherwise(more + F.floor((place - edge) / max(1, size))).cast("long")


def balanced_ranges(df: DataFrame, order: list, bound: int, name: str = "leaf") -> DataFrame:
    """Contiguous groups of at most ``bound`` rows in the order, sizes at most one apart."""
    n = df.count()
    return rank_in_order(df, order).withColumn(name, balanced_group(F.col("place"), n, max(1, math.ceil(n / bound)))).drop("place")


def exact_chunks(df: DataFrame, order: list, size: int, name: str = "chunk") -> DataFrame:
    return rank_in_order(df, order).withColumn(name, F.floor(F.col("place") / size).cast("long")).drop("place")


def quantile_cuts(df: DataFrame, value: Column, bins: int) -> list[float]:
    """Exact order statistics at ranks ceil(b * n / bins); the driver gets bins - 1 values."""
    x = df.select(value.cast("double").alias("x"))
    n = x.count()
    targets = {math.ceil(b * n / bins) - 1 for b in range(1, bins)}
    ranked = rank_in_order(x.withColumn("_tie", F.monotonically_increasing_id()), [F.col("x"), F.col("_tie")])
    got = {r.place: r.x for r in ranked.where(F.col("place").isin(*targets)).collect()} if n and targets else {}
    return [got[math.ceil(b * n / bins) - 1] for b in range(1, bins)] if n else []


def bin_of(value: Column, cuts: list[float]) -> Column:
    """Number of cuts below the value: one that equals a cut is in the lower bin."""
    return sum((F.when(value > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("long")


def histogram(df: DataFrame, value: Column, buckets: int) -> DataFrame:
    """bucket, n: buckets between least and largest value, by rounding the share of the way times buckets - 1."""
    low, high = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    span = (high - low) if low is not None else 0.0
    at = F.floor((value.cast("double") - F.lit(low)) / F.lit(span) * (buckets - 1) + 0.5) if span else F.lit(0)
    return df.select(at.cast("long").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
