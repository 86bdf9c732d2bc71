"""Hierarchies built from below, replay of split cells, harvests, repeat runs and planner averages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from vectorgrove.operators.aggregates import balanced_ranges, centroids, rank_in_order
from vectorgrove.operators.identity import differences
from vectorgrove.session import checkpoint

#: Child counts up to this many rows are broadcast; more are joined by a shuffle.
MAX_BROADCAST_COUNTS = 65_536

#: unit, items and vector of a layer, and its level, to unit and grp.
Grouping = Callable[[DataFrame, int], DataFrame]


def _mean_vectors(members: DataFrame) -> DataFrame:
    """grp, items, vector: means weighted by items, in single precision."""
    means = centroids(members, "vector", ["grp"], F.col("items"))
    by_pos = F.sort_array(F.collect_list(F.struct("pos", "mean")))  # a vector's components
    vectors = means.groupBy(F.col("grp").alias("g")).agg(F.transform(by_pos, lambda p: p["mean"].cast("float")).alias("vector"))
    return members.groupBy("grp").agg(F.sum("items").alias("items"), F.min("unit").alias("unit")).join(vectors, F.col("grp") == F.col("g")).select("unit", "items", "vector", "grp")


def with_singletons_merged(grouped: DataFrame) -> tuple[DataFrame, int]:
    """unit, grp with groups of one unit put into the largest group (the smallest number of equals), and the number of groups left.

    Where all groups have one unit nothing is merged.
    """
    sizes = checkpoint(grouped.groupBy("grp").agg(F.count("*").alias("n")))
    largest = sizes.orderBy(F.desc("n"), "grp").first()
    if largest is None or largest.n == 1:
        return grouped, sizes.count()
    single = sizes.where("n = 1").select(F.col("grp").alias("s"))
    merged = grouped.join(single, F.col("grp") == F.col("s"), "left").select("unit", F.when(F.col("s").isNull(), F.col("grp")).otherwise(F.lit(largest.grp)).alias("grp"))
    return merged, sizes.where("n > 1").count()


def hybrid(fine: Grouping, coarse: Grouping, most: int) -> Grouping:
    """The fine grouping for layers that stand for ``most`` items at most, the coarse one for others."""
    return lambda layer, level: (fine if (layer.agg(F.sum("items")).first()[0] or 0) <= most else coarse)(layer, level)


def agglomerate(leaves: DataFrame, grouping: Grouping, bound: int) -> DataFrame:
    """level (leaves 0), unit, parent, items, vector of all nodes, built layer by layer until one is left.

    ``leaves`` has unit (long), items (long) and vector.  A grouping that
    leaves one group, or as many as there were units, gives way to balanced
    groups of at most ``bound`` in the order of units.  A parent is named by
    its smallest unit, on the next level; the root has none.
    """
    if bound < 2:
        raise ValueError("groups need a bound of two at least")
    layer, level, nodes = checkpoint(leaves.select("unit", "items", F.col("vector").cast("array<float>").alias("vector"))), 0, None
    n = layer.count()
    while n > 1:
        grouped, groups = with_singletons_merged(checkpoint(grouping(layer, level).select("unit", "grp")))
        if groups <= 1 or groups >= n:
            grouped = balanced_ranges(layer.select("unit"), ["unit"], bound, "grp")
        members = checkpoint(layer.join(grouped.select(F.col("unit").alias("u"), "grp"), F.col("unit") == F.col("u")).drop("u"))
        above = checkpoint(_mean_vectors(members))
        up = above.select(F.col("grp").alias("g"), F.col("unit").alias("parent"))
        placed = members.join(up, F.col("grp") == F.col("g")).select(F.lit(level).alias("level"), "unit", "parent", "items", "vector")
        nodes = placed if nodes is None else nodes.unionByName(placed)
        layer, level = above.drop("grp"), level + 1
        n = layer.count()
    root = layer.select(F.lit(level).alias("level"), "unit", F.lit(None).cast("long").alias("parent"), "items", "vector")
    return root if nodes is None else nodes.unionByName(root)


def replayed(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """idx, cell, child: items of a cell in the order of idx go to its children, as many to each as ``counts`` (cell, child, n) says.

    Places come from one order of all rows, so that a cell may hold most of
    them; items beyond a cell's counts, or of cells without, have a null child.
    """
    placed = rank_in_order(rows.select("cell", "idx"), ["cell", "idx"])
    starts = placed.groupBy(F.col("cell").alias("c")).agg(F.min("place").alias("start"))
    edges = F.sort_array(F.collect_list(F.struct("child", "n")))  # a cell's children
    ends = F.transform(F.col("e"), lambda x, i: F.struct(x["child"].alias("child"), F.aggregate(F.slice("e", 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("end")))
    table = checkpoint(counts.groupBy("cell").agg(edges.alias("e")).select(F.col("cell").alias("k"), ends.alias("ends")).join(starts, F.col("k") == F.col("c")).drop("c"))
    table = F.broadcast(table) if counts.count() <= MAX_BROADCAST_COUNTS else table
    at = F.filter("ends", lambda x: x["end"] > F.col("place") - F.col("start"))
    return placed.join(table, F.col("cell") == F.col("k"), "left").select("idx", "cell", F.get(at, F.lit(0))["child"].alias("child"))


def harvested(entities: DataFrame, n: int, id_col: str = "entity_id", synthetic_col: str = "synthetic") -> DataFrame:
    """The first n real entities in the order of ids; fewer are an error."""
    real = entities.where(~F.col(synthetic_col)).orderBy(id_col).limit(n)
    if (there := real.count()) < n:
        raise ValueError(f"{there} real entities, {n} asked for")
    return real


def repeated_differences(run: Callable[[], DataFrame]) -> DataFrame:
    """missing and added: what a second run lacks and has beyond the first; both 0 if runs are alike."""
    return differences(checkpoint(run()), checkpoint(run()))


def planning_averages(runs: DataFrame, by: str = "planner") -> DataFrame:
    """by, runs, quality: means over the planner runs that have a quality."""
    return runs.groupBy(by).agg(F.count("quality").alias("runs"), F.avg("quality").alias("quality"))


def total_order(x: Column) -> list[Column]:
    """Sort keys of doubles in total order: as numbers, but -0.0 before 0.0."""
    return [x, F.when((x == 0) & x.cast("string").startswith("-"), 0).otherwise(1)]
