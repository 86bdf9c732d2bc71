"""Trees of partitions as edge tables: building balanced ones, walking, and checking them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from vectorgrove.operators.aggregates import balanced_group, rank_in_order
from vectorgrove.session import checkpoint


def balanced_tree(df: DataFrame, order: list[str], fan: int) -> DataFrame:
    """parent, child, level (of the child, leaves 0): contiguous groups of at most ``fan``, level by level, until one is left."""
    n = df.count()
    layer = rank_in_order(df.select(*order), order).select(F.col("place").alias("at"))
    edges, level = None, 0
    while n > 1:
        groups = math.ceil(n / fan)
        grouped = checkpoint(layer.select("at", balanced_group(F.col("at"), n, groups).alias("group")))
        name = lambda lv, c: F.concat(F.lit(f"{lv}-"), F.col(c).cast("string"))
        more = grouped.select(name(level + 1, "group").alias("parent"), name(level, "at").alias("child"), F.lit(level).alias("level"))
        edges = more if edges is None else edges.unionByName(more)
        layer, n, level = grouped.select(F.col("group").alias("at")).distinct(), groups, level + 1
    return edges if edges is not None else df.sparkSession.createDataFrame([], "parent string, child string, level int")


def root_of(edges: DataFrame) -> DataFrame:
    """node: parents that are nobody's child."""
    return edges.select(F.col("parent").alias("node")).distinct().join(edges.select("child"), F.col("node") == F.col("child"), "left_anti")


def traverse(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, depth, references and children of every node reached from the roots (node), breadth first.

    A node counts at its least depth, however often it is referred to; cycles
    end as nothing new is reached.
    """
    reached = checkpoint(roots.select("node", F.lit(0).alias("depth")).dropDuplicates(["node"]))
    frontier, depth = reached, 0
    e = edges.select("parent", "child")
    while True:
        depth += 1
        found = e.join(frontier.select("node"), F.col("parent") == F.col("node")).select(F.col("child").alias("node")).distinct()
        frontier = checkpoint(found.join(reached.select(F.col("node").alias("seen")), F.col("node") == F.col("seen"), "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    below = e.groupBy(F.col("parent").alias("p")).agg(F.count("*").alias("children"))
    above = e.groupBy(F.col("child").alias("c")).agg(F.count("*").alias("references"))
    out = reached.join(below, F.col("node") == F.col("p"), "left").join(above, F.col("node") == F.col("c"), "left")
    return out.select("node", "depth", F.coalesce("references", F.lit(0)).cast("long").alias("references"), F.coalesce("children", F.lit(0)).cast("long").alias("children"))


def over_cap(edges: DataFrame, cap: int) -> DataFrame:
    """parent, children of nodes with more children than the cap."""
    return edges.groupBy("parent").agg(F.count("*").alias("children")).where(F.col("children") > cap)


def largest(blocks: DataFrame, k: int, id_col: str = "block_id", size_col: str = "size") -> DataFrame:
    """rank, id and size of the k largest blocks; of equal ones the smaller id comes first."""
    top = blocks.select(id_col, size_col).orderBy(F.desc(size_col), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(size_col), id_col)).cast("long"))  # k rows


def violations(parts: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """rule, broken: how often a partition hierarchy (pid, parent, terminal; items pid, idx) breaks each rule.

    The only root holds 0 to n - 1; parents exist; terminal partitions have
    items and no children, others children; a partition's items are exactly
    its children's, each in one child.
    """
    spark = parts.sparkSession
    p, i = parts.select("pid", "parent", "terminal"), items.select("pid", "idx")
    roots = p.where("parent IS NULL").select(F.col("pid").alias("root"))
    of_root = i.join(roots, F.col("pid") == F.col("root")).select("idx").distinct()
    children = p.where("parent IS NOT NULL").select(F.col("parent").alias("of"), F.col("pid").alias("child"))
    has_items, has_children = i.select(F.col("pid").alias("h")).distinct(), children.select(F.col("of").alias("h")).distinct()
    inner = i.join(has_children, F.col("pid") == F.col("h"), "left_semi")
    from_children = children.join(i, F.col("child") == F.col("pid")).select(F.col("of").alias("o"), F.col("idx").alias("x"))
    distinct = from_children.distinct()
    rules = {
        "one_root": roots.agg(F.abs(F.count("*") - 1).alias("broken")),
        "root_covers_all": of_root.where(F.col("idx").between(0, n - 1)).agg((F.lit(n) - F.count("*")).alias("broken")),
        "items_in_range": i.where(~F.col("idx").between(0, n - 1)).agg(F.count("*").alias("broken")),
        "parent_exists": children.join(p.select(F.col("pid").alias("there")), F.col("of") == F.col("there"), "left_anti").agg(F.count("*").alias("broken")),
        "terminal_has_items": p.where("terminal").join(has_items, F.col("pid") == F.col("h"), "left_anti").agg(F.count("*").alias("broken")),
        "terminal_has_no_children": p.where("terminal").join(has_children, F.col("pid") == F.col("h"), "left_semi").agg(F.count("*").alias("broken")),
        "inner_has_children": p.where("NOT terminal").join(has_children, F.col("pid") == F.col("h"), "left_anti").agg(F.count("*").alias("broken")),
        "items_in_a_child": inner.join(distinct, (F.col("pid") == F.col("o")) & (F.col("idx") == F.col("x")), "left_anti").agg(F.count("*").alias("broken")),
        "items_from_parent": distinct.join(i, (F.col("o") == F.col("pid")) & (F.col("x") == F.col("idx")), "left_anti").agg(F.count("*").alias("broken")),
        "items_in_one_child": from_children.groupBy("o", "x").count().where("count > 1").agg(F.count("*").alias("broken")),
    }
    out = spark.createDataFrame([], "rule string, broken long")
    for rule, found in rules.items():
        out = out.unionByName(found.select(F.lit(rule).alias("rule"), F.col("broken").cast("long").alias("broken")))
    return out
