"""Best-first and greedy beam search of many queries at once, as joins of frontiers with the edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from vectorgrove.functions import vectors as V
from vectorgrove.plans.indexer import Index
from vectorgrove.session import checkpoint, checkpoint_dealt, checkpoint_in_place


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _prepared(index: Index, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges, dealt by parents, and queries, each with the length of its vector."""
    e = index.edges.select("parent", "child", F.col("level").alias("in_level"), "child_level", "embedding", V.norm(F.col("embedding")).alias("length"))
    targets = queries.select(F.col("qid").alias("q"), "target", V.norm(F.col("target")).alias("target_length"))
    return checkpoint_dealt(e, _partitions(e), "parent"), checkpoint(targets)


def _entries(edges: DataFrame, wanted: DataFrame, targets: DataFrame, vectors: bool = False) -> DataFrame:
    """Scored entries of blocks (qid, block, depth): qid, child, level (of the containing block, 0 for leaves), depth, score, embedding (of branches, if ``vectors``)."""
    # a block that isn't there is an error, not an end of the search
    e = edges.withColumn("there", F.lit(True))
    found = wanted.join(e, F.col("block") == F.col("parent"), "left").withColumn("child", F.when(F.col("there"), F.col("child")).otherwise(F.raise_error(F.lit("missing block")).cast("binary")))
    found = found.join(targets, F.col("qid") == F.col("q"))
    level = F.when(F.col("child_level") == 0, 0).otherwise(F.col("in_level"))
    lengths = F.col("target_length") * F.col("length")
    score = F.when(lengths != 0, V.dot(F.col("target"), F.col("embedding")) / lengths)
    kept = F.when((F.col("child_level") > 0) & F.lit(vectors), F.col("embedding"))
    return found.select("qid", "child", level.alias("level"), "depth", score.alias("score"), kept.alias("embedding"))


def _geometry(width: int):
    """Of the best 2 * width candidates, the first, then always the one farthest from all taken."""

    def select(qid: int, g: list[tuple]) -> list[tuple]:
        x = np.array([v for _, _, v in g], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        d, taken = 1 - x @ x.T, [0]
        while len(taken) < min(width, len(g)):
            far = d[:, taken].min(1)
            far[taken] = -np.inf
            taken.append(int(far.argmax()))
        return [(qid, *g[i][:2]) for i in taken]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, held = None, []  # candidates of a query follow each other, over batches too
        for x in frames:
            out = []
            for qid, *row in zip(x["qid"], x["child"], x["depth"], x["embedding"], strict=True):
                if qid != of and held:
                    out += select(of, held)
                    held = []
                of = qid
                held.append(tuple(row))
            yield pd.DataFrame(out, columns=["qid", "child", "depth"])
        if held:
            yield pd.DataFrame(select(of, held), columns=["qid", "child", "depth"])

    return run


def best_first(index: Index, queries: DataFrame, width: int, n: int, selector: str = "top-w") -> tuple[DataFrame, DataFrame]:
    """Results (qid, position, leaf, score) and telemetry (qid, visited, depth, termination) of queries (qid, target).

    Every round drops expanded branches, ranks by score, level and id, ends
    the queries whose first n are leaves, and expands at most ``width``
    distinct branches of the others.  All queries advance in the same jobs.
    """
    if width < 1:
        raise ValueError("width must be positive")
    if n < 1:
        empty = queries.select("qid", F.lit(0).alias("position"), F.lit(b"").alias("leaf"), F.lit(0.0).alias("score")).limit(0)
        return empty, queries.select("qid", F.lit(1).cast("long").alias("visited"), F.lit(1).alias("depth"), F.lit("success").alias("termination"))
    root = queries.select("qid", F.lit(index.root).alias("block"), F.lit(1).alias("depth"))
    rank = Window.partitionBy("qid").orderBy(F.desc("score"), "level", "child")
    leaves_before = Window.partitionBy("qid").orderBy(F.col("level") > 0, F.desc("score"), "child")
    edges, targets = _prepared(index, queries)

    def dealt(rows: DataFrame) -> DataFrame:
        """By query, and without leaves that n better ones precede: none of these is ever among the first n."""
        best = rows.repartition(_partitions(rows), "qid").withColumn("o", F.row_number().over(leaves_before)).where((F.col("level") > 0) | (F.col("o") <= n))
        return checkpoint_in_place(best.drop("o"))

    geometry = selector == "geometry-aware"
    frontier = dealt(_entries(edges, root, targets, geometry))
    expanded = root.select("qid", "block", "depth")
    results, ends = None, None
    while True:
        ranked = frontier.withColumn("r", F.row_number().over(rank))
        leaves_first = ranked.where(F.col("r") <= n).groupBy(F.col("qid").alias("q")).agg(F.count("*").alias("m"), F.max("level").alias("top"))
        branches = frontier.where("level > 0").groupBy(F.col("qid").alias("q2")).agg(F.count("*").alias("branches"))
        state = checkpoint(leaves_first.join(branches, F.col("q") == F.col("q2"), "left").select("q", F.when((F.col("m") == n) & (F.col("top") == 0), "success").when(F.col("branches").isNull(), "exhausted").alias("end")))
        done = state.where("end IS NOT NULL")
        got = ranked.join(done.where("end = 'success'"), F.col("qid") == F.col("q")).where(F.col("r") <= n).select("qid", (F.col("r") - 1).alias("position"), F.col("child").alias("leaf"), "score")
        ended = done.select(F.col("q").alias("qid"), F.col("end").alias("termination"))
        results, ends = (got, ended) if results is None else (results.union(got), ends.union(ended))
        going = frontier.join(state.where("end IS NULL"), F.col("qid") == F.col("q"), "left_semi")
        if going.isEmpty():
            break
        once = going.where("level > 0").withColumn("o", F.row_number().over(Window.partitionBy("qid", "child").orderBy(F.desc("score"), "level"))).where("o = 1")
        best = once.withColumn("r", F.row_number().over(rank))
        if geometry:
            candidates = best.where(F.col("r") <= 2 * width).select("qid", "child", "depth", "r", "embedding")
            chosen = candidates.repartition(_partitions(candidates), "qid").sortWithinPartitions("qid", "r").mapInPandas(_geometry(width), "qid long, child binary, depth int")
        else:
            chosen = best.where(F.col("r") <= width).select("qid", "child", "depth")
        chosen = checkpoint(chosen.select("qid", F.col("child").alias("block"), (F.col("depth") + 1).alias("depth")))
        expanded = expanded.union(chosen)
        left = going.join(chosen.select(F.col("qid").alias("cq"), F.col("block").alias("cb")), (F.col("qid") == F.col("cq")) & (F.col("child") == F.col("cb")), "left_anti")
        frontier = dealt(left.unionByName(_entries(edges, chosen, targets, geometry)))
    visits = expanded.groupBy(F.col("qid").alias("v")).agg(F.countDistinct("block").alias("visited"), F.max("depth").alias("depth"))
    return results, ends.join(visits, F.col("qid") == F.col("v")).select("qid", "visited", "depth", "termination")


def greedy_beam(index: Index, queries: DataFrame, beam: int, k: int) -> DataFrame:
    """qid, rk, leaf, score: level by level the best ``beam`` distinct branches are expanded; leaves met on the way are ranked at the end."""
    active = queries.select("qid", F.lit(index.root).alias("block"), F.lit(1).alias("depth"))
    leaves = None
    edges, targets = _prepared(index, queries)
    while True:
        found = checkpoint(_entries(edges, active, targets))
        here = found.where("level = 0").select("qid", "child", "score")
        leaves = here if leaves is None else leaves.union(here)
        branches = found.where("level > 0").groupBy("qid", "child").agg(F.max("score").alias("score"), F.min("depth").alias("depth"))
        if branches.isEmpty():
            break
        w = Window.partitionBy("qid").orderBy(F.desc("score"), "child")
        active = branches.withColumn("r", F.row_number().over(w)).where(F.col("r") <= beam).select("qid", F.col("child").alias("block"), (F.col("depth") + 1).alias("depth"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "child")
    best = leaves.groupBy("qid", "child").agg(F.max("score").alias("score"))
    return best.withColumn("rk", F.row_number().over(w).cast("long")).where(F.col("rk") <= k).select("qid", "rk", F.col("child").alias("leaf"), "score")
