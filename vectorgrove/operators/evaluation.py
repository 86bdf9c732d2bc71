"""Metrics, gates, rankings and corpora of the evaluation layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def same_leaf_coherence(members: DataFrame, neighbors: DataFrame) -> DataFrame:
    """coherence: share of (entity, neighbour) pairs in one cluster; 0 without pairs.  Synthetic members don't count."""
    m = members.where(~F.col("synthetic")) if "synthetic" in members.columns else members
    a = m.select(F.col("entity_id").alias("e"), F.col("cluster_id").alias("ce"))
    b = m.select(F.col("entity_id").alias("nb"), F.col("cluster_id").alias("cn"))
    pairs = neighbors.join(a, F.col("entity_id") == F.col("e")).join(b, F.col("neighbor_id") == F.col("nb"))
    return pairs.agg(F.coalesce(F.avg((F.col("ce") == F.col("cn")).cast("double")), F.lit(0.0)).alias("coherence"))


def quantization_error(values: DataFrame, by: list[str]) -> DataFrame:
    """by..., err: summed squared error of 8-bit codes between each group's least and largest value per pos.

    Codes are rounded half away from zero; a range of 0 has no error.
    """
    keys = [*by, "pos"]
    ends = values.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    # without groups there is a row for each component
    ends = ends.withColumn("span", F.col("hi") - F.col("lo")) if by else F.broadcast(ends.withColumn("span", F.col("hi") - F.col("lo")))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    r = values.join(ends, on)
    share = F.least(F.greatest((F.col("x") - F.col("lo")) / F.col("span"), F.lit(0.0)), F.lit(1.0))
    back = F.col("lo") + F.floor(share * 255 + 0.5) / 255 * F.col("span")
    err = F.when(F.col("span") > 0, (F.col("x") - back) * (F.col("x") - back)).otherwise(0.0)
    out = r.withColumn("e", err)
    return (out.groupBy(*by) if by else out.groupBy()).agg(F.sum("e").alias("err"))


def compression_gain(values: DataFrame, cluster_col: str) -> DataFrame:
    """gain: 1 - local error / global error of 8-bit codes; 0 where the global error is 0."""
    local = quantization_error(values, [cluster_col]).agg(F.sum("err").alias("local"))
    whole = quantization_error(values, []).select(F.col("err").alias("whole"))
    return local.join(whole).select(F.when(F.col("whole") > 0, 1 - F.col("local") / F.col("whole")).otherwise(0.0).alias("gain"))  # one row each


def tnn_recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """qid, recall: hits among the first k of both (qid, rk, id) over min(k, exact ids); 1 where there are none."""
    f = found.where(F.col("rk") <= k).groupBy("qid").agg(F.collect_set("id").alias("f"))
    e = exact.where(F.col("rk") <= k).groupBy(F.col("qid").alias("q")).agg(F.collect_set("id").alias("e"))
    hits = F.size(F.array_intersect("f", "e"))
    return f.join(e, F.col("qid") == F.col("q"), "left").select("qid", F.when(F.size("e") > 0, hits / F.size("e")).otherwise(1.0).alias("recall"))


def gates(members: DataFrame, occ: DataFrame, entities: DataFrame, leaf_size: int) -> DataFrame:
    """gate, passed: one row for each occupancy and coverage gate, from one row of aggregates each."""
    o = occ.agg(F.min("total").alias("lo"), F.max("total").alias("hi"))
    m = members.agg(F.count("*").alias("assigned"), F.countDistinct("entity_id").alias("unique"))
    e = entities.agg(F.count("*").alias("declared"))
    row = o.join(m).join(e)  # one row each
    checks: dict[str, Column] = {
        "exact_leaf_occupancy": (F.col("lo") == leaf_size) & (F.col("hi") == leaf_size),
        "leaf_size_at_least": F.col("lo") >= leaf_size // 2,
        "leaf_size_at_most": F.col("hi") <= leaf_size,
        "complete_coverage": F.col("unique") == F.col("declared"),
        "one_cluster_per_entity": F.col("assigned") == F.col("unique"),
        "no_empty_declared_clusters": F.col("lo") > 0,
    }
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), c.alias("passed")) for k, c in checks.items()])).alias("g")).select("g.gate", "g.passed")


def ranked(scores: DataFrame, score: str = "score", ident: str = "id") -> DataFrame:
    """With rank from 1: score falling, then id.  For candidate tables, whose size the caller bounds."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), ident)).cast("long"))


def synthetic_corpus(spark, family: str, n: int, dims: int) -> DataFrame:
    """i, pos, x of a closed-form corpus: well-clustered, weak-uniform, anisotropic or near-duplicate."""
    i, j = F.col("i"), F.col("pos")
    t = i / n
    x = {
        "well-clustered": 25.0 * (i % 4) + 0.05 * j + 0.01 * F.floor(i / 4),
        "weak-uniform": ((i * (j + 3) + 17 * j) % 97) / 97,
        "anisotropic": F.when(j == 0, 12 * t).when(j == 1, 3 * F.sin(F.lit(6.283185307179586) * t)).otherwise(0.2 * t * (j + 1)),
        "near-duplicate": 4.0 * (i % 5) + 0.25 * j + 0.0005 * F.floor(i / 5),
    }[family]
    grid = spark.range(n).withColumnRenamed("id", "i").withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))))
    return grid.select("i", "pos", x.cast("double").alias("x"))
