"""Alignment of corpora to leaf sizes, padding reports, quantized vectors, range lookup, and candidate scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from vectorgrove.functions import vectors as V
from vectorgrove.operators.aggregates import exact_chunks, rank_in_order

# How much the two metrics of the panel count.
PANEL_WEIGHTS = {"coherence": 1.0, "compression_gain": 0.5}


def aligned(df: DataFrame, leaf: int, policy: str = "padding", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """entity_id, embedding (double) and synthetic of a corpus whose size is a multiple of ``leaf``.

    'strict' asks for such a size, 'padding' for another one, which it fills
    with vectors on a line beyond the largest component, as long as the upper
    median of the positive lengths.
    """
    real = df.select(F.col(id_col).cast("string").alias("entity_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.lit(False).alias("synthetic"))
    n, dims, largest = real.agg(F.count("*"), F.max(F.size("embedding")), F.max(F.array_max(F.transform("embedding", F.abs)))).first()
    if policy == "strict":
        if n % leaf:
            raise ValueError(f"{n} entities aren't a multiple of {leaf}")
        return real
    if not n or not n % leaf:
        raise ValueError(f"nothing to pad in {n} entities for leaves of {leaf}")
    lengths = real.select(V.norm(F.col("embedding")).alias("length"), "entity_id").where((F.col("length") > 0) & (F.col("length") < float("inf")))
    positive = lengths.count()
    place = rank_in_order(lengths, ["length", "entity_id"])
    target = place.where(F.col("place") == positive // 2).first()
    begin = max(1.0, largest) + 10.0
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda j: F.lit(begin) + F.col("id") + j * 0.125)
    padding = df.sparkSession.range(math.ceil(n / leaf) * leaf - n).select("id", raw.alias("raw"))
    scale = F.lit(target.length) / V.norm(F.col("raw")) if target is not None else F.lit(1.0)
    padding = padding.withColumn("scale", scale)
    made = padding.select(F.format_string("synthetic-%06d", F.col("id")).alias("entity_id"), F.transform("raw", lambda x: x * F.col("scale")).alias("embedding"), F.lit(True).alias("synthetic"))
    return real.unionByName(made)


def padding_concentration(occupancy: DataFrame, leaf: int) -> DataFrame:
    """synthetic, clusters with some, the least number of clusters that could hold them, and whether that is met; no row without padding."""
    found = occupancy.agg(F.coalesce(F.sum("synthetic"), F.lit(0)).alias("synthetic"), F.count_if(F.col("synthetic") > 0).alias("clusters")).where("synthetic > 0")
    least = F.ceil(F.col("synthetic") / leaf).cast("long")
    return found.select("synthetic", "clusters", least.alias("least"), (F.col("clusters") == least).alias("met"))


def quantized(vector: Column, bits: int = 8) -> Column:
    """scale and codes: components over scale, rounded half to even; the largest magnitude has the largest code."""
    most = float(2 ** (bits - 1) - 1)
    v = vector.cast("array<double>")
    largest = F.array_max(F.transform(v, F.abs))
    scale = F.when(largest > 0, largest / most).otherwise(1.0)
    codes = F.transform(v, lambda x: F.least(F.greatest(F.rint(x / scale), F.lit(-most)), F.lit(most)).cast("int"))
    return F.struct(scale.alias("scale"), codes.alias("codes"))


def dequantized(code: Column) -> Column:
    return F.transform(code["codes"], lambda c: c * code["scale"])


def chunk_bounds(df: DataFrame, key: str, id_col: str, size: int) -> list[float]:
    """Largest key of each exact chunk but the last; as many numbers as chunks come to the driver."""
    chunks = exact_chunks(df.select(F.col(key).alias("key"), id_col), ["key", id_col], size)
    return [r.bound for r in chunks.groupBy("chunk").agg(F.max("key").alias("bound")).orderBy("chunk").collect()][:-1]


def chunk_of(key: Column, bounds: list[float]) -> Column:
    """The first chunk whose bound isn't under the key, by the number of bounds that are."""
    if not bounds:
        return F.lit(0).cast("long")
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < key)).cast("long")


def weighted_scores(metrics: DataFrame, weights: dict[str, float] = PANEL_WEIGHTS) -> DataFrame:
    """candidate, score: the sum of weighted metrics (candidate, metric, value); a metric that isn't there adds nothing."""
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("metric")), F.lit(0.0))
    return metrics.groupBy("candidate").agg(F.sum(F.col("value") * weight).alias("score"))


def beam_reports(runs: DataFrame) -> DataFrame:
    """By beam width of search runs (beam_width, visited, depth, recall, termination): means, and how many succeeded."""
    return runs.groupBy("beam_width").agg(
        F.count("*").alias("queries"), F.avg("visited").alias("visited"), F.avg("depth").alias("depth"), F.avg("recall").alias("recall"),
        F.count_if(F.col("termination") == "success").alias("succeeded"), F.count_if(F.col("termination") == "exhausted").alias("exhausted"),
    )


def require_spec(left: tuple[int, str], right: tuple[int, str]) -> None:
    """Two vectors' dimensions and encodings have to be the same."""
    if left != right:
        raise ValueError(f"{left[0]} components as {left[1]} don't go with {right[0]} as {right[1]}")
