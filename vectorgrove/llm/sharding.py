"""Sharding by sampled splitters, with DataFrame operations only.

Rows are ordered by a 64-bit hash of their text, so equal texts are
neighbours.  Keys sampled in proportion to size give quantile boundaries;
exact totals of the ranges between them are then summed up, overfull ranges
are subdivided, and every row is put at its exact position in bytes.  A shard
is an equal share of these positions, so its size differs from the mean by at
most the larger of the largest row and ``group_share`` of a shard.

A group of equal texts no larger than that bound stays in one shard; a larger
one (a hot key may hold a third of all rows) is split by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vectorgrove.llm.common import checkpoint

#: Ranges: one for each ROWS_PER_RANGE rows within these bounds.  The driver holds SAMPLES_PER_RANGE keys for each.
MIN_RANGES, MAX_RANGES, ROWS_PER_RANGE, SAMPLES_PER_RANGE = 1024, 20_000, 5_000, 16

SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def _number_of_splitters_up_to(key: Column, splitters: list[int]) -> Column:
    """By binary search in a constant array."""
    if not splitters:
        return F.lit(0)
    array = F.expr(f"cast(split('{','.join(map(str, splitters))}', ',') as array<bigint>)")
    steps = [1 << i for i in reversed(range(len(splitters).bit_length()))]

    def step(acc: Column, by: Column) -> Column:
        further = F.coalesce(F.get(array, acc.pos + by - 1) <= acc.key, F.lit(False))
        return F.struct(F.when(further, acc.pos + by).otherwise(acc.pos).alias("pos"), acc.key.alias("key"))

    # the key travels with the position, as the optimiser doesn't see columns inside a lambda and would push a filter on them where they don't exist
    return F.aggregate(F.array(*map(F.lit, steps)), F.struct(F.lit(0).alias("pos"), key.alias("key")), step, lambda acc: acc.pos)


def _splitters(sample: list[int], ranges: int) -> list[int]:
    """Quantiles of the sorted sample; a key that fills whole ranges gets one of its own."""
    sample = sorted(sample)
    cuts = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []
    hot = {a for a, b in zip(cuts, cuts[1:], strict=False) if a == b}
    return sorted({*cuts, *(k + 1 for k in hot if k < 2**63 - 1)})


def shard_documents(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
    group_share: float = 0.01,
    seed: int = 17,
) -> DataFrame:
    """Put every row into a shard of nearly equal size in bytes, with a gapless slot.

    A row's size is the UTF-8 length of its text plus ``overhead``; a null
    text has length 0 and the checksum of an empty one.  Ties (equal texts)
    go by id, null ids first; repeated rows take slots of their own.  An
    empty table gives no rows.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("key"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    base = checkpoint(base)
    total, rows, largest = base.agg(F.sum("size"), F.count("*"), F.max("size")).first()
    if not rows:
        return base.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    ranges = min(MAX_RANGES, max(MIN_RANGES, -(-rows // ROWS_PER_RANGE)))

    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "key", F.lit(seed)), 11) / F.lit(float(1 << 53))
    drawn = base.where(chance < F.col("size") * F.lit(SAMPLES_PER_RANGE * ranges / total)).select("key")
    splitters = _splitters([r.key for r in drawn.collect()], ranges)

    ranged = base.withColumn("rng", _number_of_splitters_up_to(F.col("key"), splitters))
    # ranges are bounded in number, so their totals may be held by the driver
    share = total / ranges
    overfull = {r.rng: -(-r.w // int(share + 1)) for r in ranged.groupBy("rng").agg(F.sum("size").alias("w")).where(F.col("w") > 2 * share).collect()}
    one_key = {i for i in overfull if 0 < i < len(splitters) and splitters[i] == splitters[i - 1] + 1}
    sub = F.lit(0)
    if overfull:
        parts = F.create_map(*(F.lit(x) for kv in overfull.items() for x in kv))
        by = F.when(F.col("rng").isin(sorted(one_key)), F.xxhash64("doc_id", F.lit(seed + 1))) if one_key else F.when(F.lit(False), F.lit(0).cast("long"))
        sub = F.coalesce(F.pmod(by.otherwise(F.xxhash64("key", F.lit(seed + 1))), F.get(F.array(parts[F.col("rng")]), F.lit(0))), F.lit(0)).cast("int")
    placed = checkpoint(ranged.withColumn("sub", sub))

    cells = placed.groupBy("rng", "sub").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
    before = Window.orderBy("rng", "sub").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        F.col("rng").alias("cell_rng"), F.col("sub").alias("cell_sub"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
    )
    in_cell = Window.partitionBy("rng", "sub").orderBy("key", "doc_id", "size")
    of_key = Window.partitionBy("rng", "sub", "key")
    bound = max(largest, int(group_share * total / shards))
    whole = F.sum("size").over(of_key)
    positioned = (
        placed.join(F.broadcast(cells), (F.col("rng") == F.col("cell_rng")) & (F.col("sub") == F.col("cell_sub")))
        .withColumn("start", F.col("w0") + F.sum("size").over(in_cell.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("place", F.col("n0") + F.row_number().over(in_cell) - 1)
        .withColumn("twice", F.when(whole <= bound, 2 * F.min("start").over(of_key) + whole).otherwise(2 * F.col("start") + F.col("size")))
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, twice * {shards} div {2 * total}) as int)"))
        .select("doc_id", "size", "text_crc32", "shard", "place")
    )
    positioned = checkpoint(positioned)
    first = positioned.groupBy(F.col("shard").alias("of")).agg(F.min("place").alias("first"))
    return positioned.join(F.broadcast(first), F.col("shard") == F.col("of")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
