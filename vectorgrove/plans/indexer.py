"""Building a content-addressed, size-bounded hierarchy over vectors, layer by layer.

A layer's items are split into partitions until none has more than fit in a
block; all partitions that still need it are split in one job.  Each final
partition becomes a branch, or passes its only item on, and these are the next
layer's items, until one is left: the root.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vectorgrove.functions import codecs
from vectorgrove.operators import clustering, pca
from vectorgrove.operators.aggregates import balanced_group, rank_in_order
from vectorgrove.operators.neighbors import distances
from vectorgrove.plans import checks
from vectorgrove.plans.profiles import Profile, effective_clusters, profile
from vectorgrove.session import checkpoint
from vectorgrove.sources import blocks

#: Partitions of more items than this are fitted by distributed jobs, one after the other; there are few of these.
LOCAL_ITEMS = 20_000
NODES = "idx long, child binary, level int, n long, embedding array<float>"


@dataclass
class Index:
    root: bytes
    blocks: DataFrame
    #: parent, level, pos, child, child_level, embedding
    edges: DataFrame
    #: Children of a block, at most.
    bound: int = 0
    #: Blocks as often as they were made.
    made: DataFrame | None = None

    def sizes(self) -> DataFrame:
        """block_id and size of all blocks; their bytes aren't moved."""
        return (self.blocks if self.made is None else self.made).select("block_id", F.length("bytes").alias("size")).dropDuplicates(["block_id"])


def leaves(items: DataFrame) -> DataFrame:
    """idx, child, level, n, embedding and bytes of a leaf block for each (idx, embedding, metadata, media_type, body)."""

    def run(frames):
        for x in frames:
            data = [
                blocks.leaf_bytes(len(e), codecs.encode(np.array(e), "f32le"), dict(m or {}), t, bytes(b or b""))
                for e, m, t, b in zip(x["embedding"], x["metadata"], x["media_type"], x["body"], strict=True)
            ]
            yield pd.DataFrame({"idx": x["idx"], "child": [blocks.block_id(d) for d in data], "level": 0, "n": 1, "embedding": x["embedding"], "bytes": data})

    return items.select("idx", "embedding", "metadata", "media_type", "body").mapInPandas(run, NODES + ", bytes binary")


def _split_small(x: np.ndarray, k: int, p: Profile) -> np.ndarray:
    """Clusters of one partition's vectors by directional PCA; all in one where that isn't possible."""
    model = pca.from_moments(pca.Moments.of(x))
    if model.rank < max(1, p.min_rank) or model.cumulative_variance() < p.min_cumulative:
        if p.rank_zero_fallback:
            return np.zeros(len(x), np.int64)
        raise ValueError(f"effective rank {model.rank}")
    retained = min(p.axes or model.rank, len(model.variance))
    retained = min(retained, k) if p.allocation == "centroid" else retained
    model = model.truncate(retained)
    bins = clustering.log_bits(model.variance, k) if p.allocation == "log-bits" else clustering.centroid_weighted_bins(model, k)
    y, n = model.apply(x), len(x)
    keys = np.zeros((n, retained), np.int64)
    for a in range(retained):
        if bins[a] < 2:
            continue
        if p.binning == "quantile":
            ordered = np.sort(y[:, a])
            cuts = [ordered[-(-b * n // bins[a]) - 1] for b in range(1, bins[a])]
        else:
            width, lo, hi = min(max(bins[a], 2), 256), y[:, a].min(), y[:, a].max()
            at = np.floor((y[:, a] - lo) / (hi - lo) * (width - 1) + 0.5).astype(int) if hi > lo else np.zeros(n, int)
            cuts = clustering.valley_cuts(np.bincount(at, minlength=width), lo, hi, bins[a])
        keys[:, a] = (y[:, a][:, None] > np.array(cuts)[None, :]).sum(1)
    cells, cell = np.unique(keys, axis=0, return_inverse=True)
    if len(cells) > k or p.exact and len(cells) < k:
        raise ValueError(f"{len(cells)} cells for {k} clusters")
    centers = np.array([x[cell == c].mean(0) for c in range(len(cells))])
    return distances(x, centers, "squared").argmin(1)


def _groups(n: int, bound: int, cap: int | None) -> int:
    groups = -(-n // bound)
    return max(2, min(groups, cap) if cap else groups)


def _ranges(n: int, bound: int, cap: int | None) -> np.ndarray:
    groups = _groups(n, bound, cap)
    return np.repeat(np.arange(groups), [n // groups + (i < n % groups) for i in range(groups)])


def _split(rows: DataFrame, bound: int, p: Profile) -> DataFrame:
    """idx and the next partition of items (idx, part, embedding) whose partitions are too large."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx", ignore_index=True)
        x = np.array(g["embedding"].tolist(), np.float64)
        k = effective_clusters(p.clusters, bound, len(x), p.allocation == "log-bits")
        cluster = _split_small(x, k, p)
        if len(np.unique(cluster)) < 2:  # in order of items, then
            cluster = _ranges(len(x), bound, p.clusters if p.capped else None)
        else:  # those alone join the largest
            found, at, size = np.unique(cluster, return_inverse=True, return_counts=True)
            if size.max() > 1:
                cluster = np.where(size[at] == 1, found[size.argmax()], cluster)
                if len(np.unique(cluster)) < 2:
                    cluster = _ranges(len(x), bound, p.clusters if p.capped else None)
        return pd.DataFrame({"idx": g["idx"], "next": g["part"] + "." + pd.Series(cluster).astype(str)})

    return rows.groupBy("part").applyInPandas(run, "idx long, next string")


def _split_large(rows: DataFrame, part: str, n: int, bound: int, p: Profile) -> DataFrame:
    """As _split does it, by distributed jobs."""
    k = effective_clusters(p.clusters, bound, n, p.allocation == "log-bits")
    try:
        model = clustering.directional_pca(rows, k, p.axes, p.allocation, p.binning, p.exact, "idx", "embedding", min_rank=p.min_rank, min_cumulative=p.min_cumulative)
        placed = checkpoint(model.assign(rows, "idx", "embedding").select("idx", "cluster_id"))
        split = placed.select("cluster_id").distinct().limit(2).count() == 2
    except clustering.RankError:
        if not p.rank_zero_fallback:
            raise
        split = False
    if not split:  # in order of items, then
        groups = _groups(n, bound, p.clusters if p.capped else None)
        placed = rank_in_order(rows.select("idx"), ["idx"]).select("idx", balanced_group(F.col("place"), n, groups).alias("cluster_id"))
    return placed.select("idx", F.concat(F.lit(part + "."), F.col("cluster_id").cast("string")).alias("next"))


def _assemble(items: DataFrame, encoding: str, is_root: bool) -> DataFrame:
    """A branch for each partition of items (part, child, level, n, embedding); a single item passes through, without bytes."""

    def branch(rows: list[tuple]) -> tuple:
        first = min(r[0] for r in rows)
        distinct: dict[bytes, tuple] = {}
        for r in sorted(((bytes(c), codecs.encode(e, "f32le"), lv, n, e) for _, c, lv, n, e in rows), key=lambda r: r[:2]):
            distinct.setdefault(r[0], r)
        g = sorted(distinct.values(), key=lambda r: (r[1], r[0]))
        if len(g) == 1:
            child, _, level, n, e = g[0]
            return first, child, level, n, e, None, None
        x, n = np.array([r[4] for r in g], np.float32), np.array([r[3] for r in g], np.float64)
        level = max(r[2] for r in g) + 1
        payloads, descriptor = codecs.encode_block(x, encoding, codecs.bits_for(level, is_root))
        data = blocks.branch_bytes(level, x.shape[1], "f32le" if encoding == "ordinary" else encoding, [(p, r[0]) for p, r in zip(payloads, g, strict=True)], descriptor)
        center = ((x.astype(np.float64) * n[:, None]).sum(0) / n.sum()).astype(np.float32)
        stored = codecs.decode_block(payloads, x.shape[1], descriptor)
        members = [{"child": r[0], "child_level": int(r[2]), "embedding": v} for r, v in zip(g, stored, strict=True)]
        return first, blocks.block_id(data), level, int(n.sum()), center, data, members

    names = ["idx", "child", "level", "n", "embedding", "bytes", "members"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = None, []  # rows of a partition follow each other, over batches too
        for f in frames:
            made = []
            for of, *row in zip(f["part"], f["idx"], f["child"], f["level"], f["n"], f["embedding"], strict=True):
                if of != part and held:
                    made.append(branch(held))
                    held = []
                part = of
                held.append(tuple(row))
            yield pd.DataFrame(made, columns=names)
        if held:
            yield pd.DataFrame([branch(held)], columns=names)

    spec = NODES + ", bytes binary, members array<struct<child:binary,child_level:int,embedding:array<float>>>"
    return items.select("part", "idx", "child", "level", "n", "embedding").repartition("part").sortWithinPartitions("part").mapInPandas(run, spec)


def _clustered(layer: DataFrame, bound: int, p: Profile) -> DataFrame:
    """idx, part: contiguous ranges of items by cluster, clusters by their first item; those of one item go to the largest."""
    n = layer.count()
    model = clustering.spherical_kmeans(layer, max(1, min(p.clusters, n // 2)), id_col="idx")
    placed = checkpoint(model.assign(layer, "idx", "embedding").select("idx", "cluster_id"))
    # a row for each cluster
    sizes = placed.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("idx").alias("first")).collect()
    main = max(sizes, key=lambda r: (r.n, -r.first))
    first = {r.cluster_id: r.first if r.n > 1 else main.first for r in sizes}
    order = F.element_at(F.create_map(*(F.lit(x) for kv in first.items() for x in kv)), F.col("cluster_id"))
    ranked = rank_in_order(placed.select("idx", order.alias("of")), ["of", "idx"])
    return ranked.select("idx", F.concat(F.lit("p0."), balanced_group(F.col("place"), n, -(-n // bound)).cast("string")).alias("part"))


def _packed(x: np.ndarray, bound: int) -> np.ndarray:
    """Groups of balanced sizes: the first item left, and those nearest to it, ties to the earlier one."""
    n = len(x)
    groups = -(-n // bound)
    out, left = np.full(n, -1), np.arange(n)
    for g in range(groups):
        size = n // groups + (g < n % groups)
        near = np.argsort(distances(x[left[1:]], x[left[:1]], "squared")[:, 0], kind="stable")[: size - 1] + 1 if size > 1 else np.zeros(0, int)
        out[left[np.append(0, near)]] = g
        left = np.delete(left, np.append(0, near))
    return out


def _by_clusters(layer: DataFrame, bound: int, p: Profile, is_leaves: bool) -> DataFrame:
    """The layer with its parts: leaves by clusters; nodes above by greedy packing, or by clusters where they are many."""
    if is_leaves or layer.count() > LOCAL_ITEMS:
        parts = _clustered(layer, bound, p)
    else:

        def run(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("idx", ignore_index=True)
            return pd.DataFrame({"idx": g["idx"], "part": "p0." + pd.Series(_packed(np.array(g["embedding"].tolist(), np.float64), bound)).astype(str)})

        parts = layer.withColumn("part", F.lit("p0")).groupBy("part").applyInPandas(run, "idx long, part string")
    return layer.join(parts.withColumnRenamed("idx", "i"), F.col("idx") == F.col("i")).drop("i")


def build(leaf_nodes: DataFrame, version: str = "0.8.0", block_size: int = 16_384, strict: bool = False) -> Index:
    """Index of leaf nodes (leaves()); equal items give equal blocks, whatever the partitions of the input.

    Clusters beyond what fits into a block are left out, or refused if ``strict``.
    """
    p = profile(version)
    nodes = checkpoint(leaf_nodes)
    first = nodes.select("embedding").first()
    if first is None:
        raise ValueError("no items")
    if strict:
        checks.check_profile(version, len(first[0]), "f32le", block_size)
    bound = blocks.capacity(len(first[0]), block_size)
    bound = min(bound, p.clusters) if p.capped else bound
    all_blocks, edges = nodes.select(F.col("child").alias("block_id"), "bytes"), None
    layer = nodes.select("idx", "child", "level", "n", "embedding")
    while layer.limit(2).count() > 1:
        by_clusters = p.algorithm == "spherical-kmeans"
        parts = checkpoint(_by_clusters(layer, bound, p, edges is None) if by_clusters else layer.withColumn("part", F.lit("p0")))
        while not by_clusters:
            counts = parts.groupBy(F.col("part").alias("of")).agg(F.count("*").alias("members")).where(F.col("members") > bound)
            large = {r.of: r.members for r in counts.where(F.col("members") > LOCAL_ITEMS).collect()}
            if not large and counts.isEmpty():
                break
            wide = parts.join(counts, F.col("part") == F.col("of"), "left_semi").select("idx", "part", "embedding")
            moved = _split(wide.where(~F.col("part").isin(*large)) if large else wide, bound, p)
            for part, n in large.items():
                moved = moved.unionByName(_split_large(wide.where(F.col("part") == part), part, n, bound, p))
            moved = moved.select(F.col("idx").alias("i"), "next")
            parts = checkpoint(parts.join(moved, F.col("idx") == F.col("i"), "left").withColumn("part", F.coalesce("next", "part")).drop("i", "next"))
        single = parts.select("part").distinct().limit(2).count() == 1
        made = checkpoint(_assemble(parts, p.encoding, single))
        all_blocks = all_blocks.unionByName(made.where("bytes IS NOT NULL").select(F.col("child").alias("block_id"), "bytes"))
        more = made.where("members IS NOT NULL").select(F.col("child").alias("parent"), "level", F.posexplode("members").alias("pos", "m")).select("parent", "level", "pos", "m.child", "m.child_level", "m.embedding")
        edges = more if edges is None else edges.unionByName(more)
        layer = made.select("idx", "child", "level", "n", "embedding")
    return Index(bytes(layer.first().child), all_blocks.dropDuplicates(["block_id"]), edges, bound, all_blocks)


def level_stats(index: Index) -> DataFrame:
    """level, blocks and their least, largest and mean number of children."""
    sizes = index.edges.groupBy("parent", "level").agg(F.count("*").alias("children"))
    return sizes.groupBy("level").agg(F.count("*").alias("blocks"), F.min("children").alias("least"), F.max("children").alias("largest"), F.avg("children").alias("mean"))
