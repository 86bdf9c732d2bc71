"""Grouping strategies over leaf nodes, refinement ratios, node summaries, and packers of bounded tables.

Strategies work on a table of nodes (clusters, not rows) of checked size, in
memory that grows with it as they do; what depends on rows is aggregated before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from vectorgrove.operators.neighbors import collected, distances, matrix
from vectorgrove.session import checkpoint

POWER_STEPS = 12
#: Leaves that a hierarchy is built over at most; growing groups and walks look at all nodes left for each node.
MAX_LEAVES = 131_072
#: Bytes of rows and moments of clusters that a task sums up at a time.
HELD_BYTES = 1 << 26


def dispersion(x: np.ndarray, metric: str = "euclidean") -> float:
    """Mean squared distance to the mean, or mean cosine distance to it."""
    mean = x.mean(0)
    return float(((x - mean) ** 2).sum(1).mean()) if metric == "euclidean" else float(distances(x, mean[None], "cosine").mean())


def group_sizes(n: int, low: int, high: int) -> list[int]:
    """Sizes between low and high, at most one apart and as few as can be; an error where there are none."""
    groups = -(-n // high)
    if n // groups < min(low, n):
        raise ValueError("no grouping within the bounds")
    return [n // groups + (i < n % groups) for i in range(groups)]


def _cut(order: list[int], sizes: list[int]) -> list[list[int]]:
    at = np.concatenate([[0], np.cumsum(sizes)])
    return [order[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


class _Left:
    """Nodes that aren't taken yet, in order; sums over components go row by row, so that equal nodes have equal costs."""

    def __init__(self, x: np.ndarray, metric: str):
        self.cosine = metric == "cosine"
        self.at, self.x, self.norm = np.arange(len(x)), x, np.sqrt(np.einsum("ij,ij->i", x, x))
        if self.cosine and not self.norm.all():
            raise ValueError("zero norm")
        self.open, self.count = np.ones(len(x), bool), len(x)

    def take(self, spot: int) -> tuple[int, np.ndarray]:
        """Place among all nodes, and vector, of the node at a spot among those still held."""
        at, v = int(self.at[spot]), self.x[spot]
        self.open[spot], self.count = False, self.count - 1
        if self.count < len(self.at) // 2:
            self.at, self.x, self.norm = self.at[self.open], self.x[self.open], self.norm[self.open]
            self.open = np.ones(self.count, bool)
        return at, v

    def first(self) -> tuple[int, np.ndarray]:
        return self.take(int(self.open.argmax()))

    def nearest(self, v: np.ndarray) -> tuple[int, np.ndarray]:
        dot = np.einsum("ij,j->i", self.x, v)
        d = 1 - dot / self.norm / np.sqrt(v @ v) if self.cosine else np.maximum(self.norm**2 + v @ v - 2 * dot, 0)
        return self.take(int(np.where(self.open, d, np.inf).argmin()))

    def tightest(self, group: np.ndarray) -> tuple[int, np.ndarray]:
        """The node with which the group's dispersion is least."""
        total, n = group.sum(0), len(group) + 1
        dot = np.einsum("ij,j->i", self.x, total)
        length = total @ total + 2 * dot + self.norm**2
        if self.cosine:
            unit = (group / np.linalg.norm(group, axis=1, keepdims=True)).sum(0)
            along = unit @ total + np.einsum("ij,j->i", self.x, unit) + dot / self.norm + self.norm
            if not length.all():
                raise ValueError("zero norm")
            d = 1 - along / np.sqrt(np.maximum(length, np.finfo(float).tiny)) / n
        else:
            d = self.norm**2 - length / n
        return self.take(int(np.where(self.open, d, np.inf).argmin()))


def metric_walk(x: np.ndarray, metric: str) -> list[int]:
    """From the first node always on to the nearest one not visited."""
    left = _Left(x, metric)
    at, v = left.first()
    order = [at]
    while left.count:
        at, v = left.nearest(v)
        order.append(at)
    return order


def two_anchors(x: np.ndarray, metric: str) -> list[int]:
    """By the difference of distances to two far nodes: the one farthest from the first, and the one farthest from that."""
    a = int(distances(x, x[:1], metric)[:, 0].argmax())
    b = int(distances(x, x[a : a + 1], metric)[:, 0].argmax())
    d = distances(x, x[[a, b]], metric)
    return np.lexsort((np.arange(len(x)), d[:, 0] - d[:, 1])).tolist()


def _grown(x: np.ndarray, sizes: list[int], metric: str, by_first: bool) -> list[list[int]]:
    """Groups from the first node left on, that take in the one nearest to their first node, or the one that disperses them least."""
    left, groups = _Left(x, metric), []
    for size in sizes:
        found = [left.first()]
        while len(found) < size:
            found.append(left.nearest(found[0][1]) if by_first else left.tightest(np.array([v for _, v in found])))
        groups.append(sorted(at for at, _ in found))
    return groups


def pca_order(x: np.ndarray, weight: np.ndarray) -> list[int]:
    mean = np.average(x, axis=0, weights=weight)
    z = (x - mean) * np.sqrt(weight)[:, None]
    axis = np.zeros(x.shape[1])
    axis[int(z.var(0).argmax())] = 1.0
    for _ in range(8):
        axis = z.T @ (z @ axis)
        size = np.linalg.norm(axis)
        if not size:
            break
        axis /= size
    return np.lexsort((np.arange(len(x)), (x - mean) @ axis)).tolist()


def group(x: np.ndarray, weight: np.ndarray, strategy: str, low: int, high: int, metric: str = "euclidean", level: int = 0) -> list[list[int]]:
    """Groups of node places by one of the seven strategies."""
    sizes = group_sizes(len(x), low, high)
    if strategy == "hybrid":
        strategy = ("bottom-up", "recursive-top-down")[level % 2]
    if strategy == "bottom-up":
        return _cut(metric_walk(x, metric), sizes)
    if strategy == "recursive-top-down":
        return _cut(two_anchors(x, metric), sizes)
    if strategy == "pca-variance-top-down":
        return _cut(pca_order(x, weight), sizes)
    if strategy == "greedy-pack":
        return _grown(x, sizes, metric, True)
    if strategy in ("ward", "beta-aware"):  # the group's spread, or its dispersion over that of all: for groups of one size the same node is best
        return _grown(x, sizes, metric, False)
    raise ValueError(f"unknown strategy {strategy}")


STRATEGIES = ("bottom-up", "recursive-top-down", "greedy-pack", "hybrid", "ward", "beta-aware", "pca-variance-top-down")
NODES = "node string, parent string, level int, members long, dispersion double"


def build(leaves: DataFrame, strategy: str, low: int, high: int, metric: str = "euclidean", id_col: str = "cluster_id", vector_col: str = "centroid", count_col: str = "members", dispersion_col: str = "dispersion") -> DataFrame:
    """Nodes of a hierarchy over leaf clusters: leaf-<id> and internal-<n> in the order they are made."""
    return build_each(leaves, (strategy,), low, high, metric, id_col, vector_col, count_col, dispersion_col).drop("strategy")


def build_each(leaves: DataFrame, strategies: tuple[str, ...], low: int, high: int, metric: str = "euclidean", id_col: str = "cluster_id", vector_col: str = "centroid", count_col: str = "members", dispersion_col: str = "dispersion") -> DataFrame:
    """strategy and nodes of hierarchies over the same leaves; each strategy is a task of its own."""
    ids, x = collected(leaves, id_col, vector_col, MAX_LEAVES)
    facts = leaves.select(id_col, count_col, dispersion_col).toPandas().sort_values(id_col, ignore_index=True)
    spark = leaves.sparkSession
    shared = spark.sparkContext.broadcast((ids, x, facts[count_col].to_numpy(np.float64), facts[dispersion_col].to_numpy(np.float64)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in f["id"]:
                rows = _tree(*shared.value, strategies[i], low, high, metric)
                yield pd.DataFrame(rows, columns=["node", "parent", "level", "members", "dispersion"]).assign(strategy=strategies[i])

    return checkpoint(spark.range(len(strategies), numPartitions=len(strategies)).mapInPandas(run, NODES + ", strategy string"))


def _tree(ids: np.ndarray, x: np.ndarray, n: np.ndarray, spread: np.ndarray, strategy: str, low: int, high: int, metric: str) -> list[list]:
    names = [f"leaf-{i}" for i in ids]
    rows = {k: [k, None, 0, int(c), float(s)] for k, c, s in zip(names, n, spread, strict=True)}
    level, made = 0, 0
    while len(names) > 1:
        level += 1
        parts = [list(range(len(names)))] if len(names) <= high else group(x, n, strategy, low, high, metric, level)
        new_x, new_n, new_s, new_names = [], [], [], []
        for part in parts:
            name, made = f"internal-{made}", made + 1
            w = n[part]
            mean = np.average(x[part], axis=0, weights=w)
            apart = ((x[part] - mean) ** 2).sum(1) if metric == "euclidean" else distances(x[part], mean[None], "cosine")[:, 0]
            for i in part:
                rows[names[i]][1] = name
            rows[name] = [name, None, level, int(w.sum()), float(np.average(spread[part] + apart, weights=w))]
            new_x.append(mean)
            new_n.append(w.sum())
            new_s.append(rows[name][4])
            new_names.append(name)
        x, n, spread, names = np.array(new_x), np.array(new_n), np.array(new_s), new_names
    return list(rows.values())


def refinement(nodes: DataFrame, *by: str) -> DataFrame:
    """by..., node, parent, beta: dispersion over the parent's, within each ``by``; 0 over 0 is 0, anything else over 0 is infinite."""
    p = nodes.select(F.col("node").alias("p"), F.col("dispersion").alias("above"), *(F.col(c).alias(f"p_{c}") for c in by))
    ratio = F.when(F.col("above") > 0, F.col("dispersion") / F.col("above")).when(F.col("dispersion") == 0, 0.0).otherwise(float("inf"))
    same = F.col("parent") == F.col("p")
    for c in by:
        same = same & (F.col(c) == F.col(f"p_{c}"))
    return nodes.join(p, same).select(*by, "node", "parent", "level", ratio.alias("beta"))


def depth_bound(leaves: int, fanout: int) -> int:
    return 0 if leaves <= 1 else math.ceil(math.log(leaves) / math.log(max(2, fanout)) - 1e-12)


def principal_direction(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    axis = np.ones(len(mean)) / math.sqrt(len(mean))
    for _ in range(POWER_STEPS):
        axis = (x - mean).T @ ((x - mean) @ axis)
        size = np.linalg.norm(axis)
        if not size:
            return np.zeros(len(mean))
        axis /= size
    return axis


SUMMARY = "cluster_id long, members long, centroid array<double>, variance double, direction array<double>"


def exact_summaries(df: DataFrame, cluster_col: str, vector_col: str = "embedding") -> DataFrame:
    """Members, mean, mean squared distance to it and first principal direction of each cluster.

    The first three are aggregates with partial sums; the direction comes from
    the cluster's second moments, which are summed up for each partition first.
    Few rows of a cluster in a partition are smaller than these, and sent as they are.
    """

    def packed(held: dict[int, list]) -> pd.DataFrame:
        parts = {c: (n, np.concatenate(rows), s, m) for c, (n, rows, s, m) in held.items()}
        return pd.DataFrame([(c, n, x.tobytes(), None if m is None else s.tobytes(), None if m is None else m.tobytes()) for c, (n, x, s, m) in parts.items()], columns=["c", "n", "x", "s", "m"])

    def partial(frames):
        held: dict[int, list] = {}
        size = 0
        for f in frames:
            for c, g in f.groupby("c"):
                x = matrix(g["v"])
                row = held.setdefault(int(c), [0, [], 0.0, None])
                row[0] += len(x)
                row[1].append(x)
                size += x.nbytes
                if sum(map(len, row[1])) > x.shape[1]:
                    x = np.concatenate(row[1])
                    size += x.shape[1] ** 2 * 8 * (row[3] is None) - x.nbytes
                    row[1:] = [[x[:0]], row[2] + x.sum(0), x.T @ x + (0.0 if row[3] is None else row[3])]
                if size > HELD_BYTES:
                    yield packed(held)
                    held, size = {}, 0
        if held:
            yield packed(held)

    def final(g: pd.DataFrame) -> pd.DataFrame:
        n = int(g["n"].sum())
        sums = [np.frombuffer(s) for s in g["s"] if s is not None]
        moments = [np.frombuffer(m).reshape(len(sums[0]), -1) for m in g["m"] if m is not None]
        few = np.frombuffer(b"".join(g["x"]))
        if len(few):
            few = few.reshape(n if not sums else -1, len(sums[0]) if sums else -1)
            sums, moments = [*sums, few.sum(0)], [*moments, few.T @ few]
        mean = sum(sums) / n
        second = sum(moments) - n * np.outer(mean, mean)
        axis = np.ones(len(mean)) / math.sqrt(len(mean))
        for _ in range(POWER_STEPS):
            axis = second @ axis
            size = np.linalg.norm(axis)
            if not size:
                break
            axis /= size
        return pd.DataFrame({"cluster_id": [int(g["c"].iloc[0])], "members": [n], "centroid": [mean.tolist()], "variance": [float(np.trace(second)) / n], "direction": [axis.tolist()]})

    parts = df.select(F.col(cluster_col).cast("long").alias("c"), F.col(vector_col).alias("v")).mapInPandas(partial, "c long, n long, x binary, s binary, m binary")
    return parts.groupBy("c").applyInPandas(final, SUMMARY)


def composed(members: np.ndarray, centroids: np.ndarray, variances: np.ndarray) -> tuple[np.ndarray, float]:
    """Centroid and variance of a parent from its children, with the term between children."""
    mean = np.average(centroids, axis=0, weights=members)
    return mean, float(np.average(variances + ((centroids - mean) ** 2).sum(1), weights=members))


def relative_error(a: np.ndarray, b: np.ndarray) -> float:
    size = float(np.linalg.norm(b))
    gap = float(np.linalg.norm(a - b))
    return gap / size if size else (0.0 if not gap else math.inf)


def segmented(clusters: list[int], size: int) -> list[int]:
    """Lengths of contiguous leaves of size/2 to size members with fewest cuts inside clusters, then nearest to size.

    ``clusters`` is the cluster of each member in order; one dynamic program
    over a table of bounded size.
    """
    n, low = len(clusters), max(1, size // 2)
    best: list[tuple[float, float, int] | None] = [(0, 0, 0)] + [None] * n
    for end in range(1, n + 1):
        for length in range(low, min(size, end) + 1):
            before = best[end - length]
            if before is not None:
                cut = int(end < n and clusters[end - 1] == clusters[end])
                key = (before[0] + cut, before[1] + size - length, length)
                if best[end] is None or key[:2] < best[end][:2]:
                    best[end] = key
    if best[n] is None:
        raise ValueError("no segmentation within the bounds")
    out, at = [], n
    while at:
        out.append(best[at][2])
        at -= best[at][2]
    return out[::-1]


def neighborhood_groups(df: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> pd.DataFrame:
    """id, cluster_id: equal groups, each from the smallest id left, growing by the one of least mean squared distance.

    Quadratic; for a table of checked size.
    """
    ids, x = collected(df, id_col, vector_col, 4096)
    if len(ids) % k:
        raise ValueError("k must divide the number of vectors")
    d = distances(x, x, "squared")
    out, left = np.full(len(ids), -1), np.ones(len(ids), bool)
    for c in range(k):
        at = int(np.flatnonzero(left)[0])
        total = np.zeros(len(ids))
        for _ in range(len(ids) // k):
            out[at], left[at] = c, False
            total += d[at]
            at = int(np.where(left, total, np.inf).argmin())
    return pd.DataFrame({id_col: ids, "cluster_id": out})


def best_edges(nodes: DataFrame) -> DataFrame:
    """Of each level the node of least dispersion, ties to the smaller name: for reports."""
    w = Window.partitionBy("level").orderBy("dispersion", "node")
    return nodes.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
