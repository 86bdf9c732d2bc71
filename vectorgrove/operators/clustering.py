"""Spherical k-means, capacity-constrained balanced clustering, directional PCA, splitters, and the adaptive policy.

Every fit needs an id column that orders the vectors: ties go to smaller ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vectorgrove.operators import pca, transport
from vectorgrove.operators.aggregates import balanced_group, bin_of, histogram, rank_in_order
from vectorgrove.operators.neighbors import assign_nearest, distances, matrix
from vectorgrove.session import checkpoint

EPSILON = 1e-12


class RankError(ValueError):
    """The vectors have fewer directions, or less variance on them, than asked for."""


@dataclass
class Centroids:
    """A fitted clustering that assigns by nearest centroid."""

    centers: np.ndarray
    metric: str
    quality: float
    epsilon: float = 0.0

    def assign(self, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        return assign_nearest(df, self.centers, self.metric, id_col, vector_col, self.epsilon)


def farthest_points(df: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding", first_id: int | None = None) -> tuple[list[int], np.ndarray]:
    """Ids and vectors: the first (smallest id unless given), then always the one farthest from all chosen, ties to the smaller id.

    Each step is one job whose tasks return their farthest row.
    """
    start = df.where(F.col(id_col) == first_id) if first_id is not None else df
    row = start.select(id_col, vector_col).orderBy(id_col).first()
    if row is None:
        raise ValueError("no vectors")
    ids, chosen = [row[0]], [np.array(row[1], np.float64)]
    while len(ids) < k:
        centers = np.array(chosen)

        def run(frames: Iterator[pd.DataFrame], c: np.ndarray = centers) -> Iterator[pd.DataFrame]:
            for x in frames:
                if len(x):
                    d = distances(matrix(x[vector_col]), c, metric).min(1)
                    at = np.lexsort((x[id_col].to_numpy(), -d))[:1]
                    yield pd.DataFrame({"i": x[id_col].to_numpy()[at], "d": d[at], "v": [list(map(float, x[vector_col].iloc[at[0]]))]})

        far = df.select(id_col, vector_col).mapInPandas(run, "i long, d double, v array<double>").orderBy(F.desc("d"), "i").first()
        ids.append(far.i)
        chosen.append(np.array(far.v))
    return ids, np.array(chosen)


def spherical_kmeans(df: DataFrame, k: int, max_iter: int = 32, tolerance: float = 1e-4, id_col: str = "vec_id", vector_col: str = "embedding") -> Centroids:
    """Cosine k-means from farthest points; an empty cluster takes the farthest member of the largest one.

    An iteration is one job: tasks assign their rows to the centers sent along
    and return sums, counts and farthest members of each cluster.
    """
    if k < 1:
        raise ValueError("k must be positive")
    _, centers = farthest_points(df, k, "cosine", id_col, vector_col)
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    quality = 0.0
    for _ in range(max_iter):

        def run(frames: Iterator[pd.DataFrame], c: np.ndarray = centers) -> Iterator[pd.DataFrame]:
            for x in frames:
                if not len(x):
                    continue
                v = matrix(x[vector_col])
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
                d = np.maximum(1 - v @ c.T, 0)
                best = d.argmin(1)
                for j in np.unique(best):
                    here = np.flatnonzero(best == j)
                    far = here[np.lexsort((x[id_col].to_numpy()[here], -d[here, j]))[0]]
                    yield pd.DataFrame({"c": [j], "n": [len(here)], "s": [v[here].sum(0).tolist()], "d": [d[here, j].sum()], "far": [d[far, j]], "fid": [x[id_col].iloc[far]], "fv": [v[far].tolist()]})

        parts = df.select(id_col, vector_col).mapInPandas(run, "c long, n long, s array<double>, d double, far double, fid long, fv array<double>")
        # a row for each cluster comes to the driver
        summed = parts.groupBy("c", F.lit(0).alias("z")).agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.max_by("fv", F.struct("far", -F.col("fid"))).alias("fv"), *(F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(centers.shape[1]))).collect()
        new, n = centers.copy(), np.zeros(k, np.int64)
        farthest = {}
        for r in summed:
            total = np.array([r[f"s{i}"] for i in range(centers.shape[1])])
            n[r.c], farthest[r.c] = r.n, np.array(r.fv)
            size = np.linalg.norm(total)
            new[r.c] = total / size if size > EPSILON else new[r.c]
        for j in np.flatnonzero(n == 0):
            donor = int(np.argmax(n))
            if n[donor] > 1 and donor in farthest:
                new[j] = farthest.pop(donor)
                n[donor] -= 1
        quality = sum(r.d for r in summed) / max(1, n.sum())
        shift = float(np.maximum(1 - (new * centers).sum(1), 0).max())
        centers = new
        if shift <= tolerance:
            break
    return Centroids(centers, "cosine", quality, 1e-6)


def balanced_assignment(cost: np.ndarray, low: int, high: int) -> np.ndarray:
    """Clusters of least total cost with ``low`` to ``high`` members each, for a table in memory; costs are rounded to 2 ** -44 of their range."""
    n, k = cost.shape
    if k * low > n or k * high < n:
        raise ValueError("bounds can't be met")
    span = float(np.ptp(cost)) if n else 0.0
    units = np.rint((cost - cost.min()) / span * transport.SCALE).astype(np.int64) if span else np.zeros(cost.shape, np.int64)
    return np.array(transport.solved(units, low, high).held).reshape(n, k).argmax(1)


def balanced(df: DataFrame, k: int, low: int = 1, high: int | None = None, passes: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[Centroids, DataFrame]:
    """Capacity-constrained clustering by cosine distance: least-cost assignment within bounds, then means, ``passes`` times.

    Members are a table (id, cluster_id), not held by the driver; for what is,
    see ``transport``.  Assigning other rows is by nearest centroid.
    """
    rows = checkpoint(df.select(id_col, vector_col))
    n = rows.count()
    high = n - (k - 1) * low if high is None else high
    if not n or not k or k * low > n or k * high < n:
        raise ValueError("bounds can't be met")
    _, centers = farthest_points(rows, k, "cosine", id_col, vector_col)
    for _ in range(passes):
        found = transport.least_cost(rows, centers, low, high, id_col, vector_col)
        placed = checkpoint(found.assign(rows, centers, id_col, vector_col))
        centers = _means(placed, centers, id_col, vector_col)
    shared = df.sparkSession.sparkContext.broadcast(centers)

    def cost(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            if len(x):
                d = distances(matrix(x[vector_col]), shared.value, "cosine")
                yield pd.DataFrame({"d": [d[np.arange(len(x)), x["cluster_id"]].sum()]})

    objective = placed.mapInPandas(cost, "d double").agg(F.sum("d")).first()[0]
    return Centroids(centers, "cosine", objective, EPSILON), placed.select(id_col, "cluster_id")


def _means(placed: DataFrame, centers: np.ndarray, id_col: str, vector_col: str) -> np.ndarray:
    """Means of clusters; the member of least id where a mean is zero, the center before where there is none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for f in frames:
            x = matrix(f[vector_col]) if len(f) else np.zeros((0, 0))
            for c in f["cluster_id"].unique():
                here = np.flatnonzero(f["cluster_id"] == c)
                least = here[f[id_col].to_numpy()[here].argmin()]
                n, total, first, v = held.get(c, (0, 0.0, np.inf, None))
                i = f[id_col].iloc[least]
                held[c] = [n + len(here), total + x[here].sum(0), *((i, x[least]) if i < first else (first, v))]
        yield pd.DataFrame([(int(c), n, s.tolist(), int(i), v.tolist()) for c, (n, s, i, v) in sorted(held.items())], columns=["c", "n", "s", "i", "v"])

    # a row for each cluster and task
    parts = placed.mapInPandas(run, "c long, n long, s array<double>, i long, v array<double>").toPandas().sort_values(["c", "i"])
    out = centers.copy()
    for c, g in parts.groupby("c"):
        mean = matrix(g["s"]).sum(0) / g["n"].sum()
        out[c] = mean if np.linalg.norm(mean) > EPSILON else g["v"].iloc[0]
    return out


def balanced_clustering(df: DataFrame, k: int, low: int = 1, high: int | None = None, passes: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[Centroids, pd.DataFrame]:
    """As ``balanced``, with all members brought to the driver, in the order of ids."""
    model, members = balanced(df, k, low, high, passes, id_col, vector_col)
    return model, members.toPandas().sort_values(id_col, ignore_index=True)


def log_bits(variance: np.ndarray, k: int, gamma: float = 1.0) -> list[int]:
    """Bins for each axis, powers of two with product k: bits go to the axis with most weight for its bits."""
    if k & (k - 1) or k < 1:
        raise ValueError("k must be a power of two")
    weight, bits = np.log1p(variance**gamma), np.zeros(len(variance), int)
    for _ in range(k.bit_length() - 1):
        bits[int(np.argmax(np.where(bits > 0, weight / (bits + 1), weight)))] += 1
    return [1 << int(b) for b in bits]


def centroid_weighted_bins(model: pca.PcaModel, k: int, gamma: float = 1.0, temperature: float = 1.0) -> list[int]:
    """Bins for each axis that sum to k: one each, the others by largest remainder of softmax shares."""
    axes = model.basis.shape[1]
    score = np.log1p(np.abs(model.mean @ model.basis) * model.variance**gamma) / temperature
    share = np.exp(score - score.max())
    share = share / share.sum() * (k - axes)
    bins = 1 + np.floor(share).astype(int)
    rest = np.argsort(-(share - np.floor(share)), kind="stable")[: k - int(bins.sum())]
    bins[rest] += 1
    return bins.tolist()


def valley_cuts(counts: np.ndarray, low: float, high: float, bins: int) -> list[float]:
    """Cuts at left edges of the deepest valleys of a smoothed histogram, one segment cut at a time."""
    padded = np.concatenate([counts[:1], counts, counts[-1:]]).astype(float)
    smooth = (padded[:-2] + 2 * padded[1:-1] + padded[2:]) / 4
    cuts: list[int] = []
    while len(cuts) < bins - 1:
        edges = [0, *sorted(cuts), len(smooth)]
        best = None
        for a, b in zip(edges, edges[1:], strict=False):
            for i in range(a + 1, b):
                depth = min(smooth[a:i].max(), smooth[i:b].max()) - smooth[i]
                key = (-depth, smooth[i], i)
                best = min(best, key) if best else key
        if best is None:
            break
        cuts.append(best[2])
    return [low + (high - low) * i / len(smooth) for i in sorted(cuts)]


def _with_coordinates(df: DataFrame, vector_col: str, model: pca.PcaModel, axes: list[int]) -> DataFrame:
    """The rows with their coordinates y<axis>, of equal vectors equal ones."""
    if not axes:
        return df
    shared = df.sparkSession.sparkContext.broadcast((model.mean @ model.basis[:, axes], np.ascontiguousarray(model.basis[:, axes].T)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            middle, basis = shared.value
            y = np.einsum("ij,kj->ik", matrix(x[vector_col]), basis) - middle if len(x) else np.zeros((0, len(axes)))
            yield x.assign(**{f"y{a}": y[:, i] for i, a in enumerate(axes)})

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema]
    return df.mapInPandas(run, ", ".join([*kinds, *(f"y{a} double" for a in axes)]))


DIGIT = 16


def order_statistics(df: DataFrame, bins: dict[str, int]) -> dict[str, list[float]]:
    """Cuts of several columns of doubles as ``quantile_cuts`` has them, digit by digit: four jobs for all columns.

    A job counts the next 16 bits of the values that agree so far with one
    sought; for each of these the driver gets 65 536 counts at most.
    """
    names = [c for c in bins if bins[c] > 1]
    n = df.count()
    if not n or not names:
        return {c: [] for c in bins}
    ranks = {c: [math.ceil(b * n / bins[c]) - 1 for b in range(1, bins[c])] for c in names}
    prefix = {c: np.zeros(len(ranks[c]), np.uint64) for c in names}
    for shift in (48, 32, 16, 0):
        sought = {c: np.unique(prefix[c]) for c in names}

        def run(frames: Iterator[pd.DataFrame], shift: int = shift, sought: dict = sought) -> Iterator[pd.DataFrame]:
            held = None
            for x in frames:
                parts = []
                for i, c in enumerate(names):
                    key = _sortable(x[c].to_numpy(np.float64)) >> np.uint64(shift)
                    high = key >> np.uint64(DIGIT) if shift < 48 else np.zeros(len(key), np.uint64)
                    at = np.searchsorted(sought[c], high).clip(max=len(sought[c]) - 1)
                    code, count = np.unique((at * (1 << DIGIT) + (key & np.uint64((1 << DIGIT) - 1)).astype(np.int64))[sought[c][at] == high], return_counts=True)
                    parts.append(pd.DataFrame({"c": i, "code": code, "n": count}))
                every = pd.concat(parts if held is None else [held, *parts])
                held = every.groupby(["c", "code"], as_index=False)["n"].sum()
            if held is not None:
                yield held

        counts = df.select(*names).mapInPandas(run, "c int, code long, n long").groupBy("c", "code").agg(F.sum("n").alias("n")).toPandas()
        for i, c in enumerate(names):
            mine = counts[counts["c"] == i].sort_values("code")
            code, total = mine["code"].to_numpy(), np.cumsum(mine["n"].to_numpy())
            of = np.searchsorted(sought[c], prefix[c])
            # rows of the prefixes before, as the ranks left count from the start of their own
            before = np.append(0, total)[np.searchsorted(code, of << DIGIT)]
            at = np.searchsorted(total, before + ranks[c], side="right")
            ranks[c] = (before + ranks[c] - np.append(0, total)[at]).tolist()
            prefix[c] = (prefix[c] << np.uint64(DIGIT)) | (code[at] & ((1 << DIGIT) - 1)).astype(np.uint64)
    return {c: _unsortable(prefix[c]).tolist() if c in prefix else [] for c in bins}


def _sortable(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of doubles; both zeros are one."""
    u = (x + 0.0).view(np.uint64)
    return np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))


def _unsortable(u: np.ndarray) -> np.ndarray:
    return np.where(u >> np.uint64(63), u & np.uint64((1 << 63) - 1), ~u).view(np.float64)


def directional_pca(
    df: DataFrame, k: int, axes: int | None = None, allocation: str = "log-bits", binning: str = "quantile", exact: bool = False, id_col: str = "vec_id", vector_col: str = "embedding", gamma: float = 1.0, min_rank: int = 1, min_cumulative: float = 0.0
) -> Centroids:
    """Cells of a grid along principal directions; their centroids classify by squared distance.

    Jobs: moments, cuts for each axis, and counts with sums for each cell.
    More cells than k are an error, fewer one only if ``exact``.
    """
    model = pca.fit(df, vector_col)
    if model.rank < max(1, min_rank) or model.cumulative_variance() < min_cumulative:
        raise RankError(f"effective rank {model.rank}")
    retained = axes or max(1, min(max(model.rank, min_rank), len(model.variance)))
    retained = min(retained, k) if allocation == "centroid" else retained
    model = model.truncate(retained)
    bins = log_bits(model.variance, k, gamma) if allocation == "log-bits" else centroid_weighted_bins(model, k, gamma)
    used = [a for a in range(retained) if bins[a] > 1]
    rows = checkpoint(_with_coordinates(df.select(id_col, vector_col), vector_col, model, used))
    quantiles = order_statistics(rows, {f"y{a}": bins[a] for a in used}) if binning == "quantile" else {}
    keys = []
    for a in used:
        y = F.col(f"y{a}")
        if binning == "quantile":
            cuts = quantiles[f"y{a}"]
        else:
            width = min(max(bins[a], 2), 256)
            lo, hi = rows.agg(F.min(y), F.max(y)).first()
            found = {r.bucket: r.n for r in histogram(rows, y, width).collect()}
            cuts = valley_cuts(np.array([found.get(i, 0) for i in range(width)]), lo, hi, bins[a])
        keys.append(bin_of(y, cuts).alias(f"b{a}"))
    names = [f"b{a}" for a in used]
    celled = rows.select(vector_col, *keys)
    dims = len(model.mean)
    means = celled.groupBy(*names).agg(F.count("*").alias("n"), *(F.avg(F.get(vector_col, F.lit(i)).cast("double")).alias(f"m{i}") for i in range(dims)))
    # cells beyond k are an error, so k + 1 rows are enough to tell
    cells = means.orderBy(*names).limit(k + 1).collect() if names else means.collect()
    if len(cells) > k or exact and len(cells) < k:
        raise ValueError(f"{len(cells)} cells for {k} clusters")
    centers = np.array([[r[f"m{i}"] for i in range(dims)] for r in cells])
    return Centroids(centers, "squared", 1 - model.cumulative_variance())


def _chunk_size(df: DataFrame, k: int) -> int:
    """Vectors in each of k chunks; 1 where there are none at all."""
    n = df.count()
    if 0 < n < k:
        raise ValueError(f"{n} vectors for {k} chunks")
    return max(1, n // k)


def hybrid_coarse(df: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster_id: about sqrt(k) groups along the first component, each cut along the second, into chunks of n // k.

    Vectors beyond k chunks, fewer than k, belong to the last group and make
    further chunks, from k on.  Too few vectors for k chunks are an error.
    """
    size = _chunk_size(df, k)
    coarse = max(1, math.isqrt(k))
    x, y = F.get(vector_col, F.lit(0)), F.get(vector_col, F.lit(1))
    rows = df.select(id_col, x.alias("x"), y.alias("y"))
    x, y = (F.col(c).asc_nulls_last() for c in "xy")
    placed = rank_in_order(rows, [x, y, id_col])
    of_chunk = balanced_group(F.least(F.floor(F.col("place") / size), F.lit(k - 1)), k, coarse)
    placed = placed.withColumn("grp", of_chunk).drop("place")
    return rank_in_order(placed, ["grp", y, x, id_col]).select(id_col, F.floor(F.col("place") / size).cast("long").alias("cluster_id"))


def recursive_balanced(df: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster_id: k (a power of two) equal parts by halving along the component of largest variance of each part.

    A halving makes parts of n // parts; vectors beyond these, fewer than
    parts, make further ones.  Too few vectors for k parts are an error.
    """
    if k & (k - 1):
        raise ValueError("k must be a power of two")
    _chunk_size(df, k)
    rows = checkpoint(df.select(id_col, F.col(vector_col).alias("v"), F.lit(0).cast("long").alias("part")))
    n, first = rows.count(), rows.select("v").first()
    dims, parts = len(first[0]) if first else 0, 1
    while parts < k and n:
        # a row for each part, fewer than 2 * k, comes to the driver
        spread = {r.part: int(np.argmax([r[f"s{i}"] for i in range(dims)])) for r in rows.groupBy("part").agg(*(F.var_pop(F.get("v", F.lit(i)).cast("double")).alias(f"s{i}") for i in range(dims))).collect()}
        axis = F.element_at(F.lit([spread.get(p, 0) for p in range(max(spread) + 1)]), (F.col("part") + 1).cast("int"))
        placed = rank_in_order(rows.withColumn("x", F.get("v", axis)), ["part", "x", id_col])
        parts *= 2
        rows = checkpoint(placed.select(id_col, "v", F.floor(F.col("place") / (n // parts)).cast("long").alias("part")))
    return rows.select(id_col, F.col("part").alias("cluster_id"))


def morton_chunks(df: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster_id: equal chunks along the Z-order curve of the first two components, each cut to 16 bits."""
    x, y = F.get(vector_col, F.lit(0)).cast("double"), F.get(vector_col, F.lit(1)).cast("double")
    x0, x1, y0, y1 = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()

    def cell(v, lo, hi):
        return F.floor((v - lo) / (hi - lo) * 65535 + 0.5).cast("long") if hi > lo else F.lit(0).cast("long")

    cx, cy = cell(x, x0, x1), cell(y, y0, y1)
    code = sum((F.shiftleft(F.shiftright(cx, i).bitwiseAND(1), 2 * i) + F.shiftleft(F.shiftright(cy, i).bitwiseAND(1), 2 * i + 1) for i in range(16)), F.lit(0).cast("long"))
    n = df.count()
    return rank_in_order(df.select(id_col, code.alias("code")), ["code", id_col]).select(id_col, "code", balanced_group(F.col("place"), n, k).alias("cluster_id"))


def mean_radius(assigned: DataFrame) -> float:
    """Mean over clusters of their mean distance to the centroid."""
    return assigned.groupBy("cluster_id").agg(F.avg("distance").alias("r")).agg(F.avg("r")).first()[0] or 0.0


@dataclass
class AdaptivePolicy:
    """Directional PCA first; one way over to balanced clustering once a diagnostic run's mean radius passes the threshold."""

    threshold: float = 0.25
    switched: bool = False
    boundaries: int = 0

    def choose(self, df: DataFrame, k: int, **columns: str) -> str:
        self.boundaries += 1
        if not self.switched and self.boundaries > 1:
            model = directional_pca(df, k, **columns)
            self.switched = mean_radius(model.assign(df, **columns).withColumn("distance", F.sqrt("distance"))) > self.threshold
        return "balanced" if self.switched else "directional-pca"
