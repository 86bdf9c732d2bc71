"""Least-cost assignment of many rows to few clusters with bounds on their sizes, in bounded memory.

Prices of clusters decide: a row belongs where cost plus price is least.  The
dual is concave in the prices, and within a box around some prices only the
rows whose choice can change there matter.  These come to the driver, as
groups of equal costs, and are solved exactly; where the best prices lie on
the border of the box, the next box is around these.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vectorgrove.operators.aggregates import rank_in_order
from vectorgrove.operators.neighbors import matrix
from vectorgrove.session import checkpoint

#: Groups of rows whose choice is open that come to the driver at most, and groups whose prices are the first guess.
MAX_OPEN, GUESSED_BY = 65_536, 16_384
#: Costs are whole multiples of 1 / SCALE, so that equal ones are equal and sums exact.
SCALE = 1 << 44
FAR = 1 << 52
MAX_BOXES = 1_000


def costs(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Cosine distances in units of 1 / SCALE, each row on its own: equal rows have equal costs."""
    na, nb = np.sqrt(np.einsum("ij,ij->i", x, x)), np.linalg.norm(centers, axis=1)
    if not (na.all() and nb.all()):
        raise ValueError("zero norm")
    return np.rint((1 - np.einsum("ij,kj->ik", x / na[:, None], centers / nb[:, None])) * SCALE).astype(np.int64)


def chosen(cost: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest cluster of each row, and by how much it is cheaper than the next."""
    full = cost + price
    best = full.argmin(1)
    if full.shape[1] < 2:
        return best, np.full(len(full), FAR)
    two = np.partition(full, 1, axis=1)
    return best, two[:, 1] - two[:, 0]


class _Flow:
    """Rows in clusters, and clusters' flows to the sink, that are moved along cheapest paths until they agree.

    Between a cluster and the sink are three arcs: within the bounds, free;
    beyond ``high``, at the highest price of the box; below ``low``, at the
    lowest.  ``fixed`` rows of a cluster never move.
    """

    def __init__(self, cost: np.ndarray, weight: np.ndarray, first: np.ndarray, fixed: np.ndarray, price: np.ndarray, reach: int, low: int, high: int):
        self.cost, self.k = cost, cost.shape[1]
        best, _ = chosen(cost, price) if len(cost) else (np.zeros(0, int), None)
        held = np.zeros(cost.shape, np.int64)
        held[np.arange(len(cost)), best] = weight
        count = fixed + held.sum(0)
        self.low, self.high, self.top, self.bottom = low, high, (price + reach).tolist(), (price - reach).tolist()
        self.normal = np.where(price > 0, high, np.where(price < 0, low, np.clip(count, low, high))).tolist()
        self.over, self.under = [0] * self.k, [0] * self.k
        self.excess = (count - self.normal).tolist()
        self.excess.append(-sum(self.excess))
        self.held, self.first = held.tolist(), first.tolist()
        self.moves: list[list[list]] = [[[] for _ in range(self.k)] for _ in range(self.k)]
        for a in range(self.k):
            here = np.flatnonzero(held[:, a])
            for b in range(self.k):
                if a != b:
                    gain = cost[here, b] - cost[here, a]
                    order = np.lexsort((first[here], gain))
                    self.moves[a][b] = list(zip(gain[order].tolist(), first[here][order].tolist(), here[order].tolist(), strict=True))

    def _arcs(self) -> list[tuple]:
        """(from, to, cost, kind, group) of what can be moved; the sink is node k."""
        out, sink = [], self.k
        for a in range(self.k):
            for b in range(self.k):
                heap = self.moves[a][b]
                while heap and not self.held[heap[0][2]][a]:
                    heapq.heappop(heap)
                if heap:
                    out.append((a, b, heap[0][0], "move", heap[0][2]))
        for c in range(self.k):
            if self.normal[c] < self.high:
                out.append((c, sink, 0, "fill", c))
            if self.normal[c] > self.low:
                out.append((sink, c, 0, "drain", c))
            out.append((c, sink, self.top[c], "over", c))
            out.append((sink, c, -self.bottom[c], "under", c))
            if self.over[c]:
                out.append((sink, c, -self.top[c], "less over", c))
            if self.under[c]:
                out.append((c, sink, self.bottom[c], "less under", c))
        return out

    def _room(self, arc: tuple) -> int:
        a, _, _, kind, g = arc
        if kind == "move":
            return self.held[g][a]
        return {"fill": self.high - self.normal[g], "drain": self.normal[g] - self.low, "less over": self.over[g], "less under": self.under[g]}.get(kind, FAR)

    def _send(self, arc: tuple, n: int) -> None:
        a, b, _, kind, g = arc
        if kind == "move":
            if not self.held[g][b]:  # entries of a group that has left a cluster go when they come up
                for c in range(self.k):
                    if c != b:
                        heapq.heappush(self.moves[b][c], (int(self.cost[g, c] - self.cost[g, b]), self.first[g], g))
            self.held[g][a] -= n
            self.held[g][b] += n
        elif kind in ("fill", "drain"):
            self.normal[g] += n if kind == "fill" else -n
        elif kind in ("over", "less over"):
            self.over[g] += n if kind == "over" else -n
        else:
            self.under[g] += n if kind == "under" else -n

    def _paths(self, arcs: list[tuple], start: int) -> tuple[list[int], list]:
        reach, came = [FAR * 64] * (self.k + 1), [None] * (self.k + 1)
        reach[start] = 0
        for _ in range(self.k + 1):
            changed = False
            for arc in arcs:
                d = reach[arc[0]] + arc[2]
                if d < reach[arc[1]] and reach[arc[0]] < FAR * 64:
                    reach[arc[1]], came[arc[1]], changed = d, arc, True
            if not changed:
                break
        return reach, came

    def solve(self) -> None:
        while any(e > 0 for e in self.excess):
            start = next(i for i, e in enumerate(self.excess) if e > 0)
            reach, came = self._paths(self._arcs(), start)
            end = min((i for i, e in enumerate(self.excess) if e < 0), key=lambda i: (reach[i], i))
            path, at = [], end
            while at != start:
                path.append(came[at])
                at = came[at][0]
            n = min(self.excess[start], -self.excess[end], *map(self._room, path))
            for arc in path:
                self._send(arc, n)
            self.excess[start] -= n
            self.excess[end] += n

    def prices(self) -> np.ndarray:
        """Prices at which what is moved is cheapest: costs of the ways to the sink."""
        back = [(b, a, cost, kind, g) for a, b, cost, kind, g in self._arcs()]
        return np.array(self._paths(back, self.k)[0][: self.k], np.int64)

    def within(self) -> bool:
        return not any(self.over) and not any(self.under)

    def counts(self) -> dict[bytes, np.ndarray]:
        return {c.tobytes(): np.array(n) for c, n in zip(self.cost, self.held, strict=True)}


def solved(cost: np.ndarray, low: int, high: int, weight: np.ndarray | None = None, first: np.ndarray | None = None) -> _Flow:
    """The whole problem of a table in memory."""
    n, k = cost.shape
    weight, first = np.ones(n, np.int64) if weight is None else weight, np.arange(n) if first is None else first
    flow = _Flow(cost, weight, first, np.zeros(k, np.int64), np.zeros(k, np.int64), FAR, low, high)
    flow.solve()
    return flow


@dataclass
class Assignment:
    """Prices, and the groups of equal costs whose rows they leave open: how many rows of a group go to each cluster, in the order of ids."""

    price: np.ndarray
    open: dict[bytes, np.ndarray]

    def assign(self, df: DataFrame, centers: np.ndarray, id_col: str, vector_col: str) -> DataFrame:
        """id, vector, cluster_id; rows of groups in more than one cluster are ranked for it."""
        shared = df.sparkSession.sparkContext.broadcast((centers, self.price, self.open))

        def run(frames):
            for x in frames:
                c, price, groups = shared.value
                cost = costs(matrix(x[vector_col]), c) if len(x) else np.zeros((0, len(c)), np.int64)
                best, _ = chosen(cost, price) if len(x) else (np.zeros(0, int), None)
                keys = [r.tobytes() for r in cost]
                counts = [groups.get(key) for key in keys]
                where = [int(b) if n is None else int(np.flatnonzero(n)[0]) if np.count_nonzero(n) == 1 else -1 for b, n in zip(best, counts, strict=True)]
                yield pd.DataFrame({id_col: x[id_col], vector_col: x[vector_col], "cluster_id": where, "key": [key if w < 0 else None for key, w in zip(keys, where, strict=True)]})

        kinds = {f.name: f.dataType.simpleString() for f in df.select(id_col, vector_col).schema}
        placed = df.select(id_col, vector_col).mapInPandas(run, f"{id_col} {kinds[id_col]}, {vector_col} {kinds[vector_col]}, cluster_id long, key binary")
        split = {key: n for key, n in self.open.items() if np.count_nonzero(n) > 1}
        if not split:
            return placed.drop("key")
        placed = checkpoint(placed)
        start, cuts = 0, []
        for key in sorted(split):  # ranks of all split groups follow each other
            for c, n in enumerate(split[key]):
                start += int(n)
                cuts.append((start, c))
        ends = F.array(*(F.struct(F.lit(end).cast("long").alias("end"), F.lit(c).cast("long").alias("c")) for end, c in cuts))
        ranked = rank_in_order(placed.where("cluster_id < 0"), ["key", id_col]).withColumn("cluster_id", F.get(F.filter(ends, lambda e: e["end"] > F.col("place")), F.lit(0))["c"])
        return placed.where("cluster_id >= 0").drop("key").unionByName(ranked.drop("key", "place"))


def _cost_groups(df: DataFrame, centers: np.ndarray, id_col: str, vector_col: str) -> DataFrame:
    """cost (whole numbers as bytes), n and least id of the rows of equal costs."""
    shared = df.sparkSession.sparkContext.broadcast(centers)

    def run(frames):
        for x in frames:
            if len(x):
                yield pd.DataFrame({"cost": [r.tobytes() for r in costs(matrix(x[vector_col]), shared.value)], "i": x[id_col]})

    rows = df.select(id_col, vector_col).mapInPandas(run, "cost binary, i long")
    return checkpoint(rows.groupBy("cost").agg(F.count("*").alias("n"), F.min("i").alias("first")))


def _local(groups: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = groups.toPandas().sort_values("first", ignore_index=True)
    return np.frombuffer(b"".join(map(bytes, rows["cost"])), np.int64).reshape(-1, k), rows["n"].to_numpy(np.int64), rows["first"].to_numpy()


def _settled(groups: DataFrame, price: np.ndarray) -> pd.DataFrame:
    """By cluster and bits of the lead of the cheapest cluster: groups and their rows."""

    def run(frames):
        for x in frames:
            if len(x):
                best, lead = chosen(np.frombuffer(b"".join(map(bytes, x["cost"])), np.int64).reshape(len(x), -1), price)
                yield pd.DataFrame({"c": best, "bits": [int(v).bit_length() for v in lead], "n": x["n"]}).groupby(["c", "bits"], as_index=False).agg(groups=("n", "size"), n=("n", "sum"))

    return groups.select("cost", "n").mapInPandas(run, "c long, bits long, groups long, n long").groupBy("c", "bits").agg(F.sum("groups").alias("groups"), F.sum("n").alias("n")).toPandas()


def _open(groups: DataFrame, price: np.ndarray, bits: int) -> DataFrame:
    def run(frames):
        for x in frames:
            if len(x):
                _, lead = chosen(np.frombuffer(b"".join(map(bytes, x["cost"])), np.int64).reshape(len(x), -1), price)
                yield x[lead < (1 << bits)]

    return groups.select("cost", "n", "first").mapInPandas(run, "cost binary, n long, first long")


def least_cost(df: DataFrame, centers: np.ndarray, low: int, high: int, id_col: str, vector_col: str) -> Assignment:
    """Of all assignments with ``low`` to ``high`` rows in each cluster, one of least cost."""
    k = len(centers)
    groups = _cost_groups(df, centers, id_col, vector_col)
    facts = groups.agg(F.count("*").alias("groups"), F.sum("n").alias("n")).first()
    if not facts.n or k * low > facts.n or k * high < facts.n:
        raise ValueError("bounds can't be met")
    if facts.groups <= MAX_OPEN:
        cost, weight, first = _local(groups, k)
        flow = solved(cost, low, high, weight, first)
        return Assignment(np.zeros(k, np.int64), flow.counts())
    # only the first guess comes from some groups
    cost, weight, first = _local(groups.orderBy(F.xxhash64("cost"), "cost").limit(GUESSED_BY), k)
    share = int(weight.sum()) / facts.n
    price = solved(cost, int(low * share), -int(-high * share // 1), weight, first).prices()
    for _ in range(MAX_BOXES):
        settled = _settled(groups, price)
        by_bits = settled.groupby("bits")["groups"].sum().sort_index().cumsum()
        few = by_bits[by_bits <= MAX_OPEN]
        if not len(few):
            raise ValueError(f"more than {MAX_OPEN} groups of rows between the same clusters")
        bits = int(few.index[-1])
        cost, weight, first = _local(_open(groups, price, bits), k)
        kept = settled[settled["bits"] > bits].groupby("c")["n"].sum()
        fixed = np.array([int(kept.get(c, 0)) for c in range(k)])
        # a lead of 2 ** bits or more outlasts any two prices moved by so much
        flow = _Flow(cost, weight, first, fixed, price, ((1 << bits) - 1) // 2, low, high)
        flow.solve()
        if flow.within():
            return Assignment(price, flow.counts())
        if bits < 2:
            raise ValueError(f"more than {MAX_OPEN} groups of rows between the same clusters")
        price = flow.prices()
    raise ValueError(f"no prices found in {MAX_BOXES} boxes")
