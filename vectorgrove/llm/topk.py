"""Exact top-k inner products by aggregation of sorted lists without random access.

Candidates are dealt into blocks.  In a block every component is a list
sorted by value, read from the top where the query's component is positive
and from the bottom where it is negative.  All lists are read to the same
depth at a time.  What a candidate's unread components can add lies between
the end of each list and the value reached there, which bounds its score from
below and above; candidates whose upper bound is under the k-th best lower
bound are out.  Reading stops when few are left, whose scores are then
resolved by reading the rest of their components.

Queries go to the blocks in groups of bounded size, and every group meets
every block where the block is.  A task reads its blocks one after the other
and takes the k-th best score so far, which starts from a few blocks read
before all others, into the next: a block whose lists begin under it isn't
read at all, and the others stop earlier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vectorgrove.llm.common import checkpoint

BLOCK_ROWS, QUERY_ROWS = 4096, 512
#: Queries sent to all blocks at a time, about, and components that they have together, at most about.
GROUP_QUERIES, GROUP_COMPONENTS = 8192, 4_000_000
#: Blocks read first, for bounds to begin with.
SEED_BLOCKS = 2
#: Shares of the lists read before bounds are compared; the last is all of them.
DEPTHS = (0.25, 0.5, 1.0)
#: Candidates a query may have left for reading to stop.
FEW = 64
PACKED = "dims int, ids binary, width int, vectors binary"
_NONE = -(2**200)


def _size(a: np.ndarray) -> int:
    return max(abs(int(a.min())), abs(int(a.max()))) if a.size else 0


class Lists:
    """A block's sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        if len(np.unique(ids)) < len(ids):  # repeated rows would take places of the k
            rows = np.unique(np.column_stack([ids, vectors.astype(np.int64)]), axis=0)
            ids, vectors = rows[:, 0], rows[:, 1:]
        self.ids, self.vectors, self.largest = ids, vectors, _size(vectors)
        self.ordered: np.ndarray | None = None
        #: Components read of all that were there, for queries met so far.
        self.read = self.offered = 0

    def sort(self) -> None:
        if self.ordered is None:
            self.x = self.vectors.astype(np.float64)
            order = np.argsort(self.x, axis=0, kind="stable")
            self.rank = np.empty(order.shape, np.int32)
            np.put_along_axis(self.rank, order, np.arange(len(self.ids), dtype=np.int32)[:, None].repeat(self.x.shape[1], 1), 0)
            self.ordered = np.take_along_axis(self.x, order, 0)

    def _best(self, qid: int, q: np.ndarray, some: np.ndarray, k: int, floor: int) -> list[tuple[int, int, int]]:
        """Exact scores of candidates, the k best of them, if no worse than the floor."""
        if _size(q) * self.largest * max(1, len(q)) < 2**63:
            score = self.vectors[some].astype(np.int64) @ q.astype(np.int64)
            if floor > -(2**63):
                some, score = some[score >= floor], score[score >= floor]
            if len(some) > k:
                bar = np.partition(score, len(some) - k)[len(some) - k]
                some, score = some[score >= bar], score[score >= bar]
            best = np.lexsort((self.ids[some], -score))[:k]
            return [(qid, int(self.ids[some[b]]), int(score[b])) for b in best]
        parts = [int(v) for v in q]
        scores = [(sum(a * int(b) for a, b in zip(parts, self.vectors[s], strict=True)), int(self.ids[s])) for s in some]
        return [(qid, i, v) for v, i in sorted(scores, key=lambda c: (-c[0], c[1]))[:k] if v >= floor]

    def top(self, qids: np.ndarray, queries: np.ndarray, k: int, floors: list[int]) -> list[tuple[int, int, int]]:
        """(query id, candidate id, score) of up to k candidates of each query, those among its k best with scores from its floor on.

        Ties go to the smaller id, and a query's own id is left out.
        """
        out: list[tuple[int, int, int]] = []
        rows, d = self.vectors.shape
        if not rows or not len(qids):
            return out
        self.offered += len(qids) * rows
        if _size(queries) * self.largest * max(1, d) >= 2**53:  # bounds would not be exact
            self.read += len(qids) * rows
            for i in range(len(qids)):
                out.extend(self._best(int(qids[i]), queries[i], np.flatnonzero(self.ids != qids[i]), k, floors[i]))
            return out
        self.sort()
        x, low, high = self.x, self.ordered[0], self.ordered[-1]
        q = queries.astype(np.float64)
        both = np.hstack([np.maximum(q, 0), np.minimum(q, 0)])
        floor = np.array([float(max(f, -(2**60))) for f in floors])
        # no candidate is better than one with the beginnings of all lists
        pending = np.flatnonzero(both @ np.concatenate([high, low]) >= floor)
        alive = self.ids[None, :] != qids[:, None]
        twice, worst = np.hstack([x, x]), np.concatenate([low, high])
        before = 0
        for share in DEPTHS:
            if not len(pending):
                break
            depth = max(1, int(rows * share))
            self.read += len(pending) * (depth - before)
            before = depth
            mine = both[pending]
            seen = np.hstack([self.rank >= rows - depth, self.rank < depth])
            reached = np.concatenate([self.ordered[rows - depth], self.ordered[depth - 1]])
            upper = (mine @ reached)[:, None] + mine @ np.where(seen, twice - reached, 0).T
            lower = (mine @ worst)[:, None] + mine @ np.where(seen, twice - worst, 0).T
            lower[~alive[pending]] = -np.inf
            bar = floor[pending]
            if k < rows:
                bar = np.maximum(bar, np.partition(lower, rows - k, axis=1)[:, rows - k])
            alive[pending] &= upper >= bar[:, None]
            left = alive[pending].sum(axis=1)
            done = (left <= max(FEW, k)) | (share == DEPTHS[-1])
            for i in pending[done]:
                out.extend(self._best(int(qids[i]), queries[i], np.flatnonzero(alive[i]), k, floors[i]))
            pending = pending[~done]
        return out


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, k: int, floors: dict[int, int]):
        self.k, self.floors, self.found = k, floors, {}

    def floor(self, qid: int) -> int:
        mine = self.found.get(qid, ())
        return max(self.floors.get(qid, _NONE), mine[-1][0] if len(mine) == self.k else _NONE)

    def add(self, rows: list[tuple[int, int, int]]) -> None:
        by: dict[int, set[tuple[int, int]]] = {}
        for qid, vec_id, score in rows:
            by.setdefault(qid, set()).add((score, vec_id))
        for qid, new in by.items():
            self.found[qid] = sorted(new.union(self.found.get(qid, ())), key=lambda c: (-c[0], c[1]))[: self.k]

    def rows(self) -> list[tuple[int, int, int]]:
        return [(qid, vec_id, score) for qid, mine in self.found.items() for score, vec_id in mine]


def _widths(a: np.ndarray) -> int:
    return next(w for w in (1, 2, 4, 8) if w == 8 or _size(a) < 1 << 8 * w - 1)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most size rows of equal dimension, as little-endian integers of the least width that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def flush(dims: int) -> pa.RecordBatch:
            ids, vectors = held.pop(dims)
            flat = np.concatenate(vectors) if dims else np.zeros(0, np.int64)
            width = _widths(flat)
            data = [dims], [np.array(ids, "<i8").tobytes()], [width], [flat.astype(f"<i{width}").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(d, t) for d, t in zip(data, (pa.int32(), pa.binary(), pa.int32(), pa.binary()), strict=True)], ["dims", "ids", "width", "vectors"])

        for b in batches:
            vectors = b.column("v")
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.array([len(v) for v in vectors], np.int64))])
            for i, vec_id in enumerate(b.column("vec_id").to_pylist()):
                dims = int(ends[i + 1] - ends[i])
                ids, parts = held.setdefault(dims, ([], []))
                ids.append(vec_id)
                parts.append(flat[ends[i] : ends[i + 1]])
                if len(ids) == size:
                    yield flush(dims)
        for dims in list(held):
            yield flush(dims)

    return rows.mapInArrow(run, PACKED)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(len(ids), row["dims"])


def components(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and v = floor(scale * x) of every vector that takes part: it and its id aren't null, and all components are finite."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v")
    )


def _met(blocks: DataFrame, group: dict[int, tuple[np.ndarray, ...]], k: int, floors: dict[int, int]) -> DataFrame:
    """Up to k candidates of each query of the group (by dimension: ids and vectors) in each task's blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast((group, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, floors = shared.value
        best = Best(k, floors)
        for b in batches:
            for row in b.to_pylist():
                if row["dims"] not in group:
                    continue
                lists = Lists(*_unpacked(row))
                qids, queries = group[row["dims"]]
                for at in range(0, len(qids), QUERY_ROWS):
                    some = qids[at : at + QUERY_ROWS]
                    best.add(lists.top(some, queries[at : at + QUERY_ROWS], k, [best.floor(int(i)) for i in some]))
        found = best.rows()
        # a score beyond 64 bits is given as their end; places among the k best come from the exact ones in a task
        cols = [r[0] for r in found], [r[1] for r in found], [min(max(r[2], -(2**63)), 2**63 - 1) for r in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return blocks.mapInArrow(run, "query_id long, vec_id long, score long")


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best among vectors (vec_id, v).

    Only vectors of a query's dimension are candidates.  Rows that share the
    query's id are the query's own and left out.  Repeated rows of an id and
    vector count once; ties go to the smaller id.  Queries or vectors of no
    rows give no rows.  Other columns are not read.
    """
    blocks = checkpoint(_packed(vectors.select("vec_id", "v"), BLOCK_ROWS))
    wanted = checkpoint(queries.select("vec_id", "v").dropDuplicates())
    rows, components = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0))).first()
    groups = max(1, -(-rows // GROUP_QUERIES), -(-components // GROUP_COMPONENTS))
    seeds = blocks.limit(SEED_BLOCKS)
    found = []
    for g in range(groups):
        # a group's size is its share of the bounds above, so it may be sent to every task
        mine = wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g) if groups > 1 else wanted
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for row in _packed(mine, QUERY_ROWS).collect():
            parts.setdefault(row["dims"], []).append(_unpacked(row.asDict()))
        group = {dims: tuple(np.concatenate(c) for c in zip(*of, strict=True)) for dims, of in parts.items()}
        begun = Best(k, {})
        begun.add([tuple(r) for r in _met(seeds, group, k, {}).collect()])
        floors = {qid: mine[-1][0] for qid, mine in begun.found.items() if len(mine) == k}
        one = _met(blocks, group, k, floors)
        found.append(checkpoint(one) if groups > 1 else one)
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # rows repeated in several blocks are found by each
    return every.dropDuplicates().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
