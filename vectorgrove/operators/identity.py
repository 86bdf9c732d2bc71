"""Seeded hashes of vectors, orders and assignments by them, and fingerprints of ordered tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vectorgrove.operators.aggregates import exact_chunks, rank_in_order

# Fixed values of the two hashes: start, multiplier, and bits of rotation.
EMBEDDING_HASH = (0x517CC1B727220A95, 0x9E3779B97F4A7C15, 17)
FIXTURE_HASH = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 13)


class ReplayMismatch(ValueError):
    """A pass has other rows than the one before, or has them in another order."""


def _rotated(h: np.ndarray, bits: int) -> np.ndarray:
    return h << np.uint64(bits) | h >> np.uint64(64 - bits)


def hashes(vectors: np.ndarray, seed: int, kind: tuple[int, int, int] = EMBEDDING_HASH) -> np.ndarray:
    """Unsigned 64-bit hashes of rows of 32-bit floats, all rows one component at a time."""
    start, factor, bits = kind
    words = np.ascontiguousarray(vectors, np.float32).view(np.uint32).astype(np.uint64)
    h = np.full(len(words), start ^ seed, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(words.shape[1]):
            h = _rotated(h ^ words[:, j], bits) * np.uint64(factor) if kind is EMBEDDING_HASH else (_rotated(h, bits) ^ words[:, j]) * np.uint64(factor)
    return h


def _by_dimension(vectors: pd.Series, of) -> pd.Series:
    out = np.zeros(len(vectors), np.int64)
    sizes = vectors.map(len).to_numpy()
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        out[at] = of(np.array(vectors.iloc[at].tolist(), np.float32).reshape(len(at), d))
    return pd.Series(out)


def hash_order(vector: Column, seed: int) -> Column:
    """A signed number in the order of the vector's unsigned hash."""

    @F.pandas_udf("long")
    def run(v: pd.Series) -> pd.Series:
        return _by_dimension(v, lambda x: (hashes(x, seed) ^ np.uint64(1 << 63)).view(np.int64))

    return run(vector)


def fixture_cluster(vector: Column, clusters: int, seed: int) -> Column:
    """The vector's cluster by hash alone."""

    @F.pandas_udf("long")
    def run(v: pd.Series) -> pd.Series:
        return _by_dimension(v, lambda x: (hashes(x, seed, FIXTURE_HASH) % np.uint64(clusters)).astype(np.int64))

    return run(vector)


def shuffled_chunks(df: DataFrame, size: int, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, chunk: exact chunks in the order of hashes (equal ones by id), a control for orders that mean something."""
    keyed = df.select(id_col, hash_order(F.col(vector_col), seed).alias("h"))
    return exact_chunks(keyed, ["h", id_col], size).select(id_col, "chunk")


def fingerprint(df: DataFrame, order: list[str], content: Column, fan: int = 4096) -> DataFrame:
    """chunk, digest: hashes of the rows' hashes, for each ``fan`` rows in order.

    Rows that move, change, come or go change the digests of their chunks;
    ``whole`` makes one of them.  No task has more than ``fan`` rows of a chunk.
    """
    rows = df.select(*order, F.sha2(content.cast("binary"), 256).alias("d"))
    placed = rank_in_order(rows, order).select(F.floor(F.col("place") / fan).cast("long").alias("chunk"), "place", "d")
    return _joined(placed)


def _joined(rows: DataFrame) -> DataFrame:
    parts = rows.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("place", "d"))).alias("p"))
    return parts.select("chunk", F.sha2(F.array_join(F.col("p.d"), "").cast("binary"), 256).alias("digest"))


def whole(digests: DataFrame, fan: int = 4096) -> str | None:
    """One digest of a table's chunk digests, by hashing them in groups until one is left; none of an empty table."""
    while True:
        few = digests.limit(2).collect()
        if len(few) < 2:
            return few[0].digest if few else None
        digests = _joined(digests.select(F.floor(F.col("chunk") / fan).cast("long").alias("chunk"), F.col("chunk").alias("place"), F.col("digest").alias("d")))


def require_same_pass(first: str | None, again: str | None) -> None:
    if first != again:
        raise ReplayMismatch(f"the pass has fingerprint {again}, the first one {first}")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """missing and added: rows that one run has and the other hasn't, counted with their repeats."""
    gone = left.exceptAll(right).agg(F.count("*").alias("missing"))
    return gone.join(right.exceptAll(left).agg(F.count("*").alias("added")))  # one row each
