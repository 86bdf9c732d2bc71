"""Streaming PCA from mergeable partial accumulators, its transforms, and PCA-ordered exact chunking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vectorgrove.functions import vectors as V
from vectorgrove.operators.aggregates import balanced_group, rank_in_order
from vectorgrove.operators.neighbors import matrix

RANK_VARIANCE = 1e-6


@dataclass
class Moments:
    """Number, mean and scatter of vectors; merging is associative."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(0)
        return cls(len(x), mean, (x - mean).T @ (x - mean))

    def merge(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return other if not self.n else self
        n, delta = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + delta * other.n / n, self.scatter + other.scatter + np.outer(delta, delta) * self.n * other.n / n)

    def covariance(self) -> np.ndarray:
        return self.scatter / (self.n - 1)


def moments(df: DataFrame, vector_col: str = "embedding") -> Moments:
    """One partial result for each partition, merged in the order of partitions."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = None
        for x in frames:
            if len(x):
                part = Moments.of(matrix(x["v"]))
                total = part if total is None else total.merge(part)
        if total is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "n": [total.n], "mean": [total.mean.tobytes()], "scatter": [total.scatter.tobytes()]})

    parts = df.select(F.col(vector_col).alias("v")).mapInPandas(run, "part int, n long, mean binary, scatter binary").collect()
    total = Moments(0, np.zeros(0), np.zeros((0, 0)))
    for r in sorted(parts, key=lambda r: r.part):
        mean = np.frombuffer(r.mean)
        total = total.merge(Moments(r.n, mean, np.frombuffer(r.scatter).reshape(len(mean), -1)))
    return total


@dataclass
class PcaModel:
    mean: np.ndarray
    #: columns are directions
    basis: np.ndarray
    variance: np.ndarray
    total_variance: float

    @property
    def rank(self) -> int:
        return int((self.variance > RANK_VARIANCE).sum())

    def cumulative_variance(self, k: int | None = None) -> float:
        return float(self.variance[:k].sum() / self.total_variance) if self.total_variance > 0 else 0.0

    def truncate(self, k: int) -> PcaModel:
        return PcaModel(self.mean, self.basis[:, :k], self.variance[:k], self.total_variance)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.basis

    def reconstruct(self, y: np.ndarray) -> np.ndarray:
        return y @ self.basis.T + self.mean

    def coordinate(self, vector: Column, axis: int) -> Column:
        """A coordinate as an expression, inside generated code."""
        return V.dot(vector, F.lit(self.basis[:, axis].tolist())) - F.lit(float(self.mean @ self.basis[:, axis]))

    def orthonormality_error(self) -> float:
        return float(np.abs(self.basis.T @ self.basis - np.eye(self.basis.shape[1])).max(initial=0))


def from_moments(m: Moments) -> PcaModel:
    """Directions by falling variance; of each, the component of largest magnitude (the first of equals) is positive."""
    if m.n < 2:
        raise ValueError("PCA needs two vectors at least")
    variance, basis = np.linalg.eigh(m.covariance())
    if variance.min() < -1e-10:
        raise ValueError("covariance isn't positive semidefinite")
    order = np.argsort(-variance, kind="stable")
    variance, basis = np.maximum(variance[order], 0), basis[:, order]
    largest = np.argmax(np.abs(basis), axis=0)
    basis = basis * np.where(basis[largest, np.arange(basis.shape[1])] < 0, -1.0, 1.0)
    return PcaModel(m.mean, basis, variance, float(variance.sum()))


def fit(df: DataFrame, vector_col: str = "embedding", k: int | None = None) -> PcaModel:
    model = from_moments(moments(df, vector_col))
    return model if k is None else model.truncate(k)


def transform(df: DataFrame, model: PcaModel, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame({id_col: x[id_col], "coords": list(shared.value.apply(matrix(x[vector_col])))})

    return df.select(id_col, vector_col).mapInPandas(run, f"{id_col} long, coords array<double>")


def chunk(df: DataFrame, chunks: int, axes: int = 1, gamma: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster_id: exact contiguous chunks by the projection key, the sum of coordinates times variance to the gamma.

    Sizes are at most one apart.  Vectors with equal keys on both sides of a
    chunk's boundary are an error, as the order of equals isn't defined.
    """
    model = fit(df, vector_col, axes)
    key = sum((model.coordinate(F.col(vector_col), a) * float(model.variance[a] ** gamma) for a in range(axes)), F.lit(0.0))
    n = df.count()
    if chunks < 1 or chunks > n:
        raise ValueError("chunks must be between 1 and the number of vectors")
    placed = rank_in_order(df.select(id_col, key.alias("key"), F.col(vector_col).alias("v")), ["key", "v", id_col])
    out = placed.withColumn("cluster_id", balanced_group(F.col("place"), n, chunks))
    edges = out.groupBy("cluster_id").agg(F.min(F.struct("key", "v")).alias("lo"), F.max(F.struct("key", "v")).alias("hi"))
    after = edges.select((F.col("cluster_id") - 1).alias("c"), F.col("lo").alias("next"))
    if not edges.join(after, F.col("cluster_id") == F.col("c")).where(F.col("hi") == F.col("next")).isEmpty():
        raise ValueError("equal keys straddle a chunk boundary")
    return out.select(id_col, "cluster_id")
