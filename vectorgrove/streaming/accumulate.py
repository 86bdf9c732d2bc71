"""Moments of a stream of vectors, and an append-only sink of leaf blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vectorgrove.operators.pca import Moments, PcaModel, from_moments, moments
from vectorgrove.sources.blocks import BlockTable


class StreamingPca:
    """Merges the moments of each micro-batch once; a batch that is replayed after a failure isn't counted again.

    With a path, every batch's moments go to a table there, in a folder of the
    batch's number, so that a query that starts again from its checkpoint has
    those of the batches before.
    """

    def __init__(self, path: str | None = None) -> None:
        self.path = path
        self.by_batch: dict[int, int] = {}
        self.total: Moments | None = None

    def update(self, batch: DataFrame, batch_id: int, vector_col: str = "embedding") -> None:
        if batch_id in self.by_batch and not self.path:
            return
        part = moments(batch, vector_col)
        self.by_batch[batch_id] = part.n
        if self.path and part.n:
            row = [(part.n, part.mean.tolist(), part.scatter.astype("<f8").tobytes())]
            batch.sparkSession.createDataFrame(row, "n long, mean array<double>, scatter binary").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")
        elif part.n:
            self.total = part if self.total is None else self.total.merge(part)

    def restored(self, spark: SparkSession) -> Moments | None:
        """Moments of all batches in the table, in order of their numbers."""
        total = None
        for r in spark.read.parquet(self.path).orderBy("batch_id").toLocalIterator():
            mean = np.array(r.mean)
            part = Moments(r.n, mean, np.frombuffer(r.scatter, "<f8").reshape(len(mean), -1))
            total = part if total is None else total.merge(part)
        return total

    def start(self, stream: DataFrame, checkpoint_dir: str, vector_col: str = "embedding") -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(lambda df, i: self.update(df, i, vector_col))
        return writer.option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()

    def model(self, spark: SparkSession | None = None) -> PcaModel:
        if self.path and spark is not None:
            self.total = self.restored(spark)
        if self.total is None:
            raise ValueError("no vectors yet")
        return from_moments(self.total)


def append_blocks(stream: DataFrame, table: BlockTable, checkpoint_dir: str) -> StreamingQuery:
    """Blocks (block_id, bytes) into a table, each id once."""
    writer = stream.writeStream.foreachBatch(lambda df, _: table.put(df))
    return writer.option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
