"""Bounded samples of labelled documents, and feature matrices of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vectorgrove.llm.common import byte_batches, fold

#: Labelled rows that classifiers are fitted on, at most (in expectation).
MAX_LABELLED = 20_000


def sampled_labels(labels: DataFrame, label: str, id_col: str = "doc_id", most: int = MAX_LABELLED) -> DataFrame:
    """labelled_id and label of documents outside the held-out fold, about ``most`` of them.

    Labels other than 0 and 1 are left out; where an id has several labels
    the largest holds.  The sample depends on ids only.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col, 5) != 0))
    rows = known.count()
    share = min(1.0, most / rows) if rows else 1.0
    chance = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("long"), F.lit(5)), 11) / F.lit(float(1 << 53))
    return known.where(chance < share).groupBy(F.col(id_col).cast("long").alias("labelled_id")).agg(F.max(label).cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text and label of the documents of ``sampled_labels``."""
    known = sampled_labels(labels, label, id_col, most)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the sample's size is bounded, so it may be sent to every executor
    return docs.join(F.broadcast(known), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "text", "label")


def features_of(sample: DataFrame, features: Callable[[str], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of a bounded sample, in the order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_batches(whole, "text"):
                rows = [features(t or "").astype("<f8").tobytes() for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "x"])

    rows = sample.mapInArrow(run, "doc_id long, label int, x binary").toArrow().sort_by([("doc_id", "ascending")])
    x = [np.frombuffer(v, "<f8") for v in rows["x"].to_pylist()]
    return (np.array(x) if x else np.zeros((0, len(features(""))))), np.array(rows["label"].to_pylist(), np.int64)


def scored(docs: DataFrame, score: Callable[[list[str]], np.ndarray], bar: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document (null text: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_batches(whole, "text"):
                s = score([t or "" for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= bar).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col, 5) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def filtered(docs: DataFrame, keep: Callable[[list[str]], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose texts (null: empty) are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_batches(whole, text_col):
                yield b.filter(pa.array(keep([t or "" for t in b.column(text_col).to_pylist()])))

    return docs.mapInArrow(run, docs.schema)
