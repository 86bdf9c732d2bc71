"""From raw documents to packed training sequences.

Documents of low quality go, then toxic ones, then all but one of each group
of near-duplicates; what stays is packed.  Each stage but the last returns the
columns it got.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vectorgrove.llm import neardup, packing, quality, toxicity
from vectorgrove.llm.common import documents, labels
from vectorgrove.session import ensure_checkpoint_dir, remove

#: No SQL expresses the stages: models are trained, tokens come from a tokenizer.
ORACLE_SQL: str | None = None

#: Documents whose sets of five-word shingles are this similar, in percent, are near-duplicates.
NEAR_PERCENT = 80


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, labels(spark, sf_dir)))


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, percent=NEAR_PERCENT)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_documents),
    ("toxicity", clean_documents),
    ("minhash_near_dedup", distinct_documents),
    ("best_fit_packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder before the next reads it, and deleted when that one is written.

    The rows returned come from what the last but one wrote, which stays.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
