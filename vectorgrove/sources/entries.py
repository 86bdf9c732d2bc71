"""Typed forms of block tables: leaves from rows, and entries from blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vectorgrove.functions import codecs
from vectorgrove.sources.blocks import BLOCKS, block_id, leaf_bytes, parse

ENTRY = "block_id binary, level int, dims int, encoding string, pos long, embedding array<double>, child binary, metadata map<string,string>, media_type string, body binary"


def leaves(df: DataFrame, vector_col: str = "embedding", metadata_col: str = "metadata", media_col: str = "media_type", body_col: str = "body", encoding: str = "f32le") -> DataFrame:
    """block_id, bytes: a leaf for each row, of a vector, metadata (a map of strings), a media type and a body."""
    rows = df.select(F.col(vector_col).alias("v"), F.col(metadata_col).alias("meta"), F.col(media_col).alias("media"), F.col(body_col).cast("binary").alias("body"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            made = [leaf_bytes(len(v), codecs.encode(v, encoding), dict(m), t, bytes(b), encoding) for v, m, t, b in zip(x["v"], x["meta"], x["media"], x["body"], strict=True)]
            yield pd.DataFrame({"block_id": [block_id(b) for b in made], "bytes": made})

    return rows.mapInPandas(run, BLOCKS)


def entries(blocks: DataFrame) -> DataFrame:
    """One row for each entry, checked against the block's id; ``child`` is null in leaves, metadata, media type and body in branches.

    A block that is missing (null bytes) or malformed, or isn't what its id says, is an error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = []
            for key, data in zip(x["block_id"], x["bytes"], strict=True):
                if data is None:
                    raise ValueError(f"block {bytes(key).hex()} is missing")
                b = parse(bytes(data), bytes(key))
                for i, e in enumerate(b["entries"]):
                    vector = codecs.decode(e[0], b["dims"], b["encoding"]).tolist()
                    leaf = b["level"] == 0
                    meta = {str(k): str(v) for k, v in e[1].items()} if leaf else None
                    out.append((key, b["level"], b["dims"], b["encoding"], i, vector, None if leaf else e[1], meta, e[2][0] if leaf else None, e[2][1] if leaf else None))
            yield pd.DataFrame(out, columns=["block_id", "level", "dims", "encoding", "pos", "embedding", "child", "metadata", "media_type", "body"])

    return blocks.select("block_id", "bytes").mapInPandas(run, ENTRY)
