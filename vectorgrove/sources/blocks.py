"""Content-addressed blocks, and stores of them as tables, sharded files, archives and overlays."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vectorgrove.functions import cbor

# Protocol keys of blocks, entries and content.
VERSION, LEVEL, SPEC, ENTRIES, EXT = 0, 1, 2, 3, 15
BLOCKS = "block_id binary, bytes binary"


def branch_bytes(level: int, dims: int, encoding: str, entries: list[tuple[bytes, bytes]], ext: dict | None = None) -> bytes:
    """A branch of (embedding, child) entries in order; equal entries are an error."""
    if level < 1 or not entries or len(set(entries)) < len(entries):
        raise ValueError("a branch needs a level above 0 and distinct entries")
    body = {VERSION: 1, LEVEL: level, SPEC: {0: dims, 1: encoding}, ENTRIES: [{0: e, 1: c} for e, c in sorted(entries)]}
    return cbor.encode(body | ({EXT: ext} if ext else {}))


def leaf_bytes(dims: int, embedding: bytes, metadata: dict, media_type: str, body: bytes, encoding: str = "f32le") -> bytes:
    return cbor.encode({VERSION: 1, LEVEL: 0, SPEC: {0: dims, 1: encoding}, ENTRIES: [{0: embedding, 1: metadata, 2: {0: media_type, 1: body}}]})


def block_id(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def parse(data: bytes, expected: bytes | None = None) -> dict:
    """level, dims, encoding, entries and ext of a canonical block whose id is as expected."""
    if expected is not None and block_id(data) != expected:
        raise ValueError("block id doesn't match")
    block = cbor.decode(data)
    if not isinstance(block, dict) or not {VERSION, LEVEL, SPEC, ENTRIES} <= set(block) <= {VERSION, LEVEL, SPEC, ENTRIES, EXT} or block[VERSION] != 1:
        raise ValueError("not a block")
    keys = {0, 1, 2} if block[LEVEL] == 0 else {0, 1}
    if block[LEVEL] == 0 and len(block[ENTRIES]) != 1 or any(set(e) != keys for e in block[ENTRIES]):
        raise ValueError("malformed entries")
    return {"level": block[LEVEL], "dims": block[SPEC][0], "encoding": block[SPEC][1], "entries": block[ENTRIES], "ext": block.get(EXT)}


def capacity(dims: int, size: int) -> int:
    """Most entries of a branch of float embeddings whose block has ``size`` bytes at most; fewer than two are an error."""
    length = lambda n: len(branch_bytes(1, dims, "f32le", [(bytes(4 * dims), i.to_bytes(32)) for i in range(n)]))
    one, two = length(1), length(2)
    n = max(1, 1 + (size - one) // (two - one))
    while n > 1 and length(min(n, 70_000)) > size:
        n -= 1
    if n < 2:
        raise ValueError("two entries don't fit")
    return n


@dataclass
class BlockTable:
    """Blocks as a table of Parquet files; puts leave out blocks that are there."""

    spark: SparkSession
    path: str

    def blocks(self) -> DataFrame:
        try:
            return self.spark.read.schema(BLOCKS).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], BLOCKS)
            raise

    def put(self, blocks: DataFrame) -> None:
        new = blocks.select("block_id", "bytes").dropDuplicates(["block_id"])
        new.join(self.blocks().select(F.col("block_id").alias("there")), F.col("block_id") == F.col("there"), "left_anti").write.mode("append").parquet(self.path)

    def get(self, ids: DataFrame) -> DataFrame:
        """block_id of ids with bytes, null where missing."""
        found = self.blocks().select(F.col("block_id").alias("there"), "bytes")
        return ids.select("block_id").join(found, F.col("block_id") == F.col("there"), "left").select("block_id", "bytes")

    def ids(self) -> DataFrame:
        return self.blocks().select("block_id").distinct()

    def compact(self, files: int) -> None:
        """Rewrite into so many files, in order of ids, and swap the folders; the old one goes last.

        Where a swap was cut short, the store is whole in the folder put aside, which ``recover`` brings back.
        """
        jvm = self.spark.sparkContext._jvm
        old, new, aside = (jvm.org.apache.hadoop.fs.Path(self.path + end) for end in ("", ".compacted", ".old"))
        self.blocks().repartitionByRange(files, "block_id").sortWithinPartitions("block_id").write.mode("overwrite").parquet(self.path + ".compacted")
        fs = old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(aside, True)
        if not fs.rename(old, aside) or not fs.rename(new, old):
            raise OSError(f"{self.path} couldn't be swapped")
        fs.delete(aside, True)

    def recover(self) -> None:
        """After a compaction that was cut short: the folder put aside becomes the store where there is none."""
        jvm = self.spark.sparkContext._jvm
        old, aside = (jvm.org.apache.hadoop.fs.Path(self.path + end) for end in ("", ".old"))
        fs = old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(old) and fs.exists(aside):
            fs.rename(aside, old)


def overlay(layers: list[DataFrame]) -> DataFrame:
    """Blocks of several stores, each from the first that has it."""
    parts = [b.select("block_id", "bytes", F.lit(i).alias("layer")) for i, b in enumerate(layers)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("block_id").agg(F.min_by("bytes", "layer").alias("bytes"))


def read_sharded(spark: SparkSession, path: str) -> DataFrame:
    """Blocks from files ab/cd/<hex id>.cbor."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.cbor").load(path)
    return files.select(F.unhex(F.regexp_extract("path", r"([0-9a-f]{64})\.cbor$", 1)).alias("block_id"), F.col("content").alias("bytes"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Blocks from zip archives of such files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for content in x["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if n.endswith(".cbor")]
                    yield pd.DataFrame({"block_id": [bytes.fromhex(n.rsplit("/", 1)[-1][:-5]) for n in names], "bytes": [z.read(n) for n in names]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, BLOCKS)


def verified(blocks: DataFrame) -> DataFrame:
    """The blocks; the job fails on one whose id isn't the hash of its bytes."""
    good = F.unhex(F.sha2("bytes", 256)) == F.col("block_id")
    return blocks.withColumn("bytes", F.when(good, F.col("bytes")).otherwise(F.raise_error(F.lit("block id doesn't match")).cast("binary")))
