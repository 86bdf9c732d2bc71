"""Best-fit packing by minimum bin slack.

Documents become token ids, cut into pieces of at most ``capacity`` tokens.
The number of pieces of each length (at most ``capacity`` numbers, whatever
the corpus) is all that planning needs: each new sequence takes the longest
length left, and a bitset subset-sum search over the lengths available finds
the fullest combination with it, which is then removed as often as the counts
allow.  Pieces are ranked within their length, which fixes sequence and
offset of each.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vectorgrove.llm.common import byte_batches, checkpoint

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Distinct words of which a worker keeps the ids; more only cost time.
CACHED_WORDS = 500_000
#: Pieces ranked together are about this many, or more where there would be over MAX_GROUPS groups.
GROUP_ROWS, MAX_GROUPS = 250, 65_536
#: Texts of these characters are in normal form C, and lower case goes character by character.
_PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*").fullmatch
#: How the tokenizer's own pattern cuts a word of such a text in lower case.
_PARTS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+").findall


def _byte_letters() -> dict[str, int]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordEncoder(dict):
    """Little-endian unsigned 32-bit ids by word, as a cache that fills itself.

    The tokenizer cuts texts into words by a pattern and joins nothing over
    them, so a text's ids are its words' ids in order.  Words of Latin texts
    go to a merger of byte pairs that has the tokenizer's merges by rank: the
    byte 255, absent from UTF-8, stands for the end of a word, and joining it
    to the last byte comes before all merges.  A merge by rank of the joined
    bytes equals the tokenizer's merge by pair wherever every token encodes
    to itself; without that, and for all other texts, the tokenizer itself is
    asked.
    """

    def __init__(self, tokenizer_json: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        model, letters = json.loads(tokenizer_json)["model"], _byte_letters()
        suffix = model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            word = token.removesuffix(suffix)
            return bytes(letters[c] for c in word) + b"\xff" * (word != token)

        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        order = [c + suffix for c in letters] + merged + list(letters)
        ranks = {raw(t): i for i, t in enumerate(order)}
        self._ids = [np.array([model["vocab"][t]], "<u4").tobytes() for t in order]
        pairs = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})
        self._merge = pairs._core_bpe.encode_single_piece
        self._fast = len(ranks) == len(order) and self._all_stay([t for t in merged if t.endswith(suffix)], suffix)

    def _all_stay(self, tokens: list[str], suffix: str) -> bool:
        """Whether every token that ends a word is what the tokenizer's model makes of its letters."""
        from tokenizers import Tokenizer

        from tokenizers.models import BPE

        model = json.loads(self._tokenizer.to_str())["model"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        bare = Tokenizer(BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=suffix))
        found = bare.encode_batch_fast([t.removesuffix(suffix) for t in tokens], add_special_tokens=False)
        return all(e.ids == [model["vocab"][t]] for e, t in zip(found, tokens, strict=True))

    def __missing__(self, word: str) -> bytes:
        of, merge = self._ids, self._merge
        parts = [word] if word.isalpha() else _PARTS(word)
        ids = b"".join([of[r] for p in parts for r in merge(p.encode() + b"\xff")])
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self._fast and _PLAIN(text) and "<|" not in text:
            return b"".join(map(self.__getitem__, text.lower().split()))
        return self._whole(text)


_encoders: dict[int, WordEncoder] = {}


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, its end id included.

    A null text counts as empty: one piece, of the end id alone.  Repeated
    rows give their pieces again.  ``with_ids`` adds the ids themselves as
    little-endian unsigned 32-bit numbers.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(zlib.crc32(model.value.encode()))
        if encoder is None:
            encoder = _encoders[zlib.crc32(model.value.encode())] = WordEncoder(model.value)
        for whole in batches:
            for batch in byte_batches(whole, "text"):
                cols: list[list] = [[] for _ in schema]
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = encoder.encode(text or "") + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for c, v in zip(cols, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Lengths and how often each, with the largest sum that doesn't exceed room.

    Bit s of a bitset says that some combination sums to s.  A length
    available n times counts as items of 1, 2, 4, ... and the rest of them.
    """
    mask = (1 << (room + 1)) - 1
    reach, items, full = [1], [], 1 << room
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, many = min(counts[length], room // length), 1
        while left and not reach[-1] & full:
            take = min(many, left)
            items.append((length, take))
            reach.append((reach[-1] | (reach[-1] << (length * take))) & mask)
            left, many = left - take, many * 2
        if reach[-1] & full:
            break
    at, out = reach[-1].bit_length() - 1, {}
    for i in range(len(items) - 1, -1, -1):
        if not reach[i] >> at & 1:
            length, take = items[i]
            out[length] = out.get(length, 0) + take
            at -= length * take
    return sorted(out.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Rank intervals of each length with the sequence and offset of their first piece.

    Piece r of a length, first <= r < end, is in sequence
    ``sequence + r - first`` at ``offset``.
    """
    left = {k: v for k, v in counts.items() if v}
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        top = max(left)
        rest = left | {top: left[top] - 1}
        pattern = dict(fullest({k: v for k, v in rest.items() if v}, capacity - top))
        pattern[top] = pattern.get(top, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        offset = 0
        for length in sorted(pattern, reverse=True):
            for _ in range(pattern[length]):
                rows.append((length, used[length], used[length] + times, sequence, offset))
                used[length] += times
                offset += length
            left[length] -= pattern[length] * times
            if not left[length]:
                del left[length]
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "end", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Give every piece a sequence of at most ``capacity`` tokens and its gapless place there.

    Equal pieces are interchangeable; ties go by id, piece and checksum.  No
    pieces give no rows.
    """
    spark = pieces.sparkSession
    pieces = checkpoint(pieces)
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    rows = max(1, sum(counts.values()))
    group = max(GROUP_ROWS, -(-rows // MAX_GROUPS))
    salts = F.expr("cast(split('" + ",".join(str(-(-counts.get(k, 0) // group) or 1) for k in range(capacity + 1)) + "', ',') as array<bigint>)")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(salts, F.col("length").cast("int"))))
    # at most MAX_GROUPS groups and one for each length
    groups = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    w = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("r", F.row_number().over(w))
        .join(F.broadcast(groups), ["length", "salt"])
        .withColumn("rank", F.col("r") - 1 + F.col("before"))
        .drop("r", "before", "salt")
    )
    table = spark.sparkContext.broadcast(plan(counts, capacity))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = table.value
        lengths, first = p["length"].to_numpy(), p["first"].to_numpy()
        starts = np.searchsorted(lengths, np.arange(capacity + 2))
        for x in frames:
            at = np.empty(len(x), np.int64)
            size, rank = x["length"].to_numpy(), x["rank"].to_numpy()
            for k in np.unique(size):
                of = size == k
                at[of] = starts[k] + np.searchsorted(first[starts[k] : starts[k + 1]], rank[of], "right") - 1
            x["sequence_id"] = p["sequence"].to_numpy()[at] + rank - first[at]
            x["offset"] = p["offset"].to_numpy()[at]
            yield x[[*names, "sequence_id", "offset"]]

    return ranked.select(*names, F.col("rank").cast("long")).mapInPandas(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id), capacity)
