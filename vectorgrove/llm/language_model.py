"""Language-model scoring by deleted interpolation.

The chance of a word behind another is a mixture of its share among the
words seen there, its share in the corpus, and a uniform chance for words
never seen.  Mixture weights depend on how often the word before was seen (by
buckets of doubling counts) and are learned by expectation maximisation on
held-out counts: a fold of the training documents whose words are scored by
counts of the other training documents.  Scores then use all training
documents.

Documents are tokenised once, into chunks that keep word numbers in place of
texts.  Words travel as 64-bit hashes (some of n words share one with a chance
of about n^2 / 2^65) to owners, which add the counts of all chunks up and give
words that several chunks have an id.  Pairs travel as exact pairs of ids, in
a row for each chunk and word before; a very common word before has a row for
each residue of the ids behind it, so that no owner adds up more than about
SUB_COUNT occurrences at a time.  Pairs with a word that only one chunk has
are counted there.  Owners answer with totals, in 64 bits, where these differ
from the chunk's own, many words before in a row where they go to the same
chunk.  Rows are at most as many as words and pairs, however many chunks and
owners there are, and no table of the corpus's n-grams is sent
to the driver or to every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from vectorgrove.llm.common import byte_batches, checkpoint, checkpoint_dealt, fold

#: Text that a chunk holds, at most, but for a longer document.
CHUNK_BYTES = 8_000_000
#: Words that an owner adds up at a time, about.
PART_ROWS = 500_000
#: Occurrences of a word before that its owner adds up at a time, about.
SUB_COUNT = 200_000
#: Totals, and their bytes, that are looked through at a time for those that go to the same chunk.
JOINED_ROWS = 200_000
JOINED_BYTES = 8_000_000
_SUB_BITS = 24
BUCKETS = 16
#: For learning the mixture weights, ratios of the two shares are counted in bins of this many to a factor of e.
BINS_PER_E = 8
_LOG_RANGE = 40
ROUNDS = 40
PRIOR = (0.4, 0.5, 0.1)

#: A token of its own kind: words are bytes.
END = "end"


def words_of(text: str) -> list:
    """A-Z in lower case, cut at ASCII white space (what bytes take for that), then the end."""
    return [*text.encode().lower().split(), END]


def _hash_word(word: bytes | str) -> int:
    return xxhash.xxh64_intdigest(word, 1) if word is END else xxhash.xxh64_intdigest(word)


def pack(a: np.ndarray) -> bytes:
    """64-bit numbers, compressed byte by byte of their places."""
    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.int64)


def varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in groups of seven bits, the lowest first, and where each ends."""
    x = x.astype(np.uint64)
    size = np.ones(len(x), np.int64)
    top = int(x.max(initial=0))
    for k in range(1, 10):
        if top >> 7 * k:
            size += x >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(x) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        low = (x[has] >> np.uint64(7 * k)).astype(np.uint8) & 127
        out[(ends - size)[has] + k] = low | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return out, ends


def unvarint(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and the place of each one's last byte."""
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1]).astype(np.int64) if len(last) else last
    size = last - first + 1
    x = np.zeros(len(last), np.uint64)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        x[has] |= (raw[first[has] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return x.astype(np.int64), last


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An array of the slices of some bytes."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _bytes_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of binary values, and where each begins and the last one ends."""
    _, offsets, values = a.buffers()
    at = np.frombuffer(offsets, np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    raw = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if values is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


class _Numbers(dict):
    def __missing__(self, word: bytes | str) -> int:
        n = self[word] = len(self)
        return n


class _Builder:
    """Documents of one chunk as they come."""

    def __init__(self) -> None:
        self.known, self.ids, self.folds, self.tokens, self.size = _Numbers(), [], [], [], 0

    def add(self, doc_id: int | None, of_fold: int, text: str) -> None:
        words = words_of(text)
        self.tokens.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))
        self.ids.append(doc_id)
        self.folds.append(of_fold)
        self.size += len(text)

    def row(self) -> tuple[bytes, bytes, bytes]:
        """Documents, hashes of the words by falling count, and the documents' words by number."""
        lengths = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        word = np.concatenate(self.tokens)
        order = np.argsort(-np.bincount(word), kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        hashes = np.fromiter(map(_hash_word, self.known), np.uint64, len(self.known))[order]
        valid = np.array([i is not None for i in self.ids], np.int64)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        return pack(np.concatenate([valid, ids, np.array(self.folds, np.int64), lengths])), hashes.tobytes(), zstandard.compress(number[word].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


CHUNKS = pa.schema([("chunk", pa.int64()), ("documents", pa.binary()), ("words", pa.binary()), ("tokens", pa.binary())])


def chunked(docs: DataFrame, folds: int, learning: int, chunk_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """Tokenised documents; those of the fold for mixture weights have chunks of their own, of odd numbers."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), fold(id_col, folds).cast("int").alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held = [_Builder(), _Builder()]

        def flush(odd: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            row = (number * 2 + odd, *held[odd].row())
            held[odd] = _Builder()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, CHUNKS, strict=True)], schema=CHUNKS)

        for whole in batches:
            for b in byte_batches(whole, "text"):
                for doc_id, text, of_fold in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True):
                    odd = int(of_fold == learning)
                    if held[odd].ids and held[odd].size + len(text) > chunk_bytes:
                        yield flush(odd)
                    held[odd].add(doc_id, of_fold, text)
        for odd in (0, 1):
            if held[odd].ids:
                yield flush(odd)

    return rows.mapInArrow(run, "chunk long, documents binary, words binary, tokens binary")


class Chunk:
    """A chunk's documents in one row of word numbers, and its distinct pairs in order of their codes."""

    def __init__(self, row: dict, held_out: int, pairs: bool = True):
        self.chunk = row["chunk"]
        self.hashes = np.frombuffer(row["words"], np.uint64)
        self.valid, self.ids, self.folds, self.lengths = unpack(row["documents"]).reshape(4, -1)
        planes = np.frombuffer(zstandard.decompress(row["tokens"]), np.uint8).reshape(4, -1)
        self.word = np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.training = np.repeat(self.folds != held_out, self.lengths)
        n = self.n_words = len(self.hashes)
        self.counts = np.bincount(self.word[self.training], minlength=n)
        #: order in which words are sent to their owners
        self.by_hash = np.argsort(self.hashes, kind="stable")
        if not pairs:
            return
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        # in front of the first word stands the end of the text before
        self.before[self.starts] = int(np.flatnonzero(self.hashes == np.uint64(_hash_word(END)))[0])
        codes, self.pair = np.unique(self.before * n + self.word, return_inverse=True)
        self.pair_before, self.pair_word = codes // n, codes % n
        self.pair_counts = np.bincount(self.pair[self.training], minlength=len(codes))

    def word_rows(self, parts: int) -> list[tuple[int, int, bytes, bytes]]:
        """part, chunk, hashes and counts for each owner of some of the words."""
        hashes, counts = self.hashes[self.by_hash], self.counts[self.by_hash]
        part = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        return [(int(part[a]), self.chunk, pack(np.diff(hashes[a:b], prepend=np.uint64(0))), pack(counts[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def answered(self, answers: list[tuple[int, bytes]]) -> None:
        """Take ids (-1: no other chunk has the word), and counts in all training documents and in the learning ones."""
        found = [unpack(data).reshape(3, -1) for _, data in sorted(answers)]
        self.word_id, self.total, self.learning = (np.empty(self.n_words, np.int64) for _ in range(3))
        for of, got in zip((self.word_id, self.total, self.learning), np.concatenate(found, axis=1), strict=True):
            of[self.by_hash] = got

    def sent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the pairs sent to owners, in order; their keys; and the numbers of their words behind, by which each key is in order."""
        at = np.flatnonzero((self.word_id[self.pair_before] >= 0) & (self.word_id[self.pair_word] >= 0))
        of, behind = self.pair_before[at], self.word_id[self.pair_word[at]]
        subs = 1 + self.total[of] // SUB_COUNT
        if int(subs.max(initial=0)) >> _SUB_BITS or int(self.word_id.max(initial=0)) >> 63 - _SUB_BITS:
            raise OverflowError("more words, or occurrences of one, than keys can tell apart")
        key = self.word_id[of] << _SUB_BITS | behind % subs
        order = np.lexsort((behind, key))
        return at[order], key[order], (behind // subs)[order]


PAIRS = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary())])


def pair_rows(c: Chunk) -> pa.Table:
    """A row for each key: gaps between the words behind, then their counts."""
    at, key, behind = c.sent()
    if not len(at):
        return PAIRS.empty_table()
    starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    gaps = np.diff(behind, prepend=0)
    gaps[starts] = behind[starts]
    flat = np.empty(2 * len(key), np.int64)
    row = np.repeat(np.arange(len(starts)), sizes)
    # a row's gaps are followed by its counts
    place = np.arange(len(key)) + starts[row]
    flat[place], flat[place + sizes[row]] = gaps, c.pair_counts[at]
    raw, ends = varints(flat)
    return pa.Table.from_arrays([pa.array(key[starts]), pa.array(np.full(len(starts), c.chunk)), _binary(raw, ends[2 * np.cumsum(sizes) - 1])], schema=PAIRS)


ANSWERS = pa.schema([("chunk", pa.int64()), ("key", pa.int64()), ("data", pa.binary())])


def pair_totals(rows: pa.Table) -> pa.Table:
    """Totals for rows in order of their keys, in which a key has all its rows; for chunks of learning documents, those in such documents behind.

    A row whose totals are what it has gets no answer.
    """
    key, chunk = rows.column("key").to_numpy(), rows.column("chunk").to_numpy()
    raw, at = _bytes_of(rows.column("data").combine_chunks() if isinstance(rows.column("data"), pa.ChunkedArray) else rows.column("data"))
    x, last = unvarint(raw)
    first = np.searchsorted(last, at[:-1])
    sizes = (np.searchsorted(last, at[1:]) - first) // 2
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(key)), sizes)
    place = first[row] + np.arange(len(row)) - starts[row]
    gaps, n = x[place], x[place + sizes[row]]
    word = np.cumsum(gaps)
    word -= (word[starts] - gaps[starts])[row]
    group = np.cumsum(np.concatenate([[0], np.diff(key) != 0]))[row]
    order = np.lexsort((word, group))
    new = np.concatenate([[True], (np.diff(word[order]) != 0) | (np.diff(group[order]) != 0)])
    heads, of = np.flatnonzero(new), np.cumsum(new) - 1
    odd = chunk & 1
    total, learning = np.empty_like(n), np.empty_like(n)
    total[order] = np.add.reduceat(n[order], heads)[of]
    learning[order] = np.add.reduceat((n * odd[row])[order], heads)[of]
    differs = np.bitwise_or.reduceat((total != n) | (odd[row] == 1) & (learning != n), starts)
    kept = np.flatnonzero(differs)
    if not len(kept):
        return ANSWERS.empty_table()
    inside = differs[row]
    out_sizes = sizes[kept] * (1 + odd[kept])
    out_starts = np.cumsum(out_sizes) - out_sizes
    back = np.cumsum(differs) - 1
    place = out_starts[back[row[inside]]] + (np.arange(len(row)) - starts[row])[inside]
    flat = np.empty(int(out_sizes.sum()), np.int64)
    flat[place] = total[inside]
    both = odd[row[inside]] == 1
    flat[(place + sizes[row[inside]])[both]] = learning[inside][both]
    raw, ends = varints(flat)
    return pa.Table.from_arrays([pa.array(chunk[kept]), pa.array(key[kept]), _binary(raw, ends[np.cumsum(out_sizes) - 1])], schema=ANSWERS)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pair_totals of a partition sorted by key, some keys at a time."""
    held: list[pa.RecordBatch] = []
    for whole in batches:
        for b in byte_batches(whole, "data"):
            key = b.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if held and (cut or key[0] != held[-1].column("key")[0].as_py()):
                # the last key's rows may go on in the next batch
                yield from pair_totals(pa.Table.from_batches([*held, b.slice(0, cut)])).to_batches()
                held = []
            elif cut:
                yield from pair_totals(pa.Table.from_batches([b.slice(0, cut)])).to_batches()
            held.append(b.slice(cut))
    if held:
        yield from pair_totals(pa.Table.from_batches(held)).to_batches()


JOINED = pa.schema([("chunk", pa.int64()), ("keys", pa.binary()), ("lengths", pa.binary()), ("data", pa.binary())])


def joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Totals in order of their keys, a row for each chunk of some of them: gaps between keys, bytes that each has, and these bytes."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        size += b.nbytes
        if rows >= most or size >= JOINED_BYTES:
            yield _joined(held)
            held, rows, size = [], 0, 0
    if rows:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).combine_chunks()
    t = t.take(np.argsort(t.column("chunk").to_numpy(), kind="stable"))
    chunk, key = t.column("chunk").to_numpy(), t.column("key").to_numpy()
    raw, at = _bytes_of(t.column("data").combine_chunks())
    starts = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1])
    ends = np.concatenate([starts[1:], [len(key)]])
    gaps = np.diff(key, prepend=0)
    gaps[starts] = key[starts]
    keys, key_ends = varints(gaps)
    lengths, length_ends = varints(np.diff(at))
    return pa.RecordBatch.from_arrays([pa.array(chunk[starts]), _binary(keys, key_ends[ends - 1]), _binary(lengths, length_ends[ends - 1]), _binary(raw, at[ends])], schema=JOINED)


def apart(rows: pa.Table) -> pa.Table:
    """The keys and data of joined rows, a row for each key."""
    raw, at = _bytes_of(rows.column("keys").combine_chunks())
    gaps, last = unvarint(raw)
    starts = np.searchsorted(last, at[:-1])
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(gaps))))
    key = np.cumsum(gaps)
    key -= (key[starts] - gaps[starts])[row]
    lengths, _ = unvarint(_bytes_of(rows.column("lengths").combine_chunks())[0])
    raw, _ = _bytes_of(rows.column("data").combine_chunks())
    return pa.table({"key": key, "data": _binary(raw, np.cumsum(lengths))})


WORD_ANSWERS = "chunk long, part int, data binary, n long, v long, n_learning long, v_learning long"


def word_totals(rows: pd.DataFrame, parts: int) -> pd.DataFrame:
    """Ids and totals of an owner's words for each chunk that has some of them, and a row of sums over the words."""
    part = int(rows["part"].iloc[0])
    hashes = [np.cumsum(unpack(h).view(np.uint64)) for h in rows["hashes"]]
    counts = np.concatenate([unpack(c) for c in rows["counts"]])
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    odd = np.repeat(rows["chunk"].to_numpy() & 1, sizes)
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    new = np.concatenate([[True], np.diff(every[order]) != 0])
    heads, of = np.flatnonzero(new), np.empty(len(every), np.int64)
    of[order] = np.cumsum(new) - 1
    total = np.add.reduceat(counts[order], heads)
    learning = np.add.reduceat((counts * odd)[order], heads)
    chunks = np.diff(np.concatenate([heads, [len(every)]]))
    # common words have small ids, which makes the gaps between ids small
    ids = np.empty(len(total), np.int64)
    ids[np.argsort(-total, kind="stable")] = np.arange(len(total)) * parts + part
    ids[chunks < 2] = -1
    out, at = [], 0
    for chunk, size in zip(rows["chunk"], sizes, strict=True):
        here = of[at : at + size]
        out.append((int(chunk), part, pack(np.concatenate([ids[here], total[here], learning[here]])), None, None, None, None))
        at += size
    rest = total - learning
    out.append((None, part, None, int(total.sum()), int((total > 0).sum()), int(rest.sum()), int((rest > 0).sum())))
    frame = pd.DataFrame(out, columns=["chunk", "part", "data", "n", "v", "n_learning", "v_learning"])
    return frame.astype({c: "Int64" for c in ("chunk", "n", "v", "n_learning", "v_learning")})


def _met(left: pa.Table, right: pa.Table, held_out: int) -> Chunk | None:
    """A chunk with its answers."""
    if not left.num_rows:
        return None
    c = Chunk(left.to_pylist()[0], held_out)
    part = right.column("part").combine_chunks()
    words = right.filter(part.is_valid())
    c.answered(list(zip(words.column("part").to_pylist(), words.column("data").to_pylist(), strict=True)))
    own = c.pair_counts
    c.pair_total, c.pair_learning = own.copy(), own if c.chunk & 1 else np.zeros_like(own)
    pairs = right.filter(part.is_null())
    if pairs.num_rows:
        pairs = apart(pairs) if "keys" in pairs.column_names else pairs
        c.pair_learning = c.pair_learning.copy()
        at, key, _ = c.sent()
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        raw, cuts = _bytes_of(pairs.column("data").combine_chunks())
        x, last = unvarint(raw)
        first = np.searchsorted(last, cuts[:-1])
        run = np.searchsorted(key[starts], pairs.column("key").to_numpy())
        row = np.repeat(np.arange(len(run)), sizes[run])
        inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes[run]) - sizes[run], sizes[run])
        to = at[starts[run][row] + inside]
        c.pair_total[to] = x[first[row] + inside]
        if c.chunk & 1:
            c.pair_learning[to] = x[first[row] + sizes[run][row] + inside]
    return c


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then one for each doubling of their count."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def shares(pair: np.ndarray, context: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token, from its counts: its share behind the word before and in the corpus, and its bucket."""
    return np.where(context > 0, pair / np.maximum(context, 1), 0.0), own / max(n, 1), bucket_of(context)


def binned(share: np.ndarray, floor: float) -> np.ndarray:
    """0 for nothing, then bins of the logarithm against the uniform chance."""
    steps = np.log(np.maximum(share, 1e-300) / floor) * BINS_PER_E
    return np.where(share > 0, 1 + np.clip(steps, 0, _LOG_RANGE * BINS_PER_E), 0).astype(np.int64)


def mixture(bins: pd.DataFrame, v: int) -> np.ndarray:
    """Weights (pair, word, uniform) for each bucket, by expectation maximisation on binned held-out counts."""
    weights = np.tile(PRIOR, (BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    if not len(bins):
        return weights
    bucket, count = bins["bucket"].to_numpy(), bins["n"].to_numpy(np.float64)
    p = np.column_stack([bins["p2"].to_numpy() / count, bins["p1"].to_numpy() / count, np.full(len(bins), 1 / (v + 1))])
    prior = np.array(PRIOR)
    for _ in range(ROUNDS):
        share = weights[bucket] * p
        share /= share.sum(1, keepdims=True)
        for b in range(BUCKETS):
            here = bucket == b
            seen = (share[here] * count[here, None]).sum(0) + prior * (1 if b else np.array([0.0, 1, 1]))
            weights[b] = seen / seen.sum()
    return weights


SCORES = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)
BINS = pa.schema([("bucket", pa.int32()), ("bin", pa.int32()), ("n", pa.int64()), ("p2", pa.float64()), ("p1", pa.float64())])


def score_documents(
    docs: DataFrame, folds: int = 7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Scores of whole texts under unigrams with one added to counts (base) and under the interpolated model.

    Documents of fold ``held_out`` add nothing to the counts; those of the
    fold behind it are the held-out counts of the mixture.  A null text counts
    as empty: its one token is the end.  A null id counts as an empty text for
    its fold.  Repeated rows count and are scored each, and ties change
    nothing.  Without training documents the uniform chance is left; an empty
    table gives no rows.  A long text may fill a chunk of its own.  Columns
    but the two named are not read, whatever their names.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    at_least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunked(docs, folds, (held_out + 1) % folds, chunk_bytes, id_col, text_col)
    # chunks stay where they are while answers come to them
    chunks = checkpoint_dealt(chunks, max(at_least, -(-size // chunk_bytes)), "chunk")
    words = chunks.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0] // 8
    parts = max(1, -(-words // PART_ROWS))

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                cols = zip(*Chunk(row, held_out, pairs=False).word_rows(parts), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "chunk", "hashes", "counts"])

    sent = chunks.mapInArrow(send_words, "part int, chunk long, hashes binary, counts binary")
    answers = checkpoint(sent.groupBy("part").applyInPandas(lambda rows: word_totals(rows, parts), WORD_ANSWERS))
    sums = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "n_learning", "v_learning"))).first()
    n, v, n_learn, v_learn = (int(x) for x in sums)
    answers = answers.where("chunk IS NOT NULL").select("chunk", "part", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("lengths"), "data")

    def send_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return PAIRS.empty_table()
        c = Chunk(left.to_pylist()[0], held_out)
        c.answered(list(zip(right.column("part").to_pylist(), right.column("data").to_pylist(), strict=True)))
        return pair_rows(c)

    pairs = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(send_pairs, "key long, chunk long, data binary")
    most = JOINED_ROWS
    totals = checkpoint(pairs.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: joined(_summed(batches), most), "chunk long, keys binary, lengths binary, data binary"))
    answers = answers.unionByName(totals.withColumn("part", F.lit(None).cast("int")))

    def learn(left: pa.Table, right: pa.Table) -> pa.Table:
        c = _met(left, right, held_out)
        if c is None:
            return BINS.empty_table()
        rest = c.total - c.learning
        p2, p1, bucket = shares((c.pair_total - c.pair_learning)[c.pair], rest[c.before], rest[c.word], n_learn)
        floor = 1 / (v_learn + 1)
        found, at = np.unique(bucket.astype(np.int64) << 20 | binned(p2, floor) << 10 | binned(p1, floor), return_inverse=True)
        return pa.Table.from_arrays([pa.array((found >> 20).astype(np.int32)), pa.array((found & (1 << 20) - 1).astype(np.int32)), pa.array(np.bincount(at)), pa.array(np.bincount(at, p2)), pa.array(np.bincount(at, p1))], schema=BINS)

    odd = F.col("chunk") % 2 == 1
    learned = chunks.where(odd).groupBy("chunk").cogroup(answers.where(odd).groupBy("chunk")).applyInArrow(learn, "bucket int, bin int, n long, p2 double, p1 double")
    # bins are bounded in number, whatever the corpus
    bins = learned.groupBy("bucket", "bin").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1")).toPandas()
    weights = mixture(bins.sort_values(["bucket", "bin"], ignore_index=True), v_learn)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        c = _met(left, right, held_out)
        if c is None:
            return SCORES.empty_table()
        own = c.total[c.word]
        p2, p1, bucket = shares(c.pair_total[c.pair], c.total[c.before], own, n)
        w = weights[bucket]
        columns = (
            pa.array(c.ids, mask=c.valid == 0), pa.array(c.folds == held_out), pa.array(c.lengths), pa.array(np.add.reduceat((own > 0).astype(np.int64), c.starts)),
            pa.array(np.full(len(c.ids), n)), pa.array(np.add.reduceat(np.log10((own + 1) / (n + v + 1)), c.starts)),
            pa.array(np.add.reduceat(np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v + 1)), c.starts)),
        )
        return pa.Table.from_arrays(list(columns), schema=SCORES)

    spec = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, spec)
