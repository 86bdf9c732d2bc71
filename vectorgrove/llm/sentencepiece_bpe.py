"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

Merging best pairs first is replaced by a search for the one token sequence
that merging could have produced.  An Aho-Corasick automaton over the pieces
gives the longest match at every place; a token may follow another only if
merging both their texts anew gives just these two (the pair is compatible);
places from which the rest failed are marked in a bitfield and not tried
again.  Tokens that merging never produces take no part.

Where no piece has a space mark or such a character behind a letter, no merge
crosses the end of a word, and texts are encoded in chunks that end with the
words, which are remembered.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vectorgrove.llm.common import byte_batches

SPACE = "▁"
#: Words of at most so many characters of which a worker keeps the ids, and as many from before, and pairs of tokens of which it keeps whether they fit; more only cost time.
CACHED_WORDS, LONG_WORD, CACHED_PAIRS = 300_000, 64, 400_000
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: In place of ids: a character outside the vocabulary, and no token.
_OTHER, _NONE = -1, -2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if key & 7 == 1 else (4, at) if key & 7 == 5 else _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """Pieces, scores, kinds and normaliser settings of a model file."""

    def __init__(self, data: bytes):
        import struct

        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        kind, self.byte_fallback, self.add_dummy_prefix, self.remove_extra_whitespaces, charsmap = 1, False, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                f = dict(_fields(value))
                kind, self.byte_fallback = f.get(3, 1), bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                charsmap, self.add_dummy_prefix = f.get(2, b""), bool(f.get(3, 1))
                self.remove_extra_whitespaces = bool(f.get(4, 1))
        if kind != 2 or charsmap or self.remove_extra_whitespaces or USER_DEFINED in self.kinds or UNUSED in self.kinds or not self.byte_fallback:
            raise ValueError("only merge-type models with byte fallback, identity normalisation and no pieces of users are supported")
        self.end_id = self.pieces.index("</s>")


class Codec:
    def __init__(self, model_bytes: bytes):
        import ahocorasick

        m = self.model = Model(model_bytes)
        self._id = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True)) if k == NORMAL}
        self._score = {p: m.scores[i] for p, i in self._id.items()}
        self._bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True)) if k == BYTE}
        self._piece_bytes = [b"" if k in (CONTROL,) else p.replace(SPACE, " ").encode() for p, k in zip(m.pieces, m.kinds, strict=True)]
        self._byte_of = {i: b for b, i in self._bytes.items()}
        self._special = {*self._byte_of, *(i for i, k in enumerate(m.kinds) if k == UNKNOWN)}
        self._control = {i for i, k in enumerate(m.kinds) if k == CONTROL}
        # single characters outside the vocabulary are symbols of their own that nothing merges with
        self._split: dict[str, tuple[str, str]] = {}
        tokens = []
        for p in sorted(self._id, key=len):
            if len(p) == 1 or self._merged(p):
                tokens.append(p)
        self._tokens = set(tokens)
        self._automaton = ahocorasick.Automaton()
        for p in tokens:
            self._automaton.add_word(p, self._id[p])
        self._automaton.make_automaton()
        #: By id, and _OTHER for a character outside the vocabulary: a token's length, and the longest token that is a shorter prefix of it.
        self._length = [len(p) for p in m.pieces] + [1]
        self._shorter = [_NONE] * (len(m.pieces) + 1)
        for p in tokens:
            self._shorter[self._id[p]] = next((self._id[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self._tokens), _NONE)
        #: Whether tokens may follow each other, by the first one's id times the number of pieces, plus the second one's.
        self._pairs: dict[int, bool] = {}
        #: When each token is made, by score; going back in time needs parts made before wholes.
        made = {p: self._score[p] for p in self._split if p in self._tokens}
        self._made = made.get
        self._ordered = all(s <= min(made.get(a, _NEVER), made.get(b, _NEVER)) for (a, b), s in ((self._split[p], s) for p, s in made.items()))
        self._chunks = self._chunk_pattern(tokens)
        #: Ids by chunk, for chunks of at most LONG_WORD characters.
        self._words: dict[str, list[int]] = {}
        #: The same, remembered before.
        self._older: dict[str, list[int]] = {}

    @staticmethod
    def _chunk_pattern(tokens: list[str]):
        """findall for chunks that no merge crosses, empty ones among them.

        A chunk begins with its space marks and ends before others, or behind
        a letter whose next character no token has behind a letter.
        """
        if any(SPACE in p.lstrip(SPACE) for p in tokens):
            return lambda text: [text]
        letter = re.compile(r"[^\W\d_]").match
        behind = {p[i + 1] for p in tokens for i in range(len(p) - 1) if letter(p[i]) and not letter(p[i + 1])}
        letters = r"[^\W\d_]*"
        other = f"(?:(?!{SPACE})[\\W\\d_])*"
        on = f"(?:[{''.join(map(re.escape, sorted(behind)))}]{other}{letters})*" if behind else ""
        return re.compile(f"{SPACE}*{other}{letters}{on}").findall

    def _merge(self, text: str) -> list[str]:
        """Best pair first, the leftmost of equals: the definition, for short texts."""
        symbols, score = list(text), self._score
        while len(symbols) > 1:
            best = max(((score.get(a + b), -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in score), default=None)
            if best is None:
                break
            i = -best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _merged(self, piece: str) -> bool:
        """Whether merging makes this piece of its characters; its last merge is noted."""
        symbols, score = list(piece), self._score
        while len(symbols) > 2:
            best = max(((score[a + b], -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in score), default=None)
            if best is None:
                return False
            i = -best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        self._split[piece] = (symbols[0], symbols[1])
        return True

    def _compatible(self, pair: int) -> bool:
        """Whether merging the texts of two tokens anew leaves both as they are."""
        if len(self._pairs) > CACHED_PAIRS:
            self._pairs.clear()
        left, right = (self.model.pieces[i] for i in divmod(pair, len(self.model.pieces)))
        known = self._pairs[pair] = self._unmerged(left, right) if self._ordered else self._merge(left + right) == [left, right]
        return known

    def _unmerged(self, left: str, right: str) -> bool:
        """The same, going back through the merges beside the boundary from the last one.

        Of two tokens the one of lower score was made later, with equal scores
        the right one.  A pair at the boundary would have been merged had it a
        better score than the merge that took one of its sides away, or an
        equal one and stood left of it.
        """
        score, split, made = self._score, self._split, self._made
        limit, leftmost = float("-inf"), True
        while True:
            s = score.get(left + right)
            if s is not None and (s > limit or s == limit and leftmost):
                return False
            a, b = made(left, _NEVER), made(right, _NEVER)
            if a == b == _NEVER:
                return True
            if a < b:
                limit, leftmost, left = a, False, split[left][1]
            else:
                limit, leftmost, right = b, True, split[right][0]

    def _tokens_of(self, text: str) -> list[int]:
        """Ids of the token sequence that merging makes; _OTHER for characters outside the vocabulary, which nothing merges with."""
        n, many = len(text), len(self.model.pieces)
        length, shorter, known = self._length, self._shorter, self._pairs.get
        longest = [_OTHER] * n
        for end, i in self._automaton.iter(text):
            # longer matches from a place end, and come, later
            longest[end + 1 - length[i]] = i
        failed, out, at, before = bytearray(n // 8 + 1), [], 0, _OTHER
        token = longest[0]
        while at < n:
            while token != _NONE:
                end = at + length[token]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if before == _OTHER or token == _OTHER:
                        break
                    pair = before * many + token
                    fits = known(pair)
                    if fits or fits is None and self._compatible(pair):
                        break
                token = shorter[token]
            if token != _NONE:
                out.append(token)
                at, before = end, token
                if at < n:
                    token = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError("no token sequence is compatible")
                token = out.pop()
                at -= length[token]
                token, before = shorter[token], out[-1] if out else _OTHER
        return out

    def _word(self, word: str) -> list[int]:
        if len(word) > LONG_WORD:
            return self._ids_of(word)
        if len(self._words) >= CACHED_WORDS:
            # the same dictionary goes on, as a text at hand looks into it
            self._older = dict(self._words)
            self._words.clear()
        ids = self._words[word] = self._older.get(word) or self._ids_of(word)
        return ids

    def _ids_of(self, word: str) -> list[int]:
        ids = self._tokens_of(word)
        if _OTHER in ids:
            tokens, ids, at = ids, [], 0
            for i in tokens:
                if i == _OTHER:
                    ids.extend(self._bytes[b] for b in word[at].encode())
                else:
                    ids.append(i)
                at += self._length[i]
        return ids

    def encode(self, text: str, end: bool = True) -> list[int]:
        """Ids of the whole text; an empty one has the end id only."""
        ids: list[int] = []
        if text:
            text = (" " if self.model.add_dummy_prefix else "") + text
            known, new = self._words.get, self._word
            ids.extend(chain.from_iterable([known(word) or new(word) for word in self._chunks(text.replace(" ", SPACE)) if word]))
        if end:
            ids.append(self.model.end_id)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids are left out, bytes that form no character become U+FFFD each, and the space put in front goes."""
        of = self._piece_bytes
        first = next((i for i in ids if i not in self._control), None)
        cut = int(self.model.add_dummy_prefix and first is not None and first not in self._special and of[first][:1] == b" ")
        if self._special.isdisjoint(ids):
            out = b"".join([of[i] for i in ids]).decode()
        else:
            parts: list[str] = []
            run = bytearray()
            for i in ids:
                b = self._byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(_lenient(bytes(run)))
                    run.clear()
                parts.append(" ⁇ " if i in self._special else of[i].decode())
            if run:
                parts.append(_lenient(bytes(run)))
            out = "".join(parts)
        return out[cut:]


_NEVER = float("inf")


def _lenient(data: bytes) -> str:
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[: e.start].decode() + "�")
            data = data[e.start + 1 :]
    return "".join(out)


_codecs: dict[int, Codec] = {}


def codec_of(model: bytes) -> Codec:
    key = zlib.crc32(model)
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every text (null: empty), decode the ids again, and return digests of both; ``with_ids`` adds the ids.

    Texts of any length are encoded whole.  Repeated rows give repeated
    results, an empty table gives none, and a null id stays null.  Columns but
    the two named are not read, whatever their names.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = DIGEST.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else DIGEST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = codec_of(model.value), hashlib.sha256
        decimal = [str(i) for i in range(len(codec.model.pieces))]
        for whole in batches:
            for b in byte_batches(whole, "text"):
                rows = []
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    ids = codec.encode(text or "")
                    row = (doc_id, len(ids), sha(" ".join([decimal[i] for i in ids]).encode()).hexdigest(), sha(codec.decode(ids).encode()).hexdigest())
                    rows.append((*row, ids) if with_ids else row)
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    spec = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, spec)
