"""MPEG audio columns: an encoder and a parser for layer III streams.

The encoder stores any bytes losslessly as a valid stream.  Each 576 bytes,
one for each sample of a frame of MPEG-2 layer III at 16 kHz in mono, travel
as ancillary data behind side information that announces no coded audio, so
that players hear silence.  Trailing 255s of a frame's bytes are left out and
come back when read, and each frame has the lowest bitrate that holds the
rest: the stream has a variable bitrate, a table frame in front with frame
count, byte count and seek points, a checksum in every frame, and tags.

The parser takes any stream: it skips and reads tags (ID3v2, ID3v1), finds
frame headers again after junk by asking for a second header where the first
one ends, verifies checksums (layers I and III; those of layer II are counted
as unverified), reads variable-bitrate tables (Xing, Info, VBRI), and sums up
durations as exact numbers of samples at each rate.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vectorgrove.llm.common import byte_batches

# Fixed values of the format (ISO/IEC 11172-3 and 13818-3): kbit/s by bitrate index 1 to 14.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Fixed values of the format: Hz by version (1, 2, and 2.5 as 3) and rate index.
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 3: (11025, 12000, 8000)}
VERSIONS = {0: 3, 2: 2, 3: 1}
LAYERS = {1: 3, 2: 2, 3: 1}

SAMPLES = 576
RATE = 16000
_OVERHEAD = 4 + 2 + 9  # header, checksum, side information of MPEG-2 mono


@dataclass(slots=True)
class Header:
    version: int
    layer: int
    protected: bool
    bitrate: int
    rate: int
    padding: int
    mono: bool
    length: int
    samples: int


def parse_header(word: int) -> Header | None:
    """The header in a big-endian 32-bit number, or None.  Free-format streams aren't supported."""
    if word >> 21 != 0x7FF:
        return None
    version, layer = VERSIONS.get(word >> 19 & 3), LAYERS.get(word >> 17 & 3)
    index, rate_index, padding = word >> 12 & 15, word >> 10 & 3, word >> 9 & 1
    if version is None or layer is None or index in (0, 15) or rate_index == 3 or word & 3 == 2:
        return None
    bitrate = BITRATES[min(version, 2), layer][index - 1] * 1000
    rate = RATES[version][rate_index]
    if layer == 1:
        length, samples = (12 * bitrate // rate + padding) * 4, 384
    else:
        samples = 576 if layer == 3 and version > 1 else 1152
        length = samples // 8 * bitrate // rate + padding
    return Header(version, layer, not word >> 16 & 1, bitrate, rate, padding, word >> 6 & 3 == 3, length, samples)


_headers: dict[int, Header | None] = {}


def header(word: int) -> Header | None:
    """parse_header with a memory; a stream has few different headers."""
    found = _headers.get(word, False)
    if found is False:
        if len(_headers) > 65_536:
            _headers.clear()
        found = _headers[word] = parse_header(word)
    return found


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ (0x8005 if crc & 0x8000 else 0)) & 0xFFFF
        table.append(crc)
    return table


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The format's checksum: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for b in data:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ b]
    return crc


def side_length(h: Header) -> int:
    return (17 if h.mono else 32) if h.version == 1 else (9 if h.mono else 17)


def _protected_length(h: Header) -> int | None:
    """Bytes behind the checksum that it covers; None for layer II, where that depends on the allocation."""
    if h.layer == 3:
        return side_length(h)
    return (16 if h.mono else 32) if h.layer == 1 else None


def _frame_heads() -> list[tuple[int, int, bytes]]:
    """By bitrate: capacity for payload, frame length, and the fixed start of a frame."""
    heads = []
    for i, kbits in enumerate(BITRATES[2, 3], 1):
        word = 0x7FF << 21 | 2 << 19 | 1 << 17 | 0 << 16 | i << 12 | 2 << 10 | 3 << 6
        raw = struct.pack(">I", word)
        length = SAMPLES // 8 * kbits * 1000 // RATE
        if length >= _OVERHEAD:
            side = bytes(9)
            heads.append((length - _OVERHEAD, length, raw + struct.pack(">H", crc16(raw[2:] + side)) + side))
    return heads


_HEADS = _frame_heads()
_ROOM = np.array([h[0] for h in _HEADS])


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _text_frame(name: bytes, text: str) -> bytes:
    body = b"\x03" + text.encode()
    return name + _synchsafe(len(body)) + b"\x00\x00" + body


def payload_of(text: bytes) -> bytes:
    """The bytes with 255s behind, up to a positive multiple of SAMPLES."""
    return text + b"\xff" * (max(1, -(-len(text) // SAMPLES)) * SAMPLES - len(text))


def encode(payload: bytes, unpadded: int) -> bytes:
    """A tagged stream with variable bitrate that holds the payload, whose length is a multiple of SAMPLES."""
    frames = []
    for at in range(0, len(payload), SAMPLES):
        part = payload[at : at + SAMPLES].rstrip(b"\xff")
        # the last byte kept counts, so that a part's end can be told from stuffing
        room, _, head = _HEADS[int(np.searchsorted(_ROOM, len(part) + 1))]
        frames.append(head + part + b"\xff" * (room - len(part)))
    lengths = np.fromiter(map(len, frames), np.int64, len(frames))
    room, length, head = next(h for h in _HEADS if h[0] >= 120)
    total = length + int(lengths.sum())
    starts = length + np.concatenate([[0], np.cumsum(lengths)[:-1]])
    toc = bytes(int(starts[len(frames) * i // 100]) * 256 // total for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    tag = _text_frame(b"TLEN", str(len(payload) * 1000 // RATE)) + _text_frame(b"TXXX", f"payload\x00{unpadded}")
    front = b"ID3\x04\x00\x00" + _synchsafe(len(tag)) + tag
    return front + head + table + bytes(room - len(table)) + b"".join(frames) + b"TAG" + b"payload".ljust(125, b"\x00")


@dataclass(slots=True)
class Stream:
    """What a parsed stream holds."""

    tags: dict[str, str] = field(default_factory=dict)
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    frames: int = 0
    crc_ok: int = 0
    crc_bad: int = 0
    crc_unverified: int = 0
    junk: int = 0
    samples: dict[int, int] = field(default_factory=dict)
    bitrates: dict[int, int] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    payload: bytes = b""


def _id3v2(data: bytes, out: Stream) -> int:
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    size = sum((b & 127) << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
    at, end = 10, min(len(data), 10 + size)
    while at + 10 <= end and data[at : at + 4].isalnum():
        n = int.from_bytes(data[at + 4 : at + 8]) if data[3] < 4 else sum((b & 127) << s for b, s in zip(data[at + 4 : at + 8], (21, 14, 7, 0), strict=True))
        name, body = data[at : at + 4].decode("ascii"), data[at + 10 : min(end, at + 10 + n)]
        if name[0] == "T" and body:
            coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8")
            key, _, value = body[1:].decode(coding, "replace").rstrip("\x00").rpartition("\x00")
            out.tags[f"{name}:{key}" if key else name] = value
        at += 10 + n
    return 10 + size + (10 if data[5] & 16 else 0)


def _table(frame: bytes, h: Header, out: Stream) -> bool:
    """Whether the frame is a variable-bitrate table, which is then read."""
    if h.layer != 3:
        return False
    at = 4 + 2 * h.protected + side_length(h)
    name = frame[at : at + 4]
    if name in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags, at = int.from_bytes(frame[at + 4 : at + 8]), at + 8
        out.table = name.decode()
        for bit, attr in ((1, "table_frames"), (2, "table_bytes")):
            if flags & bit:
                setattr(out, attr, int.from_bytes(frame[at : at + 4]))
                at += 4
        if flags & 4:
            out.toc = frame[at : at + 100]
        return True
    if frame[36:40] == b"VBRI" and len(frame) >= 54:
        out.table = "VBRI"
        out.table_bytes, out.table_frames = struct.unpack(">II", frame[46:54])
        return True
    return False


def parse(data: bytes, confirm: bool = True) -> Stream:
    """Read a stream; a header counts where another one, or the end, follows its frame.

    Bytes that belong to no frame or tag count as junk; a frame cut off by
    the end of data isn't counted.  Never fails: what isn't a stream has no
    frames.
    """
    out = Stream()
    at = _id3v2(data, out)
    end = len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags.setdefault("TITLE", data[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1"))
    parts, synced, first = [], False, True
    unpack = struct.Struct(">I").unpack_from
    while at + 4 <= end:
        h = header(unpack(data, at)[0])
        after = at + h.length if h else 0
        if h and not synced and confirm and after + 4 <= end and header(unpack(data, after)[0]) is None:
            h = None
        if h is None or after > end:
            sync = data.find(b"\xff", at + 1, end)
            sync = end if sync < 0 else sync
            out.junk += sync - at
            at, synced = sync, False
            continue
        synced = True
        frame = data[at:after]
        if h.protected:
            n = _protected_length(h)
            if n is None:
                out.crc_unverified += 1
            elif crc16(frame[2:4] + frame[6 : 6 + n]) == int.from_bytes(frame[4:6]):
                out.crc_ok += 1
            else:
                out.crc_bad += 1
        if not (first and _table(frame, h, out)):
            out.frames += 1
            out.offsets.append(at)
            out.samples[h.rate] = out.samples.get(h.rate, 0) + h.samples
            out.bitrates[h.bitrate] = out.bitrates.get(h.bitrate, 0) + 1
            if h.layer == 3 and h.version > 1:
                parts.append(frame[4 + 2 * h.protected + side_length(h) :])
        at, first = after, False
    out.junk += max(0, end - at)
    out.payload = b"".join(p.rstrip(b"\xff")[:SAMPLES].ljust(SAMPLES, b"\xff") for p in parts)
    return out


def feature(s: Stream) -> str:
    """Exact durations as samples@rate, frames by bitrate, checksums, the table, and a checksum of the seek offsets."""
    return ";".join(
        (
            f"frames={s.frames}",
            "duration=" + ",".join(f"{n}@{rate}" for rate, n in sorted(s.samples.items())),
            "bitrates=" + ",".join(f"{b // 1000}:{n}" for b, n in sorted(s.bitrates.items())),
            f"crc={s.crc_ok}/{s.crc_bad}/{s.crc_unverified}",
            f"table={s.table}:{s.table_frames}:{s.table_bytes}:{zlib.crc32(s.toc)}",
            f"seek={zlib.crc32(np.array(s.offsets, '<u8').tobytes())}",
            f"junk={s.junk}",
            "tags=" + ",".join(f"{k}={v}" for k, v in sorted(s.tags.items())),
        )
    ).replace("\x00", " ")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media: each text (null: empty) as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_batches(whole, "text"):
                media = []
                for text in b.column("text").to_pylist():
                    raw = (text or "").encode()
                    media.append(encode(payload_of(raw), len(raw)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


READ = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
        ("n_frames", pa.int64()), ("duration_samples", pa.int64()), ("sample_rate", pa.int32()),
    ]
)


def read(media: DataFrame, media_col: str = "media", with_offsets: bool = False) -> DataFrame:
    """Parse stored streams; ``with_offsets`` adds every frame's seek offset.

    Null media counts as an empty stream.  The unpadded length comes from the
    stream's own tag, and is that of the payload where there is none.
    """
    schema = READ.append(pa.field("seek_offsets", pa.list_(pa.int64()))) if with_offsets else READ

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_batches(whole, "media"):
                rows = []
                for doc_id, data in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist(), strict=True):
                    data = data or b""
                    s = parse(data)
                    n = s.tags.get("TXXX:payload", "")
                    rate = next(iter(s.samples)) if len(s.samples) == 1 else None
                    row = (
                        doc_id, int(n) if n.isdecimal() else len(s.payload), len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]),
                        len(data), hashlib.sha256(data).hexdigest(), feature(s), s.frames, sum(s.samples.values()), rate,
                    )
                    rows.append((*row, s.offsets) if with_offsets else row)
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    spec = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_samples long, sample_rate int"
    return media.select(F.col("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, spec + (", seek_offsets array<long>" if with_offsets else ""))
