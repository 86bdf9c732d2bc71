"""Embedding payloads: plain encodings, and quantized differences from a block's centroid."""

from __future__ import annotations

import numpy as np

#: Bits by place in the tree: root, level 1, others.
ROOT_BITS, LEAF_PARENT_BITS, INNER_BITS = 12, 6, 8
_PLAIN = {"f32le": "<f4", "f16le": "<f2", "i8": "i1"}


def encode(x: np.ndarray, encoding: str) -> bytes:
    return np.asarray(x).astype(_PLAIN[encoding]).tobytes()


def decode(payload: bytes, dims: int, encoding: str) -> np.ndarray:
    """As float32; integers are cast without a scale.  A wrong length is an error."""
    out = np.frombuffer(payload, _PLAIN[encoding])
    if len(out) != dims or encoding != "i8" and not np.isfinite(out).all():
        raise ValueError("payload doesn't fit its encoding")
    return out.astype(np.float32)


def bits_for(level: int, is_root: bool) -> int:
    return ROOT_BITS if is_root else LEAF_PARENT_BITS if level == 1 else INNER_BITS


def centroid(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float64).mean(0).astype(np.float32)


def scales(delta: np.ndarray, bits: int | np.ndarray) -> np.ndarray:
    """For each dimension the largest magnitude over the largest code; 1 where all are zero."""
    top = np.abs(delta).max(0) / (2.0 ** (np.asarray(bits) - 1) - 1).clip(1)
    return np.where(top > 0, top, 1.0).astype(np.float32)


def codes(delta: np.ndarray, scale: np.ndarray, bits: int | np.ndarray) -> np.ndarray:
    """Rounded half to even and clamped."""
    top = (2 ** (np.asarray(bits, np.int64) - 1) - 1).clip(1)
    return np.clip(np.rint(delta / scale), -top, top).astype(np.int64)


def _places(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all bits of a vector, the component that each belongs to, and its place there."""
    of = np.repeat(np.arange(len(bits)), bits)
    return of, np.arange(len(of)) - (np.cumsum(bits) - bits)[of]


def pack_block(code: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """Codes of vectors (rows), moved to be positive, from the lowest bit on; the last byte of each is filled with zeros."""
    bits = np.asarray(bits, np.int64)
    of, place = _places(bits)
    spread = ((np.asarray(code, np.int64) + (1 << bits - 1))[:, of] >> place) & 1
    return [row.tobytes() for row in np.packbits(spread.astype(np.uint8), axis=1, bitorder="little")]


def pack(code: np.ndarray, bits: np.ndarray) -> bytes:
    return pack_block(np.asarray(code)[None], bits)[0]


def unpack_block(payloads: list[bytes], bits: np.ndarray) -> np.ndarray:
    """Codes of vectors, as rows; bits set behind the last are an error."""
    bits = np.asarray(bits, np.int64)
    of, place = _places(bits)
    if any(len(p) != -(-len(of) // 8) for p in payloads):
        raise ValueError("payload doesn't fit its bits")
    raw = np.unpackbits(np.frombuffer(b"".join(payloads), np.uint8).reshape(len(payloads), -1), axis=1, bitorder="little")
    if raw[:, len(of) :].any():
        raise ValueError("payload doesn't fit its bits")
    if not len(of):
        return np.zeros((len(payloads), 0), np.int64)
    return np.add.reduceat(raw[:, : len(of)].astype(np.int64) << place, np.cumsum(bits) - bits, axis=1) - (1 << bits - 1)


def unpack(payload: bytes, bits: np.ndarray) -> np.ndarray:
    return unpack_block([payload], bits)[0]


def variable_bits(variance: np.ndarray, budget: int) -> np.ndarray:
    """One bit each, the rest in proportion to ln(1 + variance) by largest remainder; 31 at most."""
    bits = np.ones(len(variance), np.int64)
    left = budget * len(variance) - len(variance)
    weight = np.log1p(variance)
    share = weight / weight.sum() * left if weight.sum() > 0 else np.full(len(variance), left / len(variance))
    bits += np.floor(share).astype(np.int64)
    rest = np.argsort(-(share - np.floor(share)), kind="stable")[: int(left - np.floor(share).sum())]
    bits[rest] += 1
    return bits.clip(1, 31)


def rotation(x: np.ndarray) -> np.ndarray:
    """Principal directions of a block as rows; the identity for fewer than two vectors."""
    if len(x) < 2:
        return np.eye(x.shape[1])
    values, vectors = np.linalg.eigh(np.cov(x.astype(np.float64), rowvar=False))
    rows = vectors[:, np.argsort(-values, kind="stable")].T
    largest = np.argmax(np.abs(rows), axis=1)
    return rows * np.where(rows[np.arange(len(rows)), largest] < 0, -1.0, 1.0)[:, None]


POLICIES = ("ordinary", "rotated", "rotated-delta", "rotated-delta-uniform", "rotated-delta-variable", "ambient-delta-uniform")


def encode_block(x: np.ndarray, policy: str, bits: int) -> tuple[list[bytes], dict | None]:
    """Payloads of a branch's embeddings and the descriptor that decodes them."""
    if policy == "ordinary":
        return [encode(v, "f32le") for v in x], None
    base = np.zeros(x.shape[1], np.float32) if policy == "rotated" else centroid(x)
    turn = np.eye(x.shape[1]) if policy.startswith("ambient") else rotation(x)
    delta = (x.astype(np.float64) - base) @ turn.T
    out = {"base": base.tolist() if policy != "rotated" else None, "rotation": None if policy.startswith("ambient") else turn.astype(np.float32).tolist()}
    if policy in ("rotated", "rotated-delta"):
        return [encode(v, "f32le") for v in delta], out
    widths = variable_bits(delta.var(0), bits) if policy.endswith("variable") else np.full(x.shape[1], bits)
    scale = scales(delta, widths)
    out |= {"bits": widths.tolist(), "scales": scale.tolist()}
    return pack_block(codes(delta, scale, widths), widths), out


def decode_block(payloads: list[bytes], dims: int, descriptor: dict | None) -> np.ndarray:
    if descriptor is None:
        return np.array([decode(p, dims, "f32le") for p in payloads])
    if descriptor.get("bits"):
        widths = np.array(descriptor["bits"])
        delta = unpack_block(payloads, widths) * np.array(descriptor["scales"], np.float32)
    else:
        delta = np.array([decode(p, dims, "f32le") for p in payloads]).astype(np.float64)
    if descriptor.get("rotation"):
        delta = delta @ np.array(descriptor["rotation"])
    return (delta + np.array(descriptor["base"] or 0)).astype(np.float32)
