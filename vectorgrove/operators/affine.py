"""Maps between the coordinates of PCA models, and quantized models; all bounded by dimensions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from vectorgrove.operators.pca import PcaModel


@dataclass
class Affine:
    """x @ matrix + offset."""

    matrix: np.ndarray
    offset: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return x @ self.matrix + self.offset

    def then(self, after: Affine) -> Affine:
        if self.matrix.shape[1] != after.matrix.shape[0]:
            raise ValueError(f"{self.matrix.shape[1]} coordinates don't go into {after.matrix.shape[0]}")
        return Affine(self.matrix @ after.matrix, after.apply(self.offset))


def encoder(model: PcaModel) -> Affine:
    return Affine(model.basis, -model.mean @ model.basis)


def decoder(model: PcaModel) -> Affine:
    return Affine(model.basis.T, model.mean)


def delta(source: PcaModel, target: PcaModel, exact: bool = True) -> Affine:
    """From coordinates of one model to those of another, through the vectors that the source's stand for.

    Exact ones need a source that keeps all directions; others go by the
    reconstruction, which leaves out what the source does.
    """
    if len(source.mean) != len(target.mean):
        raise ValueError(f"models of {len(source.mean)} and {len(target.mean)} components")
    if exact and source.basis.shape[1] < len(source.mean):
        raise ValueError(f"the source keeps {source.basis.shape[1]} of {len(source.mean)} directions")
    return decoder(source).then(encoder(target))


def chained(deltas: list[Affine]) -> Affine:
    """One map in place of several, the first applied first."""
    if not deltas:
        raise ValueError("a chain needs a map")
    whole = deltas[0]
    for d in deltas[1:]:
        whole = whole.then(d)
    return whole


def rebased(coordinates: np.ndarray, source: PcaModel, target: PcaModel, exact: bool = True) -> np.ndarray:
    return delta(source, target, exact).apply(coordinates)


def quantized(model: PcaModel, bits: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the directions and a scale for each, of 8 or 16 bits; a direction of zeros has scale 1."""
    if bits not in (8, 16):
        raise ValueError(f"{bits} bits")
    most = 2 ** (bits - 1) - 1
    largest = np.abs(model.basis).max(axis=0, initial=0)
    scale = np.where(largest > 0, largest / most, 1.0)
    return np.rint(model.basis / scale).clip(-most, most).astype(np.int8 if bits == 8 else np.int16), scale


def dequantized(model: PcaModel, codes: np.ndarray, scale: np.ndarray) -> PcaModel:
    return PcaModel(model.mean, codes * scale, model.variance, model.total_variance)
