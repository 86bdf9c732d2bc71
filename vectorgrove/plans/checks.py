"""What a build or a search refuses before it starts: constraints that a trainer can't keep, profiles that don't fit, wrong targets."""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

from vectorgrove.functions import codecs
from vectorgrove.plans.profiles import profile
from vectorgrove.sources.blocks import capacity, parse


@dataclass
class Balance:
    """Least and most members of a cluster, the largest ratio of sizes, and a penalty for uneven ones; None where not asked for."""

    low: int | None = None
    high: int | None = None
    ratio: float | None = None
    penalty: float | None = None


#: The constraints that each trainer keeps; None for one that takes no constraints object, not even an empty one.
KEPT: dict[str, tuple[str, ...] | None] = {"directional-pca": None, "spherical-kmeans": (), "balanced": ("low", "high")}


def check_balance(trainer: str, balance: Balance | None) -> None:
    if trainer not in KEPT:
        raise ValueError(f"unknown trainer {trainer}")
    if balance is None:
        return
    kept = KEPT[trainer]
    refused = [f.name for f in fields(balance) if getattr(balance, f.name) is not None and f.name not in (kept or ())]
    if kept is None or refused:
        raise ValueError(f"{trainer} doesn't support balance constraints {', '.join(refused)}".rstrip())


def check_profile(version: str, dims: int, encoding: str, size: int) -> None:
    """A published profile's branches may need plain floats, and from 0.4 on all its clusters have to fit into a block of ``size`` bytes."""
    p = profile(version)
    if p.encoding != "ordinary" and encoding != "f32le":
        raise ValueError(f"profile {version} needs embeddings as f32le, not {encoding}")
    minor = int(version.split(".")[1])
    if minor >= 4 and p.algorithm == "directional-pca" and p.clusters > (fits := capacity(dims, size)):
        raise ValueError(f"profile {version} has {p.clusters} clusters, {fits} entries fit into {size} bytes")


def root_target(root: bytes, target: np.ndarray) -> bytes:
    """The target in the form that it is compared in with the entries of a root block.

    Entries with a descriptor are compared as the floats that they stand for;
    others need to be floats too.  A leaf, another number of components, and
    components that aren't finite are errors.
    """
    block = parse(root)
    if block["level"] == 0:
        raise ValueError("a leaf is no root to search from")
    if len(target) != block["dims"] or not np.isfinite(target).all():
        raise ValueError(f"the target isn't {block['dims']} finite components")
    if not block["ext"] and block["encoding"] != "f32le":
        raise ValueError(f"entries as {block['encoding']} aren't compared")
    return codecs.encode(target, "f32le")
