"""Published indexing and search profiles by version."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Profile:
    version: str
    clusters: int
    axes: int | None = None
    allocation: str = "log-bits"
    binning: str = "quantile"
    exact: bool = False
    min_rank: int = 1
    min_cumulative: float = 0.0
    encoding: str = "ordinary"
    capped: bool = False
    rank_zero_fallback: bool = False
    algorithm: str = "directional-pca"


def _profiles() -> dict[str, Profile]:
    out = [Profile("0.1.0", 157, algorithm="spherical-kmeans"), Profile("0.2.0", 2, 1, "centroid", exact=True)]
    for minor, binning in ((3, "valley"), (4, "quantile")):
        base = Profile(f"0.{minor}.0", 64, binning=binning)
        other = replace(base, binning="quantile", version=f"0.{minor}.3")
        third = [other, replace(other, axes=1, allocation="centroid"), replace(base, allocation="centroid")] if minor == 3 else [replace(base, axes=1, allocation="centroid"), replace(base, allocation="centroid")]
        rest = [replace(base, axes=2), replace(base, axes=3), replace(base, min_cumulative=0.5), replace(base, min_rank=2), replace(base, exact=True)]
        found = [base, replace(base, clusters=128), replace(base, clusters=32), *third, *rest]
        out += [replace(p, version=f"0.{minor}.{i}") for i, p in enumerate(found)]
    ladder = ("ordinary", "rotated", "rotated-delta", "rotated-delta-uniform", "rotated-delta-variable", "ambient-delta-uniform")
    for minor in (5, 6):
        out += [Profile(f"0.{minor}.{i}", 64, encoding=e, capped=minor == 6) for i, e in enumerate(ladder)]
    out += [Profile("0.7.0", 64, encoding="ambient-delta-uniform"), Profile("0.8.0", 64, encoding="ambient-delta-uniform", rank_zero_fallback=True)]
    return {p.version: p for p in out}


PROFILES = _profiles()
SEARCH_PROFILES = {"0.1.0": "top-w", "0.2.0": "geometry-aware"}


def profile(version: str) -> Profile:
    if version not in PROFILES:
        raise ValueError(f"unknown profile {version}")
    return PROFILES[version]


def effective_clusters(wanted: int, bound: int, n: int, power_of_two: bool) -> int:
    k = max(2, min(max(2, wanted), bound, n // 2))
    return 1 << (k.bit_length() - 1) if power_of_two else k
