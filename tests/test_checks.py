"""Refusals before a build or a search."""

import numpy as np
import pytest

from vectorgrove.plans import indexer
from vectorgrove.plans.checks import Balance, check_balance, check_profile, root_target
from vectorgrove.sources.blocks import branch_bytes, capacity, leaf_bytes


def test_constraints_that_trainers_keep():
    for trainer, balance in (("directional-pca", None), ("spherical-kmeans", Balance()), ("balanced", Balance(1, 9)), ("balanced", Balance())):
        check_balance(trainer, balance)
    for trainer, balance in (("directional-pca", Balance()), ("spherical-kmeans", Balance(low=1)), ("balanced", Balance(ratio=2.0)), ("balanced", Balance(penalty=0.5)), ("other", None)):
        with pytest.raises(ValueError):
            check_balance(trainer, balance)


def test_profiles_that_fit():
    size = next(s for s in range(1000, 100_000, 100) if capacity(8, s) >= 64)
    check_profile("0.4.0", 8, "f32le", size)
    check_profile("0.3.0", 8, "f16le", 300)
    check_profile("0.8.0", 8, "f32le", size)
    for version, encoding, at in (("0.4.0", "f32le", size - 200), ("0.8.0", "f16le", size), ("0.5.1", "i8", size)):
        with pytest.raises(ValueError):
            check_profile(version, 8, encoding, at)


def test_strict_builds_refuse_what_does_not_fit(spark):
    rows = [(i, [float(i), 1.0], {"a": "b"}, "text/plain", b"x") for i in range(4)]
    items = spark.createDataFrame(rows, "idx long, embedding array<float>, metadata map<string,string>, media_type string, body binary")
    with pytest.raises(ValueError, match="clusters"):
        indexer.build(indexer.leaves(items), "0.8.0", 1024, strict=True)


def test_targets_of_roots():
    def root(encoding="f32le", ext=None):
        return branch_bytes(1, 2, encoding, [(bytes(8 if encoding == "f32le" else 4), bytes(32))], ext)

    v = np.array([1.5, -2.0])
    assert root_target(root(), v) == v.astype("<f4").tobytes()
    assert root_target(root("f16le", {"ebcp": 1}), v) == v.astype("<f4").tobytes()
    leaf = leaf_bytes(2, bytes(8), {}, "text/plain", b"")
    for block, target in ((leaf, v), (root(), v[:1]), (root(), np.array([np.nan, 0])), (root("f16le"), v)):
        with pytest.raises(ValueError):
            root_target(block, target)
